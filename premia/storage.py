"""Where jobs keep the tables they store between stages."""

import uuid

from pyspark import StorageLevel

SPARING = {"parquet.hadoop.vectored.io.enabled": "false",
           "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def shared_dir(spark):
    """The shared folder named by the session, or None where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = configured or spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/") if folder else None


def new_path(spark, name):
    """A path of its own in the shared folder, or None."""
    folder = shared_dir(spark)
    return folder and f"{folder}/premia/{name}-{uuid.uuid4().hex}"


def store(df, name="table"):
    """Fix ``df`` for several readers and return it.

    With a shared folder (``spark.checkpoint.dir``) the table is written there as Parquet and
    read back: this cuts lineage and survives lost executors. A local master without one
    persists it instead, on its only machine. Any other master must name a folder.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df, *keys):
    """The rows dealt by the hash of ``keys`` to ``spark.sql.shuffle.partitions`` tasks.

    For keys that hardly repeat within an input split: an aggregate or distinct by them then has no
    table before its shuffle, which would hold nearly all rows of the split, and its tasks stay
    small, where Spark would join partitions by their packed size, many times less than their rows
    take in memory.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def spare_memory(spark):
    """Keep small what executors hold outside the heap, where the session's settings say nothing of it.

    With vectored reads of Parquet every reading thread keeps a buffer as large as the largest
    column chunk it has read. A batch sent to Python is held by Arrow in the executor and by the
    worker. Spark counts neither. The rows are the same.
    """
    told = spark.conf.getAll
    for key, value in SPARING.items():
        if key not in told:
            spark.conf.set(key, value)


def release(*tables):
    """Free what ``store`` persisted; written tables stay until the folder is emptied."""
    for table in tables:
        table.unpersist()
