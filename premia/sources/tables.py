"""Scans of the source tables and sinks for derived ones."""

from pathlib import PurePosixPath

from pyspark.sql import functions as F

from premia.functions.columns import missing_nan
from premia.schemas import TABLES

FORMATS = {".csv": "csv", ".parquet": "parquet"}


def _format(name, file_format, default):
    suffix = PurePosixPath(name).suffix.lower()
    chosen = FORMATS.get(suffix) or file_format or default
    if suffix and suffix not in FORMATS:
        raise ValueError(f"unsupported file format: {suffix}")
    if chosen not in FORMATS.values():
        raise ValueError(f"unsupported file format: {chosen}")
    return chosen


def read_table(spark, base, name, schema=None, columns=None, file_format=None,
               default_format="parquet"):
    """Scan ``base/name``; the format comes from the suffix, the argument or the default.

    A table that does not exist raises FileNotFoundError. CSV files have a header and may
    start with a byte-order mark; the known tables have their own schema. Parquet files bring
    theirs.
    """
    chosen = _format(name, file_format, default_format)
    path = f"{base}/{name}" if PurePosixPath(name).suffix else f"{base}/{name}.{chosen}"
    reader = spark.read
    if chosen == "csv":
        schema = TABLES.get(PurePosixPath(name).stem) if schema is None else schema
        reader = reader.option("header", True)
        if schema is not None:
            # types are given by header name, so files may leave columns out or reorder them
            present = reader.csv(_existing(spark, path)).columns
            known = {f.name: f for f in schema.fields}
            ddl = ", ".join(f"`{c}` {known[c].dataType.simpleString() if c in known else 'string'}"
                            for c in present)
            return _pick(missing_nan(reader.schema(ddl).csv(path)), columns)
        return _pick(reader.csv(_existing(spark, path)), columns)
    reader = reader if schema is None else reader.schema(schema)
    return _pick(missing_nan(reader.parquet(_existing(spark, path))), columns)


def _existing(spark, path):
    """The path, after a look at the file system of the path itself."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = location.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(location):
        raise FileNotFoundError(path)
    return path


def _pick(df, columns):
    return df if columns is None else df.select(*columns)


def scan(df, columns=None, where=None, limit=None, order=None):
    """Filter, then project, then limit; give ``order`` to make the limit deterministic."""
    if where is not None:
        df = df.where(where)
    if order is not None and limit is not None:
        df = df.orderBy(*order)
    df = _pick(df, columns)
    return df if limit is None else df.limit(limit)


def scan_period(df, date, start, end, columns=None):
    """Rows whose date lies between two dates, both included."""
    return _pick(df.where(F.col(date).between(F.lit(start).cast("timestamp"),
                                              F.lit(end).cast("timestamp"))), columns)


def catalog_table(spark, name, columns=None, where=None, limit=None, order=None):
    return scan(spark.table(name), columns, where, limit, order)


def query(spark, text, params=None):
    """A SQL query with named parameters."""
    return spark.sql(text, args=params)


def jdbc_table(spark, url, name, columns=None, where=None, limit=None, properties=None,
               split_on=None, bounds=None, tasks=None):
    """A database table; projection, filter and limit are pushed to the database by Spark.

    ``split_on`` names a numeric, date or timestamp column by whose values between the two
    ``bounds`` the read is split into ``tasks`` queries; rows outside the bounds are read too.
    """
    split = {} if split_on is None else {
        "column": split_on, "lowerBound": bounds[0], "upperBound": bounds[1],
        "numPartitions": tasks or spark.sparkContext.defaultParallelism}
    df = spark.read.jdbc(url, name, properties=properties or {}, **split)
    return scan(df, columns, where, limit)


def list_tables(spark):
    return sorted(t.name for t in spark.catalog.listTables())


def load_tables(spark, base, names=tuple(TABLES), file_format=None, default_format="parquet",
                register=False):
    """The tables that exist, by name; absent ones are left out."""
    found = {}
    for name in names:
        try:
            found[name] = read_table(spark, base, name, file_format=file_format,
                                     default_format=default_format)
        except FileNotFoundError:
            continue
        if register:
            found[name].createOrReplaceTempView(name)
    return found


def write_tables(tables, base, file_format="parquet", partition_by=None):
    """Write each table to its own folder; returns the paths by name.

    ``partition_by`` maps a table name to its partition columns; the annual cash flows are
    partitioned by year unless told otherwise.
    """
    if file_format not in FORMATS.values():
        raise ValueError(f"unsupported file format: {file_format}")
    layout = {"cashflow_annual": ["year"]} if partition_by is None else partition_by
    paths = {}
    for name, df in tables.items():
        if df is None:
            continue
        keys = layout.get(name)
        if keys:
            # few files per folder, while a folder with most of the rows is still split
            df = df.hint("rebalance", *keys)
        writer = df.write.mode("overwrite")
        if keys:
            writer = writer.partitionBy(*keys)
        if file_format == "csv":
            writer = writer.option("header", True)
        paths[name] = f"{base}/{name}.{file_format}"
        writer.format(file_format).save(paths[name])
    return paths


def read_tables(spark, base, names, file_format="parquet", schemas=None):
    """Read derived tables back; absent ones are left out."""
    found = {}
    for name in names:
        try:
            found[name] = read_table(spark, base, name, schema=(schemas or {}).get(name),
                                     file_format=file_format)
        except FileNotFoundError:
            continue
    return found
