import random
import time

import corpus_pipeline
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from premia.llm import jaccard
from premia.llm import sentencepiece as sp
from premia.llm.groups import by_group
from premia.storage import SPARING

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "name string, part int, n bigint, own int, total bigint, list array<bigint>"


@pytest.mark.parametrize("rows_a_batch", [1, 3, 10_000])
def test_equals_grouped_map(spark, rows_a_batch):
    def whole(frame):
        lists = frame["list"].iloc[0]
        return pd.DataFrame({"name": frame["name"], "part": frame["part"], "n": frame["n"],
                             "own": len(frame), "total": frame["n"].sum(),
                             "list": [None if lists is None else list(lists)] * len(frame)})

    rng = random.Random(rows_a_batch)
    name = [None, "a", "b", "", "é"]
    rows = [(rng.choice(name), rng.choice([None, 1, 2]), k, [k] if k % 3 else None)
            for k in range(200)]
    table = spark.createDataFrame(rows, "name string, part int, n bigint, list array<bigint>")
    table = table.withColumn("list", F.max("list").over(
        Window.partitionBy("name", "part")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        found = by_group(table.repartition("name", "part"), ["name", "part"], whole, SCHEMA)
        wanted = table.groupBy("name", "part").applyInPandas(whole, SCHEMA)
        assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))
        assert found.schema == wanted.schema
        assert by_group(table.limit(0), ["name", "part"], whole, SCHEMA).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def arrow_left(spark, before=0):
    """Bytes Arrow holds in the JVM, once tasks that just ended have freed theirs."""
    root = spark._jvm.org.apache.spark.sql.util.ArrowUtils.rootAllocator()
    for _ in range(50):
        if root.getAllocatedMemory() <= before:
            break
        time.sleep(0.1)
    return root.getAllocatedMemory()


def test_no_arrow_memory_is_left(spark):
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(words[k % 40:k % 40 + 100] + [f"own{k % 120}"])) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").persist()
    docs.count()
    before = arrow_left(spark)
    assert sp.encode(docs, PATH, chunk=64).count() == 150
    assert arrow_left(spark, before) <= before
    assert jaccard.classes(docs).where("n_links > 0").count() > 0
    assert arrow_left(spark, before) <= before
    docs.unpersist()


def test_one_python_step_a_task(spark, tmp_path, monkeypatch):
    """Small tables are joined without shuffles; the steps of long texts must not meet in a task."""
    def written(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.schema(df.schema).parquet(str(tmp_path / name))

    monkeypatch.setattr(sp, "store", written)
    docs = spark.createDataFrame([(1, "a b " * 50), (2, "c")], "doc_id bigint, text string")
    coded = sp.encode(docs, PATH, chunk=20)
    plan = coded._jdf.queryExecution().sparkPlan().toString()
    assert coded.count() == 2
    assert plan.count("MapInArrow") == 2 and "FlatMapGroups" not in plan


def direct_bytes(spark):
    """Of buffers that still have an owner."""
    jvm = spark._jvm
    jvm.System.gc()
    time.sleep(1)
    kind = jvm.java.lang.Class.forName("java.lang.management.BufferPoolMXBean")
    pools = jvm.java.lang.management.ManagementFactory.getPlatformMXBeans(kind)
    return sum(p.getMemoryUsed() for p in pools if p.getName() == "direct")


@pytest.fixture
def unset(spark):
    """The session without settings of its own for what the pipeline sets."""
    def clear():
        for key in SPARING:
            spark.conf.unset(key)

    clear()
    yield clear
    clear()


def test_large_files_leave_no_buffers(spark, tmp_path, unset):
    rng = random.Random(4)
    texts = [rng.randbytes(30_000).hex() for _ in range(500)]
    texts = [" ".join(t[k:k + 20] for k in range(0, len(t), 20)) for t in texts]
    pd.DataFrame({"doc_id": range(500), "text": texts}).to_parquet(
        tmp_path / "docs.parquet", compression=None)
    before = direct_bytes(spark)
    docs = corpus_pipeline.mask_secrets(
        spark, spark.read.parquet(str(tmp_path / "docs.parquet")), None)
    assert docs.where(F.length("text") == 62_999).count() == 500
    assert direct_bytes(spark) - before < 20 << 20


@pytest.mark.parametrize("number", range(5))
def test_stages_spare_memory_unless_told(spark, number, unset):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for told in ({}, {"parquet.hadoop.vectored.io.enabled": "true"}):
        unset()
        for key, value in told.items():
            spark.conf.set(key, value)
        corpus_pipeline.STAGES[number][1](spark, docs, sf_dir)
        assert {key: spark.conf.get(key) for key in SPARING} == SPARING | told
