"""Mix sources to target weights by drawing blocks of documents without replacement.

1. Every source gets a target in words: its weight's part of the whole mix, at most ``cap`` times
   the words it has, what is over going to the other sources by weight.
2. A source's documents fall into blocks by hash, ``BLOCK_DOCS`` on average. A pass over a source
   is a permutation of its blocks; the mix takes a prefix of pass 0, then of pass 1, ... Of the
   one block at the end of a prefix it takes documents in hash order that still fit.
3. A splitting tree deals the block counts of all sources to the output shards: each node gives
   its left half a multivariate hypergeometric draw, so shards differ by one block in length and
   are otherwise like a sample without replacement. A leaf knows which stretch of each source's
   permuted blocks is its own. Draws are seeded by node, so each shard walks from the root alone.
4. Rows go to their shard and are shuffled there by hash.

Everything is a function of the rows and the seed, so reruns and retried tasks agree.

A null text has no words; a null source is a source, last in order; documents without words are
carried by their block; rows alike in id and text are taken together; an empty table gives an
empty mix; other columns are kept, whatever their names.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from premia.storage import store

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_DOCS = 256
SHARD_WORDS = 10_000_000
_CHUNK = 1024


def word_count(text):
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("bigint")


def sizes(docs, id_column="doc_id", text_column="text", source_column="source"):
    """doc_id, source, size and key of every row; rows alike in id and text have one key."""
    return docs.select(
        F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"),
        word_count(text_column).alias("size"), _key(id_column, text_column).alias("key"))


def _key(id_column, text_column):
    return F.xxhash64(F.col(id_column).cast("string"), F.lit("/"), F.col(text_column))


def source_targets(sized, weights, share, cap):
    """One row a source: number, words, blocks and target. Windows here span sources, not rows."""
    found = sized.groupBy("source").agg(F.sum("size").alias("words"),
                                        F.count("*").alias("documents"))
    numbered = found.withColumn(
        "source_no", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("source_no") % len(weights) + 1).cast("int"))
    full = W.partitionBy(F.lit(0))
    fill = W.orderBy("fullness", "source_no")
    level = ((F.lit(float(share)) * F.sum("words").over(full)
              - F.coalesce(F.sum("most").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
             / F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing)))
    return (
        numbered.withColumn("weight", weight)
        .withColumn("most", F.col("words") * F.lit(float(cap)))
        .withColumn("fullness", F.col("most") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", F.min_by(F.when(F.col("level") < F.col("fullness"), F.col("level")),
                                      F.when(F.col("level") < F.col("fullness"),
                                             F.col("fullness"))).over(full))
        .withColumn("target", F.least("most", F.coalesce(F.col("level") * F.col("weight"), "most")))
        .withColumn("blocks", F.pow(2.0, F.ceil(F.log2(F.ceil(
            F.col("documents") / BLOCK_DOCS)))).cast("bigint"))
        .select("source", "source_no", "words", "target", "blocks"))


def _place(seed):
    """Number of a row's block: equal parts of the hash range."""
    return F.pmod(F.xxhash64(F.lit(seed), "key"), F.col("blocks")).alias("block")


def plan(sized, weights=(5, 2, 1), share=1.5, cap=2, seed=1, shard_words=SHARD_WORDS):
    """The small tables that decide the mix: sources, drawn blocks, and documents of end blocks."""
    sources = store(source_targets(sized, weights, share, cap), "mix-sources")
    placed = (sized.join(sources, sized.source.eqNullSafe(sources.source))
              .select("source_no", "key", "size", "target", "words", "blocks", _place(seed)))
    spin = F.xxhash64(F.lit(seed), "source_no", "pass")
    ordered = (
        placed.groupBy("source_no", "block").agg(
            F.sum("size").alias("size"), F.first("target").alias("target"),
            F.first("words").alias("words"), F.first("blocks").alias("blocks"))
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(int(np.ceil(cap)) - 1))))
        .withColumn("left", F.col("target") - F.col("pass") * F.col("words"))
        .where("left > 0")
        .withColumn("place", F.pmod(F.col("block") * (F.pmod(spin, F.lit(1 << 20)) * 2 + 1)
                                    + F.pmod(F.shiftright(spin, 20), F.lit(1 << 20)),
                                    F.col("blocks")))
        .withColumn("chunk", F.floor(F.col("place") / _CHUNK)))
    one_pass = W.partitionBy("source_no", "pass")
    before = W.unboundedPreceding
    chunks = (ordered.groupBy("source_no", "pass", "chunk").agg(
        F.sum("size").alias("chunk_size"), F.count("*").alias("chunk_blocks"))
        .withColumn("ahead", F.coalesce(F.sum("chunk_size").over(
            one_pass.orderBy("chunk").rowsBetween(before, -1)), F.lit(0)))
        .withColumn("ahead_blocks", F.coalesce(F.sum("chunk_blocks").over(
            one_pass.orderBy("chunk").rowsBetween(before, -1)), F.lit(0)))
        .drop("chunk_size", "chunk_blocks"))
    in_chunk = W.partitionBy("source_no", "pass", "chunk").orderBy("place")
    taken = store(
        ordered.join(chunks, ["source_no", "pass", "chunk"])
        .withColumn("ahead", F.col("ahead") + F.coalesce(
            F.sum("size").over(in_chunk.rowsBetween(before, -1)), F.lit(0)))
        .withColumn("ahead_blocks", F.col("ahead_blocks") + F.row_number().over(in_chunk) - 1)
        .where("ahead < left")
        .withColumn("room", F.when(F.col("ahead") + F.col("size") > F.col("left"),
                                   F.col("left") - F.col("ahead")))
        .select("source_no", "pass", "block", "size", "room", "ahead_blocks"), "mix-taken")
    shards = _deal(taken, seed, shard_words)
    drawn = store(taken.join(shards, ["source_no", "pass", "ahead_blocks"])
                  .groupBy("source_no", "block")
                  .agg(F.sort_array(F.collect_list(F.struct("pass", "shard", "room")))
                       .alias("draws")), "mix-blocks")
    ends = taken.where("room is not null").select("source_no", "pass", "block", "room")
    fitting = store(
        placed.join(ends, ["source_no", "block"])
        .groupBy("source_no", "pass", "room", "key").agg(F.sum("size").alias("size"))
        .groupBy("source_no", "pass").applyInPandas(_fitting(seed), "key bigint, pass int")
        .groupBy("key").agg(F.collect_set("pass").alias("end_passes")), "mix-ends")
    return sources, drawn, fitting


def _fitting(seed):
    def choose(docs):
        docs = docs.sort_values("key")
        order = np.random.default_rng([seed, int(docs["source_no"].iloc[0])]).permutation(len(docs))
        docs, room, kept = docs.iloc[order], float(docs["room"].iloc[0]), []
        for key, size in zip(docs["key"], docs["size"]):
            if size <= room:
                room -= size
                kept.append(key)
        return pd.DataFrame({"key": np.array(kept, np.int64),
                             "pass": np.full(len(kept), docs["pass"].iloc[0], np.int32)})
    return choose


def _deal(taken, seed, shard_words):
    """Shard of every taken block: pass 0 of a source comes first, then pass 1."""
    quotas = taken.groupBy("source_no", "pass").agg(
        F.count("*").alias("quota"), F.sum("size").alias("words"))
    one = quotas.groupBy().agg(
        F.sort_array(F.collect_list(F.struct("source_no", "pass", "quota"))).alias("quotas"),
        F.sum("words").alias("words")).where("words is not null")
    shards = F.greatest(F.lit(1), F.ceil(F.col("words") / shard_words))
    leaves = (one.withColumn("shards", shards)
              .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
              .select("shard", "shards", F.col("quotas.source_no").alias("sources"),
                      F.col("quotas.pass").alias("passes"), F.col("quotas.quota").alias("quotas"))
              .repartition("shard"))

    def walk(frames):
        for frame in frames:
            for row in frame.itertuples():
                first, count = leaf_range(row.shard, row.shards, row.quotas, seed)
                kept = count > 0
                yield pd.DataFrame({"source_no": row.sources[kept], "pass": row.passes[kept],
                                    "first": first[kept], "count": count[kept],
                                    "shard": row.shard})

    return (leaves.mapInPandas(walk, "source_no int, pass int, first bigint, count bigint,"
                                     "shard bigint")
            .select("source_no", "pass", "shard", F.explode(F.expr(
                "sequence(first, first + count - 1)")).alias("ahead_blocks")))


def leaf_range(shard, shards, quotas, seed):
    """First block and number of blocks of every source that one shard gets."""
    count, first = np.asarray(quotas, np.int64), np.zeros(len(quotas), np.int64)
    low, high = 0, int(shards)
    while high - low > 1:
        middle = (low + high) // 2
        draw = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(
            count, int(count.sum()) * (middle - low) // (high - low), method="marginals")
        if shard < middle:
            count, high = draw, middle
        else:
            first, count, low = first + draw, count - draw, middle
    return first, count


def with_draws(rows, planned, seed=1):
    """``rows`` (with source and key) with size and target of the source and the draws of the row."""
    sources, drawn, fitting = planned
    joined = (rows.join(sources, rows.source.eqNullSafe(sources.source)).drop(sources.source)
              .withColumn("block", _place(seed))
              .join(drawn, ["source_no", "block"], "left").join(fitting, ["key"], "left"))
    taken = F.filter(F.coalesce("draws", F.array()), lambda d: d["room"].isNull() | F.coalesce(
        F.array_contains("end_passes", d["pass"]), F.lit(False)))
    return joined.withColumn("draws", taken).drop("end_passes")


def mix(docs, id_column="doc_id", text_column="text", source_column="source", seed=1, **options):
    """The mixed rows of ``docs``: all columns, each row as often as it was drawn, by shard."""
    planned = plan(store(sizes(docs, id_column, text_column, source_column), "mix-sizes"),
                   seed=seed, **options)
    rows = docs.select(F.struct("*").alias("row"), F.col(source_column).alias("source"),
                       _key(id_column, text_column).alias("key"))
    return (with_draws(rows, planned, seed)
            .select("row", "key", F.explode("draws").alias("draw"))
            .repartition("draw.shard")
            .sortWithinPartitions("draw.shard", F.xxhash64(F.lit(seed), "draw.pass", "key"))
            .select("row.*"))
