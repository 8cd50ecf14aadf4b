"""Document fingerprints: the ``k`` smallest shingle hashes of a text.

A fingerprint is the base64 form of its ascending 48-bit hashes. Two of them merge to the
fingerprint of both texts together, so parts of a text, or of a corpus, can be sketched apart.
From them follow resemblance, containment and the number of distinct shingles; with at most
``k`` shingles all three are exact.

Nulls count as empty texts, which have the one shingle of no words; equal texts have equal
fingerprints; an empty table gives an empty result; other columns are not read.
"""

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from premia.llm.text import pieces, shingles_of
from premia.storage import store

K = 128
RUN = 512
_BYTES = 6


def sketches(texts, k=K):
    """The fingerprint of each text, as ascending hashes."""
    hashes, offsets = shingles_of(texts)
    hashes = hashes >> np.uint64(64 - 8 * _BYTES)
    return [np.unique(hashes[a:b])[:k] for a, b in zip(offsets[:-1], offsets[1:])]


def encode(sketch):
    low = sketch.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES]
    return base64.b64encode(low.tobytes()).decode()


def decode(text):
    low = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, _BYTES)
    return np.pad(low, ((0, 0), (0, 8 - _BYTES))).reshape(-1).view("<u8")


def merge(a, b, k=K):
    return np.unique(np.concatenate([a, b]))[:k]


def distinct(sketch, k=K):
    """Estimated number of distinct shingles."""
    if len(sketch) < k:
        return float(len(sketch))
    return (k - 1) * 2.0 ** (8 * _BYTES) / float(sketch[k - 1] + np.uint64(1))


def resemblance(a, b, k=K):
    """Estimated shingles in both over shingles in either."""
    both = merge(a, b, k)
    shared = np.intersect1d(a, b, assume_unique=True)
    return len(np.intersect1d(both, shared, assume_unique=True)) / max(1, len(both))


def containment(a, b, k=K):
    """Estimated part of the shingles of ``a`` that ``b`` has."""
    either = distinct(merge(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * either / max(1.0, distinct(a, k)))


def merged(fingerprints, key, column="fingerprint", k=K):
    """Fingerprint of all rows of each key: merged within tasks first, then per key."""
    chosen = fingerprints.select(F.col(key).cast("string").alias("key"),
                                 F.col(column).alias("fingerprint")).where("fingerprint is not null")

    def fold(frames):
        held = {}
        for frame in frames:
            for name, text in zip(frame["key"], frame["fingerprint"]):
                sketch = decode(text)
                held[name] = merge(held[name], sketch, k) if name in held else sketch
            if len(held) > 10_000:
                yield _rows(held)
                held = {}
        yield _rows(held)

    schema = "key string, fingerprint string"
    partial = chosen.mapInPandas(fold, schema)
    while_one_key = partial.repartition("key").sortWithinPartitions("key")
    return while_one_key.mapInPandas(_fold_sorted(k), schema)


def _rows(held):
    return pd.DataFrame({"key": list(held), "fingerprint": [encode(s) for s in held.values()]},
                        dtype=object)


def _fold_sorted(k):
    def fold(frames):
        held = {}
        for frame in frames:
            for name, text in zip(frame["key"], frame["fingerprint"]):
                sketch = decode(text)
                if name in held:
                    held[name] = merge(held[name], sketch, k)
                else:
                    if held:
                        yield _rows(held)
                    held = {name: sketch}
        if held:
            yield _rows(held)
    return fold


def fingerprint(docs, id_column="doc_id", text_column="text", k=K):
    """doc_id and fingerprint of every row."""
    chosen = docs.select(F.col(id_column).alias("doc_id"),
                         F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def sketch(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts = piece.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array([encode(s) for s in sketches(texts, k)])],
                    ["doc_id", "fingerprint"])

    return chosen.mapInArrow(sketch, f"doc_id {kind}, fingerprint string")


def _previous_runs(docs):
    """For each run of ids its first id and the run before it, the last run for the first one.

    Runs are grouped, so no window holds more than the runs of a group or one row a group.
    """
    runs = docs.groupBy("run").agg(F.min("doc_id").alias("first_id"))
    runs = store(runs.withColumn("part", F.floor(F.col("run") / 4096)), "runs")
    parts = (runs.groupBy("part").agg(F.max("run").alias("last"))
             .withColumn("all", F.max("last").over(W.partitionBy(F.lit(0))))
             .withColumn("end_before", F.coalesce(F.lag("last").over(W.orderBy("part")), "all"))
             .select("part", "end_before"))
    inside = F.lag("run").over(W.partitionBy("part").orderBy("run"))
    return store(runs.join(parts, "part").select(
        "run", "first_id", F.coalesce(inside, "end_before").alias("before")), "runs-before")


def edited_fingerprints(docs, id_column="doc_id", text_column="text", k=K):
    """Fingerprints of every text and of its edited text.

    The edited text has its last half replaced by as much of the start of the next document by id
    (rows of equal id in text order, null ids last, then round to the first). Ids are dealt in
    runs of ``RUN`` consecutive numbers, so no run holds more than that many ids, and the first
    row of each run is also sent to the run before it: the texts are shuffled once.
    """
    own = docs.select(F.col(id_column).cast("bigint").alias("doc_id"),
                      F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    run = F.coalesce(F.floor(F.col("doc_id") / RUN), F.lit(2**62))
    before = _previous_runs(own.select("doc_id", run.alias("run")))
    ahead = (own.join(before, own.doc_id.eqNullSafe(before.first_id))
             .select(F.col("before").alias("run"), F.lit(1).alias("ahead"), "doc_id", "text"))
    rows = (own.select(run.alias("run"), F.lit(0).alias("ahead"), "doc_id", "text")
            .unionByName(ahead).repartition("run")
            .sortWithinPartitions("run", "ahead", F.col("doc_id").asc_nulls_last(), "text"))
    return rows.mapInArrow(
        lambda batches: _edit(batches, k),
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string,"
        "edited_fingerprint string, near_edited double, near_next double")


def _edit(batches, k):
    waiting = None
    for batch in batches:
        for piece in pieces(batch, "text"):
            rows = list(zip(*(piece.column(c).to_pylist()
                              for c in ("run", "ahead", "doc_id", "text"))))
            if waiting is not None:
                rows.insert(0, waiting)
            waiting = None if rows[-1][1] else rows[-1]
            pairs = [(x, y) for x, y in zip(rows, rows[1:]) if not x[1] and x[0] == y[0]]
            if pairs:
                yield _edited_rows(pairs, k)


def _edited_rows(pairs, k):
    texts = [x[3] for x, _ in pairs]
    halves = [len(t) // 2 for t in texts]
    edited = [t[:len(t) - h] + y[3][:h] for t, h, (_, y) in zip(texts, halves, pairs)]
    sketched = sketches(texts + [y[3] for _, y in pairs] + edited, k)
    n = len(pairs)
    own, following, changed = sketched[:n], sketched[n:2 * n], sketched[2 * n:]
    return pa.RecordBatch.from_arrays([
        pa.array([x[2] for x, _ in pairs], pa.int64()), pa.array(map(len, texts), pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array(map(encode, own)), pa.array(map(encode, changed)),
        pa.array([resemblance(a, b, k) for a, b in zip(own, changed)]),
        pa.array([resemblance(a, b, k) for a, b in zip(own, following)]),
    ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
        "near_next"])
