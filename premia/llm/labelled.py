"""A bounded sample of labelled documents for training, and sparse term features."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from premia.llm.text import pieces, term_hashes


def sample(docs, labels, label, most, keep=None):
    """(text, label) of at most ``most`` labelled documents, the first by hash of their id.

    The choice depends on the ids alone. Null labels, ids and texts are passed over, and an id
    with several rows counts once. ``keep`` is a condition on doc_id.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(
        "doc_id is not null and label is not null")
    usable = usable.where(keep) if keep is not None else usable
    chosen = (usable.groupBy("doc_id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
            .where("text is not null").join(F.broadcast(chosen), "doc_id")
            .dropDuplicates(["doc_id"]).select("doc_id", "text", "label"))


def terms(texts, buckets):
    """Document number, term bucket and count of every distinct term bucket of each text."""
    hashes, offsets = term_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    keys, counts = np.unique(doc * buckets + (hashes % np.uint64(buckets)).astype(np.int64),
                             return_counts=True)
    return keys // buckets, keys % buckets, counts


def in_parts(texts, make, size=200):
    """``make`` of a few texts at a time, its arrays joined; the first one counts texts."""
    found = [make(texts[k:k + size]) for k in range(0, len(texts), size)]
    shifted = [(doc + k * size, *rest) for k, (doc, *rest) in enumerate(found)]
    return [np.concatenate(column) for column in zip(*shifted)]


def score_rows(docs, score, columns, id_column="doc_id", text_column="text"):
    """mapInArrow of ``score(texts)``, which gives one array for each of ``columns`` (name, type)."""
    chosen = docs.select(F.col(id_column).alias("doc_id"),
                         F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                found = score(piece.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), *map(pa.array, found)],
                    ["doc_id", *(name for name, _ in columns)])

    return chosen.mapInArrow(run, f"doc_id {kind}, " + ", ".join(
        f"{name} {kind}" for name, kind in columns))
