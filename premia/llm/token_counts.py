"""Token counts through a cache keyed by digests of the content and of the tokenizer.

The cache is a folder of Parquet files (content, tokenizer, n_tokens). A call joins the digests of
its distinct texts to it, encodes only the misses, appends them, and joins the counts back to all
rows. Files are added by Spark's own commit, so a retried task leaves no second copy, and readers
take one row a key should two jobs add the same text.

The tokenizer file is one of the ``tokenizers`` library. Counts equal that library's, special
strings in texts included. Where a rank file of the same vocabulary is given, texts made of common
characters are encoded with it, several times faster; tests hold both against each other.

Nulls count as empty texts (no tokens); repeated texts are encoded once; an empty table gives an
empty result; other columns are not read.
"""

import base64
import hashlib
import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from premia.llm.text import pieces

# Letters of Unicode's first blocks, punctuation and symbols: any version of the tables that the
# two encoders carry classes these alike.
_COMMON = re.compile(r"[\t\n\r\x20-\x7e\xa0-ɏ‐-‧‰-⁞₠-₿]*")


@lru_cache(maxsize=4)
def counter(path, ranks_path=None, pattern=None):
    """A function from a list of texts to their token counts."""
    from tokenizers import Tokenizer
    exact = Tokenizer.from_file(path)
    if ranks_path is None:
        return lambda texts: [len(e.ids) for e in exact.encode_batch(texts,
                                                                     add_special_tokens=False)]
    import tiktoken
    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
    with open(path, encoding="utf-8") as file:
        special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks,
                              special_tokens=special)

    def count(texts):
        return [len(quick.encode(t, allowed_special="all")) if _COMMON.fullmatch(t)
                else len(exact.encode(t, add_special_tokens=False).ids) for t in texts]
    return count


def version(path):
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _read_cache(spark, folder):
    schema = "content binary, tokenizer string, n_tokens bigint"
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def count_tokens(docs, cache, tokenizer, ranks=None, pattern=None, limit=512,
                 id_column="doc_id", text_column="text"):
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row."""
    spark, mark = docs.sparkSession, version(tokenizer)
    text = F.coalesce(F.col(text_column), F.lit(""))
    content = F.unhex(F.sha2(text, 256)).alias("content")
    known = _read_cache(spark, cache).where(F.col("tokenizer") == mark)
    misses = (docs.select(content, text.alias("text")).dropDuplicates(["content"])
              .join(known.select("content"), "content", "left_anti"))

    def encode(batches):
        count = counter(tokenizer, ranks, pattern)
        for batch in batches:
            for piece in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [piece.column("content"), pa.array([mark] * piece.num_rows),
                     pa.array(count(piece.column("text").to_pylist()), pa.int64())],
                    ["content", "tokenizer", "n_tokens"])

    (misses.mapInArrow(encode, "content binary, tokenizer string, n_tokens bigint")
     .write.mode("append").parquet(cache))
    counts = (_read_cache(spark, cache).where(F.col("tokenizer") == mark)
              .groupBy("content").agg(F.max("n_tokens").alias("n_tokens")))
    rows = docs.select(F.col(id_column).alias("doc_id"), content,
                       F.octet_length(text).cast("bigint").alias("n_bytes"))
    return rows.join(counts, "content").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
