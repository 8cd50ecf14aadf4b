import random

import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

from premia.llm import token_counts

JSON, RANKS = public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, content string, n_tokens string, tokenizer string"


@pytest.fixture(scope="module")
def exact():
    tokenizer = Tokenizer.from_file(JSON)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def count(spark, rows, cache, **more):
    docs = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    found = token_counts.count_tokens(docs, str(cache), JSON, RANKS, public.PATTERN, **more)
    return sorted(map(tuple, found.collect()), key=str)


def expected(rows, exact, limit=512):
    return sorted(((i, len((t or "").encode()), exact(t), exact(t) > limit) for i, t in rows),
                  key=str)


def test_cases(spark, exact, tmp_path):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "<|endoftext|> x <|endoftext|>"),
            (4, "word " * 40_000), (5, "a" * 3_000), (6, " \n\n\t  \r\n x"), (7, "été ß 日本語 \U0001F600")]
    assert count(spark, rows, tmp_path / "c") == expected(rows, exact)
    assert count(spark, [], tmp_path / "d") == []


def test_quick_encoder_equals_the_library(exact):
    rng = random.Random(6)
    quick = token_counts.counter(JSON, RANKS, public.PATTERN)
    alphabet = ([chr(c) for c in range(32, 0x250)] + list("\n\t\r ’“–…€ 　日\U0001F600")
                + ["'s", "'ll", "  ", "the", "12", "<|endoftext|>"])
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(6000)]
    assert quick(texts) == [exact(t) for t in texts]


def test_whole_table(spark, exact, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert count(spark, rows, tmp_path / "c") == expected(rows, exact)


def test_cache_is_used_and_grows(spark, exact, tmp_path):
    cache = tmp_path / "c"
    count(spark, [(1, "one two"), (2, "three")], cache)
    assert spark.read.parquet(str(cache)).count() == 2
    rows = [(1, "one two"), (5, "four"), (6, "four")]
    assert count(spark, rows, cache) == expected(rows, exact)
    assert spark.read.parquet(str(cache)).count() == 3
    other = spark.read.parquet(str(cache)).selectExpr("content", "'x' as tokenizer",
                                                      "n_tokens + 100 as n_tokens").collect()
    spark.createDataFrame(other, "content binary, tokenizer string, n_tokens bigint").write.mode(
        "append").parquet(str(cache))
    assert count(spark, rows, cache) == expected(rows, exact)
