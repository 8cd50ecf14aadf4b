import random
import sys
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import sentencepiece as library
from sentencepiece import sentencepiece_model_pb2 as proto

from premia.llm import sentencepiece as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, ids string, mark string, k string"


@pytest.fixture(scope="module")
def model():
    return sp.Pieces.load(PATH)


@pytest.fixture(scope="module")
def unigram():
    """The library's own search over the same pieces and scores."""
    held = proto.ModelProto()
    with open(PATH, "rb") as file:
        held.ParseFromString(file.read())
    held.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    return library.SentencePieceProcessor(model_proto=held.SerializeToString())


def sequential(model, text):
    """One search over the whole text, without words or chunks."""
    ready = sp.prepared(text)
    best, came = model.search(ready, len(ready))
    return model.trace(ready, came, len(ready))[0]


def test_as_good_as_the_library(model, unigram, spark):
    """The library's exact search gives the same sum; equal sums may differ in their pieces."""
    rows, same, lines = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), 0, 0
    for row in rows.limit(60).collect():
        for line in filter(None, row.text.split("\n")):
            if "  " not in line and len(line) < 300:
                own, other = model.encode(line), unigram.nbest_encode_as_ids(line, 2)[0]
                total = [sum(unigram.get_score(k) for k in ids) for ids in (own, other)]
                if min(total) < -1e8:  # beyond the precision of the library's sums
                    continue
                assert total[0] == total[1]
                same += own == other
                lines += 1
    assert lines > 100 and same > 0.9 * lines


def test_whole_table(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    coded = sp.decode(sp.encode(docs, PATH, chunk=500), PATH)
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = coded.collect()
    assert len(found) == len(texts)
    for row in found:
        assert row.decoded == texts[row.doc_id]
        assert row.ids == sequential(model, texts[row.doc_id])


@pytest.mark.parametrize("chunk", [16, 17, 40])
def test_chunks_equal_one_search(spark, model, chunk):
    rng = random.Random(chunk)
    parts = ["the", " ", "  ", "er", "tion", "x", "é", "\n", "\U0001F600", "ß", "123", "日本", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    texts += ["a" * 300, " " * 200, "thetionerthe" * 40]
    docs = spark.createDataFrame([(k, t, "x", "y", "z") for k, t in enumerate(texts)], SCHEMA)
    found = {r.doc_id: r.ids for r in sp.encode(docs, PATH, chunk=chunk).collect()}
    assert found == {k: sequential(model, t) for k, t in enumerate(texts)}
    assert all(model.decode(found[k]) == t for k, t in enumerate(texts))


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, None, "a", "b", "c"), (1, "", "a", "b", "c"),
                                  (1, "", "a", "b", "c")], SCHEMA)
    assert sorted(map(tuple, sp.encode(docs, PATH).collect()), key=str) == [
        (1, []), (1, []), (None, [])]
    assert sp.encode(docs.limit(0), PATH).count() == 0


def test_products_are_associative(model):
    text = "theerthtionofinghanandtheotheronnerandmoreofit"
    a, b, c = (model.matrix(text[s:e + 15], e - s)[None] for s, e in ((0, 16), (16, 28), (28, 41)))
    left, right = sp.times(sp.times(a, b), c), sp.times(a, sp.times(b, c))
    assert (left == right).all()
    assert left[0, 0, 0] == model.search(text, len(text))[0][41]


def test_decoding_many_rows_with_missing_and_empty_ones(spark, model):
    texts = [None if k % 7 == 0 else "" if k % 5 == 0 else f"number {k} of the rows" for k in range(700)]
    rows = [(k, None if t is None else model.encode(t)) for k, t in enumerate(texts)]
    coded = spark.createDataFrame(rows, "k int, ids array<int>").coalesce(1)
    assert {r.k: r.decoded for r in sp.decode(coded, PATH).collect()} == dict(enumerate(texts))


def odd_texts(seed):
    rng = random.Random(seed)
    parts = ["the", " ", "  ", "er", "x", "é", "\n", "\0", "\U0001F600", "\u0378", "日本", ".", "\u2581", "qzx" * 25]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [
        "", " ", "", "a" * 64, "a" * 65, "é" * 63, " a", "a ", "\u0378" * 70, ""]


@pytest.mark.parametrize("known", [0, 20, 150_000])
def test_batches_equal_single_searches(model, monkeypatch, known):
    """Whatever is forgotten between batches, and whichever words are new together."""
    monkeypatch.setattr(sp, "KNOWN", known)
    for seed in range(3):
        texts = odd_texts(seed)
        found = model.encode_all(texts).to_pylist()
        assert found == [sequential(model, t) for t in texts]
        ends = np.cumsum([0, *map(len, found)])
        assert model.decode_all(sp.pa.array([k for ids in found for k in ids], sp.pa.int32()), ends) == [
            t.replace("\u2581", " ") for t in texts]


def test_known_words_stay_few(model, monkeypatch):
    monkeypatch.setattr(sp, "KNOWN", 100)
    monkeypatch.setattr(sp, "KNOWN_BYTES", 10_000)
    for start in range(0, 2_000, 50):
        model.encode_all([" ".join(f"w{chr(97 + k % 26)}{'ab' * (k % 90)}" for k in range(start, start + 50))])
        assert len(model.known) <= 150 and model.known.nbytes <= 20_000 + 50 * 8
        assert len(model.met) == len(model.known) == len(model.word_ends) - 1


def test_no_python_step_for_each_word(model):
    """2,000 new words take hardly more calls than one."""
    rng, calls = random.Random(5), []
    text = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(2_000))
    sys.setprofile(lambda frame, event, what: calls.append(event))
    model.encode(text)
    sys.setprofile(None)
    assert len(calls) < 2_000


def test_pieces_take_little_memory():
    tracemalloc.start()
    held = sp.Pieces.load(PATH)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held.names and size < 18e6
