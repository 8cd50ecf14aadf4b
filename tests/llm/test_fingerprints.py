import hashlib

import numpy as np
import pytest

from premia.llm import fingerprints as fp

SCHEMA = "doc_id bigint, text string, run string, ahead string"


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    out = []
    for k, (doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b, c = fp.sketches([text, edited, after])
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.encode(a),
                    fp.encode(b), fp.resemblance(a, b), fp.resemblance(a, c)))
    return sorted(out, key=str)


def shingle_set(text):
    words = text.split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("rows", [
    [], [(7, "one text only, é")], [(None, None), (None, "b c"), (3, "x y z"), (3, "a"), (3, "a")],
    [(i * 301 - 4000, "w%d " % (i % 7) * (i % 90)) for i in range(200)],
    [(1, "a\U0001F600b c d e f"), (600, ""), (601, "q " * 30_000), (70_000_000_000, None)],
])
def test_edited_equals_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    found = sorted(map(tuple, fp.edited_fingerprints(docs).collect()), key=str)
    assert found == brute(rows)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = sorted(map(tuple, fp.edited_fingerprints(docs).collect()), key=str)
    assert found == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_estimates():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(5000)]
    for part in (0.1, 0.5, 0.9):
        a = list(rng.choice(words, 2000))
        b = a[:int(2000 * part)] + list(rng.choice(words, 2000))
        ta, tb = " ".join(a), " ".join(b)
        sa, sb = shingle_set(ta), shingle_set(tb)
        x, y = fp.sketches([ta, tb])
        assert abs(fp.resemblance(x, y) - len(sa & sb) / len(sa | sb)) < 0.15
        assert abs(fp.containment(x, y) - len(sa & sb) / len(sa)) < 0.2
        assert abs(fp.distinct(x) / len(sa) - 1) < 0.3
        assert (fp.decode(fp.encode(x)) == x).all()


def test_small_texts_are_exact_and_merge():
    a, b = "a b c d e f g h", "a b c d e x y"
    sa, sb = fp.sketches([a, b])
    assert fp.resemblance(sa, sb) == 1 / 6
    assert fp.distinct(sa) == 4
    assert (fp.merge(sa, sb) == np.unique(np.concatenate([sa, sb]))).all()


def test_merged_by_key(spark):
    docs = spark.createDataFrame([(i, " ".join(f"t{i}.{j}" for j in range(60))) for i in range(40)],
                                 "doc_id bigint, text string")
    rows = fp.fingerprint(docs).selectExpr("doc_id % 3 as key", "fingerprint")
    found = {r.key: r.fingerprint for r in fp.merged(rows, "key").collect()}
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    for key in range(3):
        all_of_it = fp.sketches(texts[key::3])
        assert found[str(key)] == fp.encode(np.unique(np.concatenate(all_of_it))[:fp.K])
