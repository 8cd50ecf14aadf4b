import hashlib
import random
import zlib

import numpy as np

from premia.llm import queries, runs


def literal(words):
    """Runs by the definition: every stretch, its smallest period, no extension keeping it."""
    n, found = len(words), []
    for s in range(n):
        for e in range(s + 1, n + 1):
            part = words[s:e]
            q = next(p for p in range(1, len(part) + 1) if part[p:] == part[:-p])
            if e - s >= max(12, 2 * q) and (s == 0 or words[s - 1] != words[s - 1 + q]) and (
                    e == n or words[e] != words[e - q]):
                found.append((s, e, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def by_period(words):
    """The same by maximal stretches of every period, smallest period per stretch."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] == words[i + q]:
                j = i
                while j < n - q and words[j] == words[j + q]:
                    j += 1
                if j + q - i >= max(12, 2 * q):
                    best.setdefault((i, j + q), q)
                i = j
            i += 1
    return sorted(((s, e, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def random_words(rng, n):
    kind = rng.random()
    if kind < 0.3:
        return [rng.choice("ab") for _ in range(n)]
    if kind < 0.6:
        block = [rng.choice("abc") for _ in range(rng.randint(1, 8))]
        return [rng.choice("xy") for _ in range(rng.randint(0, 5))] + block * rng.randint(1, 9) + [
            rng.choice("abc") for _ in range(rng.randint(0, 6))]
    return [rng.choice("abcdefgh") for _ in range(n)]


def test_runs_equal_the_definition():
    rng = random.Random(5)
    for _ in range(300):
        words = random_words(rng, rng.randint(0, 45))
        assert [tuple(r) for r in runs.runs_of(runs.ids_of(words)).tolist()] == literal(words)


def test_long_periods_equal_scans_of_every_period():
    rng = random.Random(8)
    cases = []
    for _ in range(25):
        block = [str(rng.randint(0, 9)) for _ in range(rng.randint(65, 160))]
        cases.append([str(rng.randint(0, 3)) for _ in range(rng.randint(0, 40))] + block * rng.randint(1, 4)
                     + block[: rng.randint(0, 60)] + [str(rng.randint(0, 3)) for _ in range(30)])
    cases.append(["w"] * 700)
    cases.append((["a"] * 50 + ["b"] * 50) * 4)
    cases.append(((["a", "b"] * 40 + ["c"]) * 5))
    got = runs.runs_of_texts([runs.ids_of(w) for w in cases])
    for words, found in zip(cases, got):
        assert [tuple(r) for r in found.tolist()] == by_period(words)


def test_summary_of_odd_texts():
    empty = runs.summary([], runs.runs_of(runs.ids_of([])))
    assert empty["n_runs"] == 0 and empty["start"] is None
    assert empty["runs_sha256"] == hashlib.sha256(b"").hexdigest() == empty["collapsed_sha256"]
    words = ["x"] * 20
    row = runs.summary(words, runs.runs_of(runs.ids_of(words)))
    assert (row["n_runs"], row["start"], row["length"], row["period"], row["exponent_milli"]) == (1, 0, 20, 1, 20000)
    assert row["runs_sha256"] == hashlib.sha256(b"0,20,1\n").hexdigest()
    assert row["collapsed_sha256"] == hashlib.sha256(b"x").hexdigest()


def test_query_on_small_documents(spark, tmp_path):
    rng = random.Random(2)
    texts = [" ".join(random_words(rng, rng.randint(0, 60))) for _ in range(150)]
    texts += [None, "", "one\ttwo\nthree  ", "z " * 30000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a " * 30), (3, texts[3])]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)
    got = {(r.doc_id, r.runs_sha256, r.collapsed_sha256, r.n_runs, r.start, r.length, r.period)
           for r in queries.op12_runs(spark, str(tmp_path)).collect()}
    want = set()
    for doc_id, text in rows:
        words = queries.planted(doc_id, runs.words_of(text))
        found = by_period(words) if len(words) < 2000 else [(0, len(words), 1)]
        best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2])) if found else (None, None, None)
        mark = np.zeros(len(words) + 1, int)
        for s, e, q in found:
            mark[s + q] += 1
            mark[e] -= 1
        kept = [w for w, m in zip(words, np.cumsum(mark)) if m == 0]
        want.add((doc_id, hashlib.sha256("".join(f"{s},{e - s},{q}\n" for s, e, q in found).encode()).hexdigest(),
                  hashlib.sha256(" ".join(kept).encode()).hexdigest(), len(found), best[0],
                  None if best[0] is None else best[1] - best[0], best[2]))
    assert got == want
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None)
