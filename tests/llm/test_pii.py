import hashlib
import random
import re

import numpy as np
import pytest

from premia.llm import pii

SCHEMA = "doc_id bigint, text string, found string, spans string, base_sha256 string"
RULES = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
         r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return (sum(digits[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in digits[-2::-2])) % 10 == 0


def brute(text):
    out = []
    for kind, rule in enumerate(RULES):
        for m in re.finditer(rule, text or ""):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if (kind == 0 or (kind == 1 and all(int(p) <= 255 for p in m[0].split(".")))
                    or (kind == 2 and 14 <= len(digits) <= 19 and luhn(digits))
                    or (kind == 3 and 10 <= len(digits) <= 15)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_rules_equal_regular_expressions():
    rng = random.Random(2)
    parts = ["a", "@", "b.c", ".", "-", "+", "1", "23", "456", "4111111111111111", " ", "(", ")",
             "%", "é", "255", "7992739871300000", "٣", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(20_000)]
    assert [pii.base_spans(t) for t in texts] == [brute(t) for t in texts]


def test_long_runs_take_no_square_of_their_length():
    for text in ("a" * 200_000 + "@x", "1" * 200_000 + ".5", "1." * 3 + "." + "1" * 200_000,
                 "@" * 100_000, "+" * 100_000):
        assert all(e <= len(text) for _, _, e in pii.base_spans(text))


def test_gradient():
    rng = np.random.default_rng(0)
    net = pii.Network.fresh(rng)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    windows, gold = rng.integers(0, 131, (3, 7)), rng.integers(0, pii.TAGS, (3, 7))
    single = np.float32
    pii.np.float32 = np.float64

    def loss():
        scores = net.emissions(windows)[0]
        total = pii.marginals(scores, net.weights["moves"])[2].sum()
        path = np.take_along_axis(scores, gold[..., None], 2).sum()
        return total - path - net.weights["moves"][gold[:, :-1], gold[:, 1:]].sum()

    try:
        scores, memory = net.emissions(windows, keep=True)
        chance, _, _ = pii.marginals(scores, net.weights["moves"])
        grads = net.gradients(windows, chance - np.eye(pii.TAGS)[gold], memory)
        for name in ("embed", "ahead", "back_bias", "out"):
            place = tuple(rng.integers(0, s) for s in net.weights[name].shape)
            if name == "embed":
                place = (windows[0, 0], place[1])
            held, net.weights[name][place] = net.weights[name][place], net.weights[name][place] + 1e-5
            up = loss()
            net.weights[name][place] = held - 1e-5
            assert (up - loss()) / 2e-5 == pytest.approx(grads[name][place], rel=2e-3, abs=1e-4)
            net.weights[name][place] = held
    finally:
        pii.np.float32 = single


def test_decode_is_best_path():
    rng = np.random.default_rng(4)
    scores, moves = rng.normal(size=(5, 4, pii.TAGS)), rng.normal(size=(pii.TAGS, pii.TAGS))
    for row, path in zip(scores, pii.decode(scores, moves)):
        every = row[0][:, None, None, None] + moves[:, :, None, None] + row[1][None, :, None, None]
        every = every + moves[None, :, :, None] + row[2][None, None, :, None]
        every = every + moves[None, None] + row[3]
        assert tuple(path) == np.unravel_index(every.argmax(), every.shape)
    assert np.allclose(pii.marginals(scores, moves)[0].sum(axis=2), 1)


def sentences(n, seed):
    rng = random.Random(seed)
    words = ["the", "onner", "thing", "of", "ereing", "was", "that", "and"]
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    out = []
    for _ in range(n):
        item = rng.choice([f"jo{digits(2)}@site{digits(1)}.org", f"10.{rng.randint(0, 255)}.3.4",
                           "4111 1111 1111 1111", f"+1 (415) 555-0{digits(3)}", digits(4), digits(9)])
        out.append(" ".join(rng.choices(words, k=12)) + f" {item} " + " ".join(rng.choices(words, k=9)))
    return out


def test_network_learns_and_only_adds(spark, monkeypatch):
    texts = sentences(600, 1)
    docs = spark.createDataFrame([(k, t, "a", "b", "c") for k, t in enumerate(texts)], SCHEMA)
    net = pii.train(docs, most=400, epochs=16)
    monkeypatch.setattr(pii, "SURE", 0.5)
    fresh = sentences(200, 2)
    found = pii.added_spans(fresh, [[] for _ in fresh], net)
    wanted = [brute(t) for t in fresh]
    hits = sum(len(set(a) & set(b)) for a, b in zip(found, wanted))
    assert hits > 0.9 * sum(map(len, wanted))
    assert hits > 0.9 * sum(map(len, found))
    long = " and then ".join(fresh)
    base = brute(long)
    assert not any(a < e and s < b for s, _, e in pii.added_spans([long], [base], net)[0]
                   for a, _, b in base)
    rows = [(None, None), (1, ""), (1, ""), (2, "no data"), (3, "9" * 4000), (4, long),
            (5, "call (415) 555-0123 now")]
    frame = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    result = pii.personal_data(frame, net).collect()
    assert len(result) == len(rows)
    for row, (_, text) in zip(result, rows):
        base = brute(text)
        assert row.base_sha256 == hashlib.sha256(",".join(
            f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        assert {(s, pii.KINDS[k], e) for s, k, e in base} <= {
            (s.start, s.kind, s.end) for s in row.found if s.base}
    assert pii.personal_data(frame.limit(0), net).count() == 0
    assert pii.train(frame.where("doc_id < 3")) is None
    assert pii.personal_data(frame, None).count() == len(rows)


def test_whole_table_base_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in pii.personal_data(docs, None).collect():
        assert [(s.start, pii.KINDS.index(s.kind), s.end) for s in row.found] == brute(
            texts[row.doc_id])
