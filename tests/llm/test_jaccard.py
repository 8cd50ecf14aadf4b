import random

import numpy as np
import pytest

from premia.llm import jaccard
from premia.llm.components import components

SCHEMA = "doc_id bigint, text string, t1 string, row string, mark string, key string"


def shingle_set(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows, threshold=0.8):
    """Sorted (doc_id, class_id, n_links, n_text_links) of all rows."""
    distinct = sorted({t or "" for _, t in rows})
    sets = [shingle_set(t) for t in distinct]
    holders = {}
    for k, found in enumerate(sets):
        for s in found:
            holders.setdefault(s, []).append(k)
    copies = [sum((t or "") == d for _, t in rows) for d in distinct]
    near = [set() for _ in distinct]
    for k, found in enumerate(sets):
        for other in {o for s in found for o in holders[s]}:
            both = len(found & sets[other])
            if other != k and both >= threshold * (len(found) + len(sets[other]) - both):
                near[k].add(other)
    group = list(range(len(distinct)))
    changed = True
    while changed:
        changed = False
        for k in range(len(group)):
            least = min([group[k], *(group[o] for o in near[k])])
            changed |= least < group[k]
            group[k] = least
    place = {t: k for k, t in enumerate(distinct)}
    least = {}
    for doc_id, text in rows:
        if doc_id is not None:
            g = group[place[text or ""]]
            least[g] = min(doc_id, least.get(g, doc_id))
    out = []
    for doc_id, text in rows:
        k = place[text or ""]
        out.append((doc_id, least.get(group[k]), copies[k] - 1 + sum(copies[o] for o in near[k]),
                    len(near[k])))
    return sorted(out, key=str)


def near_copies(seed, groups, members, words=120):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(words)]
        for _ in range(members):
            text = list(base)
            for _ in range(rng.randint(0, 6)):
                text[rng.randrange(words)] = f"x{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(text)))
    return rows


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)
    return docs, sorted(map(tuple, jaccard.classes(docs).collect()), key=str)


@pytest.mark.parametrize("rows", [
    [], [(1, None), (2, ""), (3, " \n"), (None, "a b"), (4, "a b"), (4, "a b")],
    [(1, "one two three four five six " * 5000), (2, "one two three four five six " * 4999),
     (3, "a b c d e"), (4, "a b c d e f"), (5, "a  b c\td e")],
    near_copies(1, 30, 4), near_copies(2, 1, 60) + [(k + 100, "same words here") for k in range(50)],
])
def test_equals_brute_force(spark, rows):
    docs, found = run(spark, rows)
    assert found == brute(rows)
    kept = jaccard.keep_one(docs)
    assert kept.schema.names == docs.schema.names
    classes = {(c, ) for _, c, _, _ in found}
    assert kept.count() == len(classes) or any(i is None for i, _ in rows)
    assert {(r.doc_id,) for r in kept.collect() if r.doc_id is not None} == {
        c for c in classes if c[0] is not None}


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 50)
    rows = near_copies(3, 1, 240) + [(1000 + k, f"g0w{k}") for k in range(5)]
    assert run(spark, rows)[1] == brute(rows)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, jaccard.classes(docs).collect()), key=str) == brute(rows)


def test_pruning_keeps_pairs_at_the_threshold():
    need = jaccard.least_matches(0.8)
    rng = np.random.default_rng(1)
    agree = rng.random((200_000, jaccard.SIGNATURE)) < 0.8
    for n, least in need.items():
        assert (agree[:, :n].sum(axis=1) >= least).mean() > 0.9999
    apart = rng.random((10_000, jaccard.SIGNATURE)) < 0.2
    assert (apart.sum(axis=1) < need[jaccard.SIGNATURE]).all()


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b").union(
        spark.createDataFrame([(500, 501), (501, 500), (7, 7)], "a bigint, b bigint"))
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == {**{k: 0 for k in range(201)}, 500: 500, 501: 500}


def test_components_of_chains_in_random_order(spark):
    rng, edges, wanted = random.Random(6), [], {}
    for start, length, width in ((0, 1000, 2), (10_000, 1500, 5)):
        ids = list(range(start, start + length))
        rng.shuffle(ids)
        for k in range(length - width + 1):
            edges += [(i, min(ids[k:k + width])) for i in ids[k:k + width]]
        wanted |= dict.fromkeys(ids, start)
    rng.shuffle(edges)
    table = spark.createDataFrame(edges, "a bigint, b bigint")
    assert {r.node: r.root for r in components(table).collect()} == wanted


def test_chain_of_revisions(spark):
    text, rows = [f"w{i}" for i in range(60)], []
    for k in range(700):
        text[k * 7 % 60] = f"r{k}"
        rows.append((k, " ".join(text)))
    found = run(spark, rows)[1]
    assert found == brute(rows)
    assert {c for _, c, _, _ in found} == {0}


def test_sql_equals_brute_force():
    import duckdb
    from premia.llm.queries import ORACLE_SQL
    duck = duckdb.connect()
    duck.sql("CREATE VIEW documents AS FROM '/root/testdata/sf0.01/documents.parquet'")
    rows = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    found = duck.sql(ORACLE_SQL["op9_jaccard_join"]).fetchall()
    assert sorted(found, key=str) == brute(rows)
