import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from premia.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """The contract of op11 by dictionaries of whole prefixes (turns unique within a conversation)."""
    original = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            original[conv].append((turn is not None, turn or 0, role or "", text or ""))
    original = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in original.items()}
    rebuilt = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 4
        b = c - int(c / 20) * 20 if c < 0 else c - c % 20  # remainder with the sign of c, as in SQL
        b = c - (c - int(c / 20) * 20)
        rebuilt[c] = tuple(original.get(b, [])[:h]) + tuple(own[h:])
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def subtree(node):
        yield node
        for child in children[node]:
            yield from subtree(child)

    out = {}
    for node, ms in members.items():
        under = list(subtree(node))
        ends = sorted(c for c in ms if len(rebuilt[c]) == len(node))
        out[(min(ms), len(node))] = dict(
            parent_conv_id=min(members[node[:-1]]) if node else None, n_convs=len(ms),
            n_children=len(children[node]), n_leaves=sum(not children[u] for u in under),
            saved_tokens=sum((len(members[u]) - 1) * (len(WORD.findall(u[-1][1])) if u else 0)
                             for u in under),
            ends_sha256=hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return out


def run(spark, tmp_path, rows):
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(path)
    got = queries.op11_prefix_trie(spark, str(tmp_path)).collect()
    return {(r.conv_id, r.depth): {k: r[k] for k in ("parent_conv_id", "n_convs", "n_children", "n_leaves",
                                                      "saved_tokens", "ends_sha256")} for r in got}, len(got)


def test_small_table_equals_brute_force(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"w{c % 3} x{t}  y" * (t % 3))
            for c in range(45) for t in range(c % 6)]
    rows += [(40, 9, None, None), (60, 1, "user", "same"), (61, 0, "user", "same"), (62, 2, "user", "same"),
             (None, 0, "user", "no id"), (80, None, "system", ""), (80, 3, "user", "long " * 5000),
             (100, 0, "user", "a\tb\nc  "), (101, 0, "user", "a\tb\nc  "), (-7, 0, "user", "minus")]
    got, n = run(spark, tmp_path, rows)
    want = brute(rows)
    assert n == len(got) == len(want)
    assert got == want


def test_copies_of_one_conversation(spark, tmp_path):
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(3)]
    got, _ = run(spark, tmp_path, rows)
    assert got == brute(rows)
    assert got[(0, 0)]["n_convs"] == 300


def test_empty_table(spark, tmp_path):
    got, n = run(spark, tmp_path, [])
    assert n == 0


def test_driver_tables_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()]
    got = {(r.conv_id, r.depth): {k: r[k] for k in ("parent_conv_id", "n_convs", "n_children", "n_leaves",
                                                     "saved_tokens", "ends_sha256")}
           for r in queries.op11_prefix_trie(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute(rows)
