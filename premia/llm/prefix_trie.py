"""Conversation prefix trie over a node table keyed by prefix digests.

Every distinct sequence of a conversation's first d turns (role and text) is a node of depth d; the
textless root has depth 0. Nodes are enumerated by their digest: each turn contributes a 62-bit
value mixed from its place and content, and a prefix's digest is the pair of sums of these values
modulo 2**62, taken with two independent seeds (124 bits), so a prefix's digest is a running sum
along its conversation and its parent's is that sum less the last turn. The node table is verified
free of collisions: every digest must come with one parent digest and one last-turn value, or the
job stops with an error rather than merge two nodes.

Counts per node come from one aggregation by digest over all (conversation, depth) memberships,
partial per task before the shuffle, so a node every conversation passes through (the root, a
common first turn, many copies of one conversation) is summed in parts. Sums over a node's subtree
would need an accumulation through parents in depth order, one pass per level; they are taken in
closed form over members instead. Each node's smallest member owns it, and the depths a
conversation owns are one stretch ``f .. L`` of its own (members only shrink with depth), so

* children of v (depth d): members c with ``f(c) <= d + 1 <= L(c)``;
* leaves under v: members owning their own whole conversation as a childless node;
* ``saved_tokens`` of v, the sum over its subtree of ``(n_convs - 1) * words of the last text``:
  the sum over members of their words from turn d on, less those from ``max(d, f(c))`` on.

All of it is keyed aggregation, joins and windows over a conversation; the deepest conversation does
not add passes. ``ends_sha256`` is SHA-256 of the comma-joined decimal ids of members that end at
the node, ascending: a sequential digest, so each node's ending ids stream in order through one task
with a hash state (memory does not grow with them).

Defined results: null role or text is empty; words are ``[^\\x20\\x09-\\x0D]+``; turnless
conversations are members of the root alone; conversations with a null id take no part; an empty
table gives an empty result. Repeated conversations are members each. Very long texts are hashed and
counted by Spark, not held. Extra input columns are not carried.
"""

import hashlib

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from premia.storage import store

WORD = r"[^\x20\x09-\x0D]+"
_MOD = 1 << 62
_SEEDS = (7919, 104729)
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
_KEY = ["depth", "d1", "d2"]
HOT_SHARE = 1000


def turn_digests(turns):
    """``(conv_id, turn, role, text)`` rows as ``(conv_id, turn, c1, c2, words)``: two 64-bit
    digests of role and text and the number of words of the text. Texts are not needed after."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", *[F.xxhash64(F.lit(s), role, text).alias(f"c{i}")
                             for i, s in enumerate(_SEEDS, 1)],
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"))


def _mix(seed):
    return F.xxhash64(F.lit(seed), "pos", "c1", "c2").bitwiseAND(F.lit(_MOD - 1))


def memberships(turns, convs):
    """One row for each conversation and depth 0 .. L: its node's digest, its parent's, its words
    from that depth on (``rest``), and L. ``turns``: ``(conv_id, pos, c1, c2, words)`` with pos
    0 .. L - 1; ``convs``: every ``conv_id``, also those without turns."""
    by_conv = Window.partitionBy("conv_id")
    upto = by_conv.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = turns.select("conv_id", "pos", "words", _mix(_SEEDS[0]).alias("x1"),
                     _mix(_SEEDS[1]).alias("x2"))
    mod = F.lit(_MOD).cast("decimal(20,0)")
    for i in (1, 2):
        running = F.pmod(F.sum(F.col(f"x{i}").cast("decimal(20,0)")).over(upto), mod)
        t = t.withColumn(f"d{i}", running.cast("bigint"))
    t = t.select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "d1", "d2",
        *[F.pmod(F.col(f"d{i}") - F.col(f"x{i}"), F.lit(_MOD)).alias(f"p{i}") for i in (1, 2)],
        "x1",
        (F.sum("words").over(by_conv) - F.sum("words").over(upto) + F.col("words")).alias("rest"),
        F.count(F.lit(1)).over(by_conv).alias("length"))
    totals = turns.groupBy("conv_id").agg(F.sum("words").alias("rest"),
                                          F.count(F.lit(1)).alias("length"))
    roots = convs.select("conv_id").distinct().join(totals, "conv_id", "left").select(
        "conv_id", F.lit(0).cast("bigint").alias("depth"), *[F.lit(0).cast("bigint").alias(c) for c in
                                                            ("d1", "d2", "p1", "p2", "x1")],
        F.coalesce("rest", F.lit(0)).cast("bigint").alias("rest"),
        F.coalesce("length", F.lit(0)).cast("bigint").alias("length"))
    return t.unionByName(roots)


def nodes(members):
    """Per node: smallest member ``owner`` and greatest member length ``longest``, after checking
    that no two prefixes share a digest."""
    grouped = members.groupBy(*_KEY).agg(
        F.min("conv_id").alias("owner"), F.max("length").alias("longest"), F.count(F.lit(1)).alias("n"),
        *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("p1", "p2", "x1")])
    clash = F.lit(False)
    for c in ("p1", "p2", "x1"):
        clash = clash | (F.col(f"min_{c}") != F.col(f"max_{c}"))
    checked = F.when(clash, F.raise_error(F.lit("two prefixes share a digest"))).otherwise(
        F.col("owner"))
    return grouped.select(*_KEY, checked.alias("owner"), "longest", "n")


def with_owners(members):
    """``members`` with ``owner`` and ``longest`` of their node. Nodes with more than a
    ``1 / HOT_SHARE`` part of all memberships (the root, a common opening, many copies of one
    conversation) are at most HOT_SHARE rows: they are broadcast and met in every task; the others
    join by key, each with at most that part of the rows."""
    table = nodes(members)
    total = members.select(F.count(F.lit(1))).scalar()
    hot = table.where(F.col("n") * HOT_SHARE > total).select(
        *_KEY, F.col("owner").alias("hot_owner"), F.col("longest").alias("hot_longest"))
    tagged = members.join(F.broadcast(hot), _KEY, "left")
    warm = tagged.where(F.col("hot_owner").isNotNull()).select(
        *members.columns, F.col("hot_owner").alias("owner"), F.col("hot_longest").alias("longest"))
    cold = tagged.where(F.col("hot_owner").isNull()).select(*members.columns).join(
        table.where(F.col("n") * HOT_SHARE <= total).drop("n"), _KEY)
    return warm.unionByName(cold)


def trie(turns, convs):
    """The node table. ``turns``: ``(conv_id, pos, c1, c2, words)`` as ``turn_digests`` gives them,
    pos numbered 0 .. L - 1 within each conversation; ``convs``: all conversation ids.

    Returns per node ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (root: null),
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``, and the digest
    ``d1``, ``d2``."""
    # Read by four branches below: stored once rather than windowed four times.
    members = store(memberships(turns, convs), "trie-members")
    rows = with_owners(members)
    by_conv = Window.partitionBy("conv_id")
    # f: the first depth a conversation owns (length + 1 if none); its words from there on.
    first_owned = F.coalesce(F.min(F.when(F.col("owner") == F.col("conv_id"), F.col("depth")))
                             .over(by_conv), F.col("length") + 1)
    rows = rows.withColumn("f", first_owned)
    rows = rows.withColumn("rest_f", F.coalesce(F.max(
        F.when(F.col("depth") == F.col("f"), F.col("rest"))).over(by_conv), F.lit(0)))
    rows = rows.withColumn("parent_owner", F.lag("owner").over(by_conv.orderBy("depth")))
    leaf_owner = (F.col("depth") == F.col("length")) & (F.col("owner") == F.col("conv_id")) & (
        F.col("longest") == F.col("length"))
    owns_leaf = F.max(F.when(leaf_owner, 1).otherwise(0)).over(by_conv)
    rows = rows.select(
        *_KEY, "conv_id", "parent_owner",
        ((F.col("depth") + 1 <= F.col("length")) & (F.col("f") <= F.col("depth") + 1))
        .cast("bigint").alias("child"),
        owns_leaf.cast("bigint").alias("leaf"),
        F.when(F.col("depth") < F.col("f"), F.col("rest") - F.col("rest_f")).otherwise(0)
        .alias("saved"),
        (F.col("depth") == F.col("length")).alias("ends"))
    table = rows.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"), F.min("parent_owner").alias("parent_conv_id"),
        F.count(F.lit(1)).alias("n_convs"), F.sum("child").alias("n_children"),
        F.sum("leaf").alias("n_leaves"), F.sum("saved").cast("bigint").alias("saved_tokens"))
    ends = ending_digests(rows.where("ends").select(*_KEY, "conv_id"))
    return table.join(ends, _KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"), "d1", "d2")


def ending_digests(ends):
    """SHA-256 of each node's ending ids, ascending, comma-joined: rows of a node meet in one
    partition, sorted, and stream through a hash state batch by batch."""
    schema = "depth bigint, d1 bigint, d2 bigint, ends_sha256 string"
    ordered = ends.repartition(*_KEY).sortWithinPartitions(*_KEY, "conv_id")
    return ordered.mapInPandas(_stream_digests, schema)


def _stream_digests(batches):
    key, state, first = None, None, True
    for batch in batches:
        out = []
        for depth, d1, d2, conv in zip(batch["depth"].tolist(), batch["d1"].tolist(),
                                       batch["d2"].tolist(), batch["conv_id"].tolist()):
            if (depth, d1, d2) != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state, first = (depth, d1, d2), hashlib.sha256(), True
            state.update((str(conv) if first else f",{conv}").encode())
            first = False
        if out:
            yield pd.DataFrame(out, columns=["depth", "d1", "d2", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=["depth", "d1", "d2", "ends_sha256"])
