"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are sets of word shingles; two are linked if they share at least ``threshold`` of the
shingles of either. Texts alike are one text with a number of copies.

1. A MinHash signature per text, made in the scan. Bands of ``ROWS`` values of it give buckets; a
   pair at the threshold misses all ``BANDS`` buckets with probability 6e-7.
2. Buckets of one text are dropped, and of buckets with the same members all but one.
3. Members of a bucket are cut into blocks; a task compares two blocks. A pair is handled in the
   first bucket it shares. Its signature values are compared ``STEP`` at a time; after each step a
   pair leaves if, from a flat prior, the probability that its similarity reaches the threshold
   is under ``TOLERANCE``. All that stay are verified on their whole shingle sets.
4. A task returns, for each of its texts, the links it found and one edge to the least text it is
   joined with, never the pairs. Components over these edges give the classes.

Shingle sets are made again only for texts that share a bucket; texts are never shuffled. Nulls count as empty texts; texts without
words have the one shingle of no words and are alike; repeated rows are copies; an empty table
gives an empty result. ``keep_one`` keeps all columns, whatever their names.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from premia.llm.components import components
from premia.llm.groups import by_group
from premia.llm.text import SMALL_BYTES, mix, pieces, shingles_of
from premia.storage import store

THRESHOLD = 0.8
BANDS, ROWS, SIGNATURE, STEP = 20, 3, 64, 16
TOLERANCE = 1e-7
BLOCK = 512
BITS = 1 << 23
_TILE = 128
_RNG = np.random.default_rng(99)
_SPREAD = _RNG.integers(1, 2**63, SIGNATURE, np.uint64) * np.uint64(2) + np.uint64(1)
_TURN = _RNG.integers(1, 2**63, SIGNATURE, np.uint64)


def signatures(hashes, offsets):
    """A row of SIGNATURE minima of 32-bit values for each set of shingles."""
    out = np.empty((len(offsets) - 1, SIGNATURE), np.uint32)
    for j in range(SIGNATURE):
        value = ((hashes ^ _TURN[j]) * _SPREAD[j]) >> np.uint64(32)
        out[:, j] = np.minimum.reduceat(value, offsets[:-1])
    return out


def bands(signature):
    """A key for each band: the same only for texts that agree on all rows of the band."""
    keys = np.empty((len(signature), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(signature), b + 1, np.uint64)
        for j in range(b * ROWS, (b + 1) * ROWS):
            key = mix(key ^ signature[:, j].astype(np.uint64)) + np.uint64(j)
        keys[:, b] = key
    return keys.view(np.int64)


def least_matches(threshold, tolerance=TOLERANCE):
    """For each number of compared values the matches a pair needs to stay.

    With a flat prior and m of n matches the similarity follows Beta(m + 1, n - m + 1); that it is
    at least the threshold is the chance of at most m successes in n + 1 trials.
    """
    need = {}
    for n in range(STEP, SIGNATURE + 1, STEP):
        chance, need[n] = 0.0, n + 1
        for m in range(n + 1):
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if chance >= tolerance:
                need[n] = m
                break
    return need


def digest(text_column):
    """128 bits of the text as two numbers."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    return F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), F.md5(text))


def texts(docs, text_column="text"):
    """Distinct texts: t1, t2 (digest), copies and band keys."""
    t1, t2 = digest(text_column)
    chosen = docs.select(t1.alias("t1"), t2.alias("t2"),
                         F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def sign(batches):
        for batch in batches:
            for piece in pieces(batch, "text", SMALL_BYTES):
                keys = bands(signatures(*shingles_of(piece.column("text").to_pylist())))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("t1"), piece.column("t2"), pa.array(list(keys))],
                    ["t1", "t2", "bands"])

    signed = chosen.mapInArrow(sign, "t1 bigint, t2 bigint, bands array<bigint>")
    return store(signed.groupBy("t1", "t2").agg(F.count("*").alias("copies"),
                                                F.first("bands").alias("bands")), "join-texts")


def buckets(distinct):
    """(key, size) of the buckets to search: two members at least, each set of members once."""
    member = distinct.select("t1", "t2", F.explode("bands").alias("key"))
    sized = member.groupBy("key").agg(
        F.count("*").alias("size"), F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"),
        F.sum(F.col("t1").bitwiseAND(F.lit(2**31 - 1))).alias("s1")).where("size > 1")
    return sized.groupBy("size", "x1", "x2", "s1").agg(F.min("key").alias("key"))


def _members(docs, distinct, text_column):
    """Texts that share a bucket, with their buckets, their signature and their shingle set."""
    kept = store(buckets(distinct).select("key", "size"), "join-buckets")
    placed = store(distinct.select("t1", "t2", "copies", F.explode("bands").alias("key"))
                   .join(kept, "key")
                   .groupBy("t1", "t2").agg(
                       F.first("copies").alias("copies"),
                       F.sort_array(F.collect_list(F.struct("key", "size"))).alias("buckets")),
                   "join-placed")
    t1, t2 = digest(text_column)
    rows = docs.select(t1.alias("t1"), t2.alias("t2"),
                       F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    hit = docs.sparkSession.sparkContext.broadcast(_bitmap(placed))

    def shingle(batches):
        for batch in batches:
            maybe = hit.value[batch.column("t1").to_numpy() % BITS]
            for piece in pieces(batch.filter(pa.array(maybe)), "text", SMALL_BYTES):
                hashes, offsets = shingles_of(piece.column("text").to_pylist())
                signed = signatures(hashes, offsets)
                sets = [np.unique(hashes[a:b]).tobytes()
                        for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("t1"), piece.column("t2"),
                     pa.array([s.tobytes() for s in signed], pa.binary()),
                     pa.array(sets, pa.binary())], ["t1", "t2", "signature", "shingles"])

    sets = (rows.mapInArrow(shingle, "t1 bigint, t2 bigint, signature binary, shingles binary")
            .dropDuplicates(["t1", "t2"]))
    return store(placed.join(sets, ["t1", "t2"]), "join-members")


def _bitmap(placed):
    """BITS marks, however many texts there are: which values of t1 modulo BITS are placed.

    It only spares texts that share no bucket the way to the exact join.
    """
    place = F.pmod("t1", F.lit(BITS))
    words = (placed.select(F.floor(place / 32).alias("word"), (place % 32).cast("int").alias("bit"))
             .groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("marks")).toPandas())
    marks = np.zeros(BITS // 32, np.uint32)
    marks[words["word"].to_numpy(np.int64)] = words["marks"].to_numpy(np.int64)
    return np.unpackbits(marks.view(np.uint8), bitorder="little").astype(bool)


def links(docs, text_column="text", threshold=THRESHOLD):
    """(t1, t2, copies) of all texts, and (t1, t2, r1, r2, texts, docs) of those with links.

    ``texts`` and ``docs`` are the linked other texts and the rows that have them; r1, r2 is a
    text of the same class. A text has such a row for each task that found links of it.
    """
    distinct = texts(docs, text_column)
    members = _members(docs, distinct, text_column)
    cut = F.ceil(F.col("bucket.size") / BLOCK).cast("int")
    dealt = (
        members.withColumn("bucket", F.explode("buckets"))
        .withColumn("cuts", cut)
        .withColumn("own", F.pmod(F.xxhash64("t1", "t2"), F.col("cuts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .select("t1", "t2", "copies", "signature", "shingles", "own",
                F.col("buckets.key").alias("keys"), F.col("bucket.key").alias("key"),
                F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")))
    need = least_matches(threshold)

    def compare(frame):
        return _compare(frame, need, threshold)

    block = ["key", "low", "high"]
    found = by_group(dealt.repartition(*block), block, compare,
                     "t1 bigint, t2 bigint, r1 bigint, r2 bigint, texts bigint, docs bigint")
    return distinct.select("t1", "t2", "copies"), store(found, "join-found")


def _compare(frame, need, threshold):
    frame = frame.sort_values(["t1", "t2"], ignore_index=True)
    n, own = len(frame), frame["own"].to_numpy()
    key, across = frame["key"].iloc[0], frame["low"].iloc[0] != frame["high"].iloc[0]
    signed = np.frombuffer(b"".join(frame["signature"]), np.uint32).reshape(n, SIGNATURE)
    sets = [np.frombuffer(s, np.uint64) for s in frame["shingles"]]
    earlier = {}
    for row, keys in enumerate(frame["keys"]):
        for k in keys:
            if k < key:
                earlier.setdefault(k, []).append(row)
    earlier = [np.array(rows) for rows in earlier.values() if len(rows) > 1]
    copies = frame["copies"].to_numpy()
    near, rows, root = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
    for left in range(0, n, _TILE):
        seen = [(_within(members, left), members) for members in earlier]
        seen = [pair for pair in seen if len(pair[0])]
        for right in range(left, n, _TILE):
            a, b = np.arange(left, min(n, left + _TILE)), np.arange(right, min(n, right + _TILE))
            pending = a[:, None] < b[None, :]
            if across:
                pending &= own[a][:, None] != own[b][None, :]
            for inside, members in seen:
                pending[np.ix_(inside, _within(members, right))] = False
            i, j = np.nonzero(pending)
            i, j = a[i], b[j]
            matches = np.zeros(len(i), np.int64)
            for done in range(0, SIGNATURE, STEP):
                matches += (signed[i, done:done + STEP] == signed[j, done:done + STEP]).sum(axis=1)
                stay = matches >= need[done + STEP]
                i, j, matches = i[stay], j[stay], matches[stay]
            i, j = _verified(i, j, sets, threshold)
            for x, y in ((i, j), (j, i)):
                near += np.bincount(x, minlength=n)
                rows += np.bincount(x, copies[y], n).astype(np.int64)
            _unite(root, i, j)
    linked = np.flatnonzero(near)
    tops = root[linked]
    return pd.DataFrame({
        "t1": frame["t1"].to_numpy()[linked], "t2": frame["t2"].to_numpy()[linked],
        "r1": frame["t1"].to_numpy()[tops], "r2": frame["t2"].to_numpy()[tops],
        "texts": near[linked], "docs": rows[linked]})


def _within(members, start):
    """Places of the members that lie in the tile from ``start``."""
    return members[slice(*np.searchsorted(members, [start, start + _TILE]))] - start


def _unite(root, i, j):
    """Point every row at the least row it is joined with, given one more set of pairs."""
    while True:
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        if (low == high).all():
            return
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root[:] = root[root]


def _verified(i, j, sets, threshold):
    """The pairs that reach the threshold, from whole sets."""
    if len(i) <= 256:
        shared = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                           for x, y in zip(i, j)], np.int64)
    else:
        left, right = np.unique(i), np.unique(j)
        common = np.intersect1d(np.concatenate([sets[x] for x in left]),
                                np.concatenate([sets[y] for y in right]))
        one, other = _incidence(left, sets, common), _incidence(right, sets, common)
        shared = np.zeros((len(left), len(right)))
        for part in range(0, len(common), 65_536):
            shared += one(part, part + 65_536) @ other(part, part + 65_536).T
        shared = shared[np.searchsorted(left, i), np.searchsorted(right, j)].astype(np.int64)
    sizes = np.array([len(s) for s in sets])
    either = sizes[i] + sizes[j] - shared
    kept = shared >= threshold * either - 1e-9 * either
    return i[kept], j[kept]


def _incidence(members, sets, common):
    def block(start, end):
        part = common[start:end]
        out = np.zeros((len(members), len(part)), np.float32)
        for row, m in enumerate(members):
            out[row, np.isin(part, sets[m], assume_unique=True)] = 1
        return out
    return block


def classes(docs, id_column="doc_id", text_column="text", threshold=THRESHOLD):
    """One row a document: doc_id, class_id (least id of the class), n_links, n_text_links.

    ``n_links`` counts the other rows whose text is the same or linked, ``n_text_links`` the
    linked other texts.
    """
    labelled = _labelled(docs, text_column, threshold)
    t1, t2 = digest(text_column)
    rows = docs.select(F.col(id_column).alias("doc_id"), t1.alias("t1"), t2.alias("t2"))
    rows = store(rows.join(labelled, ["t1", "t2"]), "join-rows")
    named = rows.groupBy("r1", "r2").agg(F.min("doc_id").alias("class_id"))
    return rows.join(named, ["r1", "r2"]).select(
        "doc_id", "class_id", (F.col("docs") + F.col("copies") - 1).alias("n_links"),
        F.col("texts").alias("n_text_links"))


def _labelled(docs, text_column, threshold):
    """Every text with its links and a text that stands for its class."""
    distinct, found = links(docs, text_column, threshold)
    node = F.struct("t1", "t2")
    joined = components(found.select(
        node.alias("a"), F.struct(F.col("r1").alias("t1"), F.col("r2").alias("t2")).alias("b")))
    counted = found.groupBy("t1", "t2").agg(F.sum("texts").alias("texts"),
                                            F.sum("docs").alias("docs"))
    roots = joined.select("node.*", F.col("root.t1").alias("r1"), F.col("root.t2").alias("r2"))
    zero = F.lit(0).cast("bigint")
    return store(
        distinct.join(counted, ["t1", "t2"], "left").join(roots, ["t1", "t2"], "left")
        .select("t1", "t2", "copies", F.coalesce("texts", zero).alias("texts"),
                F.coalesce("docs", zero).alias("docs"), F.coalesce("r1", "t1").alias("r1"),
                F.coalesce("r2", "t2").alias("r2")), "join-labelled")


def keep_one(docs, id_column="doc_id", text_column="text", threshold=THRESHOLD):
    """All columns of one row a class: the least id, then the first by content.

    Only the digests of classes' first rows meet the documents; rows alike in all columns are
    told apart by number within their own small group.
    """
    labelled = _labelled(docs, text_column, threshold)
    t1, t2 = digest(text_column)
    content = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    mark = F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"),
                    t1.alias("t1"), t2.alias("t2"), content.alias("content"))
    rows = docs.select(F.struct("*").alias("row"), mark.alias("mark"))
    first = (rows.select("mark").join(
        labelled.select(F.col("t1").alias("a"), F.col("t2").alias("b"), "r1", "r2"),
        (F.col("mark.t1") == F.col("a")) & (F.col("mark.t2") == F.col("b")))
        .groupBy("r1", "r2").agg(F.min("mark").alias("mark")).select("mark"))
    kept = rows.join(store(first, "join-first"), "mark", "left_semi")
    one = F.row_number().over(W.partitionBy("mark").orderBy("mark"))
    return kept.withColumn("nth", one).where("nth = 1").select("row.*")
