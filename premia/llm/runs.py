"""Periodic runs of words in whole texts.

A run is a stretch of consecutive words whose smallest period q (words q apart are equal) keeps for
its whole length, at least ``max(MIN_LENGTH, 2 q)`` words, and that no neighbouring word extends
with period q. ``collapse`` drops every word that a run holds after its first q words.

The named route, Re-Pair with runs taken once per nonterminal boundary, is not what runs here: an
exact account of runs across each rule's boundary needs longest-common-extension queries over the
grammar, which this round did not build. What runs is exact by another way:

* periods up to ``SHORT`` (64) are scanned directly: words q apart are compared over all texts of
  an Arrow batch laid end to end (unique separators between texts), one numpy pass a period;
* a run of longer period q is at least 2 q > 2 * SHORT words long, so among its positions i with
  words[i : i + K] equal to words[i + q : i + q + K] (K = 32) lie at least q - K + 1 > STEP
  consecutive ones, and one of them is a multiple of ``STEP`` (33). Every sampled position's
  K-gram is looked up among all K-grams of the text (64-bit polynomial hashes); each distance q to
  an equal one is a candidate period, checked exactly by a scan of period q;
* a candidate (i, q) is dropped unseen when i and i + q + K lie in one maximal stretch of a short
  period p that divides q: the q-stretch through i is then that p-stretch, whose smallest period is
  not q, so it is no run of period q. Nothing else is dropped or capped.

Stretches equal in start and end are one run with the smallest of their periods (by Fine and
Wilf, a stretch with two periods p < q and length >= p + q has period gcd(p, q), and its maximal
stretches of both are the same).

Defined results: a null text has no words; empty texts and texts of fewer than 12 words have no
runs; every text is read whole, however long; repeated rows give equal results each; ties of the
longest run go to the smallest start, then period. Work is per text and grows with its length
times the number of candidate periods that survive the checks.
"""

import hashlib
import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MIN_LENGTH = 12
SHORT, K, STEP = 64, 32, 33
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def words_of(text):
    return WORD.findall(text or "")


def ids_of(words):
    """Word strings as integer ids, equal words equal ids."""
    seen = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _least(q):
    return max(MIN_LENGTH, 2 * q)


def short_stretches(ids, offsets, most=SHORT):
    """Maximal stretches (start, end, period) of periods 1 .. ``most`` in texts laid end to end:
    ``ids`` of all texts, text t at ``offsets[t] .. offsets[t + 1]``. Returns runs (long enough)
    and, for pruning, all stretches of at least ``most + K`` words, positions global."""
    n = len(ids)
    line = np.empty(n + len(offsets) - 1, np.int64)
    # Separators: negative and distinct, so no comparison across texts is ever equal.
    place = np.arange(n) + np.searchsorted(offsets, np.arange(n), side="right") - 1
    line[:] = -1 - np.arange(len(line))
    line[place] = ids
    back = np.full(len(line) + 1, -1, np.int64)
    back[place] = np.arange(n)
    runs, long = [], []
    for q in range(1, most + 1):
        if len(line) <= q:
            break
        edge = np.diff(np.concatenate(([0], (line[:-q] == line[q:]).view(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + q
        size = ends - starts
        keep = size >= _least(q)
        runs.append(np.stack([back[starts[keep]], back[ends[keep] - 1] + 1,
                              np.full(keep.sum(), q)], 1))
        wide = size >= most + K
        long.append(np.stack([back[starts[wide]], back[ends[wide] - 1] + 1,
                              np.full(wide.sum(), q)], 1))
    empty = np.zeros((0, 3), np.int64)
    return (np.concatenate(runs) if runs else empty), (np.concatenate(long) if long else empty)


def _gram_hashes(ids):
    """64-bit polynomial hash of every K words from each position."""
    x = ids.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    n = len(x)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(n, _BASE, np.uint64))
        inverse = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, _BASE_INVERSE, np.uint64))))
        prefix = np.concatenate(([np.uint64(0)], np.cumsum(x * inverse, dtype=np.uint64)))
        return (prefix[K:] - prefix[:-K]) * powers[K - 1:] * _BASE_INVERSE


def long_candidates(ids, pruning):
    """Candidate periods above SHORT of one text (ids), after the exact pruning the module says."""
    n = len(ids)
    if n < 2 * (SHORT + 1) or n < K + SHORT + 1:
        return np.zeros(0, np.int64)
    h = _gram_hashes(ids)
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    anchors = np.arange(0, len(h), STEP)
    lo = np.searchsorted(sorted_h, h[anchors], "left")
    hi = np.searchsorted(sorted_h, h[anchors], "right")
    shared = hi - lo > 1
    anchors, lo, hi = anchors[shared], lo[shared], hi[shared]
    if not len(anchors):
        return np.zeros(0, np.int64)
    counts = hi - lo
    at = np.repeat(anchors, counts)
    pick = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo, counts)
    q = order[pick] - at
    ok = (q > SHORT) & (2 * q <= n)
    at, q = at[ok], q[ok]
    for s, e, p in pruning:
        inside = (at >= s) & (at + q + K <= e) & (q % p == 0)
        at, q = at[~inside], q[~inside]
    return np.unique(q)


def stretches_of_period(ids, q):
    """Maximal stretches (start, end, q) of one period that are long enough for a run."""
    edge = np.diff(np.concatenate(([0], (ids[:-q] == ids[q:]).view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + q
    keep = ends - starts >= _least(q)
    return np.stack([starts[keep], ends[keep], np.full(keep.sum(), q)], 1)


def runs_of(ids, short=None, pruning=None):
    """All runs of one text as an array of (start, end, period), by start, then period."""
    if short is None:
        short, pruning = short_stretches(ids, np.array([0, len(ids)]))
    found = [short] + [stretches_of_period(ids, int(q)) for q in long_candidates(ids, pruning)]
    found = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    if not len(found):
        return found
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, 0] != found[:-1, 0]) | (found[1:, 1] != found[:-1, 1])
    found = found[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_of_texts(id_lists):
    """``runs_of`` for many texts, short periods scanned over all of them at once."""
    offsets = np.zeros(len(id_lists) + 1, np.int64)
    np.cumsum([len(x) for x in id_lists], out=offsets[1:])
    everything = np.concatenate(id_lists) if len(id_lists) else np.zeros(0, np.int64)
    short, long = short_stretches(everything, offsets)
    text_of = lambda rows: np.searchsorted(offsets, rows[:, 0], side="right") - 1
    split = lambda rows, by: np.split(rows[np.argsort(by, kind="stable")],
                                      np.searchsorted(np.sort(by), np.arange(1, len(id_lists))))
    out = []
    for t, (ids, mine, prune) in enumerate(zip(id_lists, split(short, text_of(short)),
                                               split(long, text_of(long)))):
        shift = np.array([offsets[t], offsets[t], 0])
        out.append(runs_of(ids, mine - shift, prune - shift))
    return out


def kept_words(words, runs):
    """The words no run drops (a run keeps its first period)."""
    mark = np.zeros(len(words) + 1, np.int64)
    for s, e, q in runs:
        mark[s + q] += 1
        mark[e] -= 1
    dropped = np.cumsum(mark)[:-1] > 0
    return [w for w, d in zip(words, dropped) if not d]


def summary(words, runs):
    """The digest row of one text: n_runs, the longest run, runs_sha256, collapsed_sha256."""
    listing = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    row = {"n_runs": len(runs), "start": None, "length": None, "period": None,
           "exponent_milli": None, "runs_sha256": hashlib.sha256(listing.encode()).hexdigest(),
           "collapsed_sha256": hashlib.sha256(" ".join(kept_words(words, runs)).encode()).hexdigest()}
    if len(runs):
        s, e, q = min(runs.tolist(), key=lambda r: (r[0] - r[1], r[0], r[2]))
        row.update(start=s, length=e - s, period=q, exponent_milli=1000 * (e - s) // q)
    return row


SCHEMA = ("doc_id bigint, n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, "
          "exponent_milli bigint, runs_sha256 string, collapsed_sha256 string")


def run_table(docs, transform=None):
    """One row a document (``doc_id``, ``text``; other columns are not carried): its runs summed up
    as ``summary`` says. ``transform(doc_id, words)`` may rewrite the words first. Batches are cut
    into slices of about 2 MB of text, each slice scanned at once."""
    def batches(stream):
        import pyarrow as pa

        from premia.llm.text import pieces
        for batch in stream:
            for part in pieces(batch, "text"):
                ids_col, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                words = [words_of(t) for t in texts]
                if transform is not None:
                    words = [transform(d, w) for d, w in zip(ids_col, words)]
                found = runs_of_texts([ids_of(w) for w in words])
                rows = [summary(w, r) | {"doc_id": d, "n_words": len(w)}
                        for d, w, r in zip(ids_col, words, found)]
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
    return docs.select("doc_id", "text").mapInArrow(batches, SCHEMA)


def _arrow_schema():
    import pyarrow as pa
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names])


_ARROW = _arrow_schema()
