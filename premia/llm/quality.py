"""Quality classifier: a factorisation machine over terms, structure statistics and metadata.

A text is a sparse vector: its hashed terms, each of equal weight, and for every statistic of its
structure and for its length (the metadata) the bin that the value falls in. The score is the
sigmoid of

    b + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2],

all pairwise interactions in time linear in the features. It is trained with AdaGrad in numpy on a
bounded sample (``SAMPLE`` labelled documents, the first by hash of id). Language, source, id and
labels are no features.

Nulls count as empty texts, which have a score like any other; without labels of both kinds every
score is the share of good labels (0.5 without labels); an empty table gives an empty result;
repeated rows give repeated rows; other columns are not read.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from premia.llm.labelled import in_parts, sample, score_rows, terms
from premia.llm.text import joined_bytes, shingle_hashes, word_hashes

SAMPLE = 6_000
BUCKETS = 1 << 16
FACTORS = 8
BINS = 12

_UPPER, _DIGIT, _MARK, _ODD, _LINE = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = _DIGIT[48:58] = _LINE[10] = True
_MARK[[ord(c) for c in ".,;:!?'\"()-"]] = True
_ODD[33:127] = True
_ODD[48:58] = _ODD[65:91] = _ODD[97:123] = False
_ODD &= ~_MARK
STATISTICS = ("chars", "words", "word length", "upper", "digits", "marks", "symbols", "lines",
              "distinct words", "word repeats", "distinct shingles", "rare shapes")


def structure(texts):
    """One row of STATISTICS a text; parts are of its bytes or of its words."""
    data, offsets = joined_bytes(texts)
    size = np.maximum(1, np.diff(offsets) - 1)
    part = lambda mask: np.add.reduceat(mask[data].astype(np.int64), offsets[:-1])
    hashes, words_at = word_hashes(texts)
    words = np.diff(words_at)
    some = np.maximum(1, words)
    doc = np.repeat(np.arange(len(texts)), words)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    shingles, at = shingle_hashes(hashes, words_at)
    odd = part(_ODD)
    return np.column_stack([
        np.log1p(size), np.log1p(words), size / some, part(_UPPER) / size, part(_DIGIT) / size,
        part(_MARK) / some, odd / some, (part(_LINE) - 1) / some,
        _distinct(hashes, words_at) / some, np.bincount(doc, again, len(texts)) / some,
        _distinct(shingles, at) / np.diff(at), odd / size])


def _distinct(values, offsets):
    return np.array([len(np.unique(values[a:b])) for a, b in zip(offsets[:-1], offsets[1:])])


@dataclass(frozen=True)
class Model:
    edges: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, texts):
        return _sigmoid(raw(features(texts, self.edges), len(texts), self.bias, self.linear,
                            self.factors)[0])


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def features(texts, edges):
    """(document, feature, value) in document order: terms first, then the bins."""
    doc, term, _ = terms(texts, BUCKETS)
    value = 1 / np.sqrt(np.maximum(1, np.bincount(doc, minlength=len(texts))))[doc]
    found = structure(texts)
    bins = np.column_stack([np.searchsorted(edges[s], found[:, s], side="right")
                            for s in range(len(edges))])
    binned = BUCKETS + np.arange(len(edges)) * BINS + bins
    row = np.repeat(np.arange(len(texts)), len(edges))
    every = np.concatenate([doc, row])
    order = np.argsort(every, kind="stable")
    return (every[order], np.concatenate([term, binned.ravel()])[order],
            np.concatenate([value, np.ones(len(row))])[order])


def raw(found, n, bias, linear, factors):
    """The machine's sum for each of n documents, and sum_i v_if x_i."""
    doc, feature, value = found
    scaled = factors[feature] * value[:, None]
    starts = np.searchsorted(doc, np.arange(n))
    sums = np.add.reduceat(scaled, starts, axis=0)
    squares = np.add.reduceat(scaled * scaled, starts, axis=0)
    return (bias + np.bincount(doc, linear[feature] * value, n)
            + 0.5 * (sums * sums - squares).sum(axis=1)), sums


def fit(texts, good, epochs=12, rate=0.15, batch=128, decay=1e-5, seed=5):
    good = np.asarray(good, np.float64)
    if len(np.unique(good)) < 2:
        share = good.mean() if len(good) else 0.5
        flat = np.full((len(STATISTICS), BINS - 1), np.inf)
        return Model(flat, float(np.log((share + 1e-3) / (1 - share + 1e-3))),
                     np.zeros(BUCKETS + BINS * len(STATISTICS)),
                     np.zeros((BUCKETS + BINS * len(STATISTICS), FACTORS)))
    rng = np.random.default_rng(seed)
    stats = in_parts(texts, lambda part: (np.arange(len(part)), structure(part)))[1]
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    doc, feature, value = in_parts(texts, lambda part: features(part, edges))
    starts = np.searchsorted(doc, np.arange(len(texts) + 1))
    size = BUCKETS + BINS * len(STATISTICS)
    linear, factors = np.zeros(size), rng.normal(0, 0.05, (size, FACTORS))
    bias = float(np.log(good.mean() / (1 - good.mean())))
    seen_l, seen_f = np.full(size, 1e-4), np.full((size, FACTORS), 1e-2)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
            sizes = starts[part + 1] - starts[part]
            at = np.repeat(starts[part] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            row, f, x = np.repeat(np.arange(len(part)), sizes), feature[at], value[at]
            total, sums = raw((row, f, x), len(part), bias, linear, factors)
            slope = (_sigmoid(total) - good[part]) / len(part)
            used, place = np.unique(f, return_inverse=True)
            g = np.bincount(place, slope[row] * x, len(used)) + decay * linear[used]
            each = (slope[row] * x)[:, None] * (sums[row] - factors[f] * x[:, None])
            h = np.column_stack([np.bincount(place, each[:, k], len(used))
                                 for k in range(FACTORS)]) + decay * factors[used]
            seen_l[used] += g * g
            seen_f[used] += h * h
            linear[used] -= rate * g / np.sqrt(seen_l[used])
            factors[used] -= 0.3 * rate * h / np.sqrt(seen_f[used])
            bias -= 0.1 * rate * slope.sum()
    return Model(edges, bias, linear.astype(np.float32), factors.astype(np.float32))


def held_out(doc_id="doc_id"):
    """A third of the ids, never trained on."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def train(docs, labels, most=SAMPLE):
    rows = sample(docs, labels, "quality", most, ~held_out()).toPandas().sort_values("doc_id")
    return fit(rows["text"].tolist(), rows["label"].to_numpy())


def quality_scores(docs, model, id_column="doc_id", text_column="text"):
    """doc_id, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts):
        found = shared.value.scores(texts).astype(np.float64)
        return found, (found >= 0.5).astype(np.int32)

    return score_rows(docs, score, (("score", "double"), ("predicted", "int")), id_column,
                      text_column)
