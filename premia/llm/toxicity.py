"""Toxicity as ordinal regression with cumulative links over sparse terms.

A text has grade 0 (clean), 1 or 2. P(grade <= j) = sigmoid(t_j - w x): one weight a feature shared
by the ordered thresholds t_0 < t_1; x holds terms and their beginnings (so that inflected forms
count together), each by the root of its part of all terms. The labels only tell toxic or not; the
upper grade are the toxic texts with a larger part of tell-tale features than the median toxic one.
Weights are fitted with AdaGrad and a soft threshold, so that terms that tell nothing weigh
nothing, in numpy on a bounded sample (``SAMPLE`` labelled documents, the first by hash of id). A
fifth of the sample is kept out of the fit and sets the chance from which a text is rejected: the
least that at most ``FALSE_RATE`` of its clean texts reach, or ``EVEN`` where they are too few to
tell that rate.

Nulls count as empty texts; a text without known terms gets the thresholds' own grade; without
labels of both kinds nothing is rejected; an empty table gives an empty result; repeated rows
give repeated rows; ``keep_clean`` keeps all columns, whatever their names.
"""

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa

from premia.llm.labelled import in_parts, sample, score_rows
from premia.llm.text import SMALL_BYTES, pieces, prefix_hashes

SAMPLE = 6_000
BUCKETS = 1 << 20
GRADES = 3
FALSE_RATE = 0.002
EVEN = 0.5
PREFIXES = (4, 5, 6, 7, 8, 9)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = EVEN

    def rejects(self, texts):
        return self.at_least(texts)[:, 0] >= self.cut

    def at_least(self, texts):
        """P(grade >= j) for j = 1, 2, ... as columns."""
        doc, term, part = features(texts)
        total = np.bincount(doc, self.weights[term] * _value(part), len(texts))
        return _sigmoid(total[:, None] - self.thresholds)

    def severity(self, texts):
        """Expected grade."""
        return self.at_least(texts).sum(axis=1)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def features(texts):
    """Text number, feature and part of the text's terms that have it, in text order."""
    doc, hashes = prefix_hashes(texts, PREFIXES)
    keys, counts = np.unique(doc * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64),
                             return_counts=True)
    found = keys // BUCKETS
    words = np.bincount(doc, minlength=len(texts)) / (1 + len(PREFIXES))
    return found, keys % BUCKETS, counts / words[found]


def _narrow(texts):
    doc, term, part = features(texts)
    return doc.astype(np.int32), term.astype(np.int32), part.astype(np.float32)


def _value(part):
    return 10 * np.sqrt(part)


def tell_tale(doc, term, toxic, least=3):
    """Terms at least six times as frequent in toxic texts, as a mask over buckets."""
    hits = np.bincount(term[toxic[doc] == 1], minlength=BUCKETS)
    rest = np.bincount(term[toxic[doc] == 0], minlength=BUCKETS)
    n1, n0 = max(1, (toxic == 1).sum()), max(1, (toxic == 0).sum())
    return (hits >= least) & ((hits + 0.1) / n1 > 6 * (rest + 0.5) / n0)


def grades(doc, term, part, toxic):
    """0 for clean; 1, or 2 where tell-tale features are denser than in the median toxic text."""
    density = np.bincount(doc, part * tell_tale(doc, term, toxic)[term], len(toxic))
    middle = np.median(density[toxic == 1])
    return np.where(toxic == 1, 1 + (density > middle), 0)


def fit(texts, toxic, epochs=40, rate=0.1, soft=1e-3, batch=256, seed=3):
    """A model of labelled texts, or None if one of the labels is missing."""
    toxic = np.asarray(toxic)
    if len(np.unique(toxic)) < 2:
        return None
    doc, term, part = in_parts(texts, _narrow)
    y = grades(doc, term, part, toxic)
    frequent = np.bincount(term, minlength=BUCKETS) >= 4
    known, kept = np.flatnonzero(frequent), frequent[term]
    place = np.cumsum(frequent, dtype=np.int32) - 1
    doc, column, x = doc[kept], place[term[kept]], _value(part[kept])
    starts = np.searchsorted(doc, np.arange(len(texts) + 1))
    w, seen = np.zeros(len(known)), np.full(len(known), 1e-6)
    share = np.array([(y >= j).mean() for j in range(1, GRADES)]).clip(1e-4, 1 - 1e-4)
    t = np.log((1 - share) / share)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
            sizes = starts[part + 1] - starts[part]
            at = np.repeat(starts[part] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            row = np.repeat(np.arange(len(part)), sizes)
            total = np.bincount(row, w[column[at]] * x[at], len(part))
            pull, push = _gradient(total, t, y[part])
            g = np.bincount(column[at], pull[row] * x[at], len(known)) / len(part)
            seen += g * g
            step = rate / np.sqrt(seen)
            w -= step * g
            w = np.sign(w) * np.maximum(0, np.abs(w) - step * soft)
            t = np.sort(t - 0.5 * push.mean(axis=0))
    weights = np.zeros(BUCKETS)
    weights[known] = w
    return Model(weights.astype(np.float32), t)


def _gradient(total, t, y):
    """Slopes of -log P(grade = y) along the total and along each threshold."""
    edges = np.concatenate([np.zeros((len(y), 1)), _sigmoid(t - total[:, None]),
                            np.ones((len(y), 1))], axis=1)
    slope = edges * (1 - edges)
    row = np.arange(len(y))
    chance = np.maximum(1e-9, edges[row, y + 1] - edges[row, y])
    push = np.zeros((len(y), len(t)))
    for j in range(len(t)):
        push[:, j] = ((y == j + 1) * slope[row, y] - (y == j) * slope[row, y + 1]) / chance
    return (slope[row, y + 1] - slope[row, y]) / chance, push


def train(docs, labels, most=SAMPLE, keep=None):
    rows = sample(docs, labels, "toxic", most, keep).toPandas().sort_values("doc_id")
    texts, toxic = rows["text"].tolist(), rows["label"].to_numpy()
    model = fit([t for k, t in enumerate(texts) if k % 5], toxic[np.arange(len(toxic)) % 5 > 0])
    clean = [t for k, t in enumerate(texts) if k % 5 == 0 and not toxic[k]]
    if model is None or not clean:
        return model
    chance = in_parts(clean, lambda part: (np.arange(len(part)), model.at_least(part)[:, 0]))[1]
    return replace(model, cut=rejection_cut(chance))


def rejection_cut(clean):
    """The least chance that at most FALSE_RATE of the chances of clean texts reach."""
    if len(clean) * FALSE_RATE < 1:
        return EVEN
    above = int(len(clean) * FALSE_RATE)
    return float(np.nextafter(np.sort(clean)[-1 - above], np.inf, dtype=np.float64))


def severities(docs, model, id_column="doc_id", text_column="text"):
    """doc_id, p_toxic, p_severe, severity (expected grade) and rejected of every row."""
    def score(texts):
        if model is None:
            none = np.zeros(len(texts))
            return none, none, none, none > 0
        chance = model.at_least(texts).astype(np.float64)
        return chance[:, 0], chance[:, 1], chance.sum(axis=1), chance[:, 0] >= model.cut

    return score_rows(docs, score, (("p_toxic", "double"), ("p_severe", "double"),
                                    ("severity", "double"), ("rejected", "boolean")),
                      id_column, text_column)


def keep_clean(docs, model, text_column="text"):
    """All rows and columns of ``docs`` that the model does not reject."""
    at = docs.schema.names.index(text_column)

    def keep(batches):
        for batch in batches:
            for piece in pieces(batch, at, SMALL_BYTES):
                texts = [t or "" for t in piece.column(at).to_pylist()]
                yield piece.filter(pa.array(~model.rejects(texts)))

    return docs if model is None else docs.mapInArrow(keep, docs.schema)
