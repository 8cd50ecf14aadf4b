"""Toxicity and quality: held-out accuracy, gradients, the linear-time identity, odd inputs."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from premia.llm import quality, toxicity

SF_DIR = "/root/testdata/sf0.1"
SCHEMA = "doc_id bigint, text string, score string, label string, p_toxic string"
ODD = [(None, None), (1, ""), (1, ""), (2, "\n\n"), (3, "word " * 60_000), (4, "@#$% ^&*"), (5, None)]


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels")]


def odd(spark):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in ODD], SCHEMA)


def test_toxicity_held_out(spark, tables):
    docs, labels = tables
    model = toxicity.train(docs, labels, keep=~quality.held_out())
    assert (np.diff(model.thresholds) > 0).all()
    held = labels.where(quality.held_out()).join(docs, "doc_id").toPandas()
    chance = model.at_least(held["text"].tolist())
    assert (np.diff(chance, axis=1) <= 0).all()
    rejected, toxic = model.rejects(held["text"].tolist()), held["toxic"].to_numpy() == 1
    assert (rejected & toxic).sum() >= 0.8 * toxic.sum()
    assert (rejected & ~toxic).sum() <= 0.005 * (~toxic).sum()
    severity = model.severity(held["text"].tolist())
    assert severity[toxic].mean() > 1 and severity[~toxic].mean() < 0.1
    found = toxicity.severities(odd(spark), model).collect()
    assert [r.doc_id for r in found] == [r[0] for r in ODD]
    assert all(0 <= r.severity <= 2 for r in found)
    kept = toxicity.keep_clean(docs, model)
    assert kept.schema.names == docs.schema.names
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    gone = toxicity.severities(docs, model).where("rejected").select("doc_id").collect()
    assert not ids & {r.doc_id for r in gone}
    assert len(ids) + len(gone) == docs.count()


def test_toxicity_cut_keeps_its_rate():
    clean = np.random.default_rng(4).beta(1, 12, 200_000)
    cuts = [toxicity.rejection_cut(clean[:n]) for n in (2_000, 20_000, 200_000)]
    assert max(cuts) - min(cuts) < 0.06
    for n, cut in zip((2_000, 20_000, 200_000), cuts):
        assert 0 < (clean[:n] >= cut).mean() <= toxicity.FALSE_RATE
    assert abs(toxicity.rejection_cut(np.append(clean[:20_000], 1.0)) - cuts[1]) < 0.01
    assert toxicity.rejection_cut(clean[:100]) == toxicity.EVEN


def test_toxicity_gradient():
    rng = np.random.default_rng(3)
    total, t, y = rng.normal(size=6), np.array([-0.5, 1.0]), np.array([0, 1, 2, 0, 1, 2])

    def loss(total, t):
        edges = np.concatenate([np.zeros((6, 1)), 1 / (1 + np.exp(total[:, None] - t)),
                                np.ones((6, 1))], axis=1)
        return -np.log(edges[np.arange(6), y + 1] - edges[np.arange(6), y])

    pull, push = toxicity._gradient(total, t, y)
    assert np.allclose(pull, (loss(total + 1e-6, t) - loss(total - 1e-6, t)) / 2e-6, atol=1e-6)
    for j in range(2):
        step = np.eye(2)[j] * 1e-6
        assert np.allclose(push[:, j], (loss(total, t + step) - loss(total, t - step)) / 2e-6,
                           atol=1e-6)


def test_toxicity_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.train(odd(spark), empty) is None
    assert toxicity.keep_clean(odd(spark), None).count() == len(ODD)
    assert not any(r.rejected for r in toxicity.severities(odd(spark), None).collect())


def test_quality_held_out(spark, tables):
    docs, labels = tables
    model = quality.train(docs, labels)
    scored = quality.quality_scores(docs, model)
    held = scored.where(quality.held_out()).join(labels, "doc_id").toPandas()
    score, good = held["score"].to_numpy(), held["quality"].to_numpy() == 1
    assert ((score >= 0.5) == good).mean() > 0.97
    assert (held["predicted"] == (score >= 0.5)).all()
    assert scored.count() == docs.count()
    found = quality.quality_scores(odd(spark), model).collect()
    assert [r.doc_id for r in found] == [r[0] for r in ODD]
    assert all(0 <= r.score <= 1 for r in found)
    ids = [r.doc_id for r in docs.where(quality.held_out()).select("doc_id").limit(50).collect()]
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in ids)


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(2)
    factors, linear = rng.normal(size=(40, quality.FACTORS)), rng.normal(size=40)
    doc, feature = np.repeat(np.arange(5), 8), rng.integers(0, 40, 40)
    value = rng.normal(size=40)
    found, _ = quality.raw((doc, feature, value), 5, 0.3, linear, factors)
    for d in range(5):
        at = np.flatnonzero(doc == d)
        wanted = 0.3 + (linear[feature[at]] * value[at]).sum() + sum(
            factors[feature[a]] @ factors[feature[b]] * value[a] * value[b]
            for a in at for b in at if a < b)
        assert np.isclose(found[d], wanted)


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    scores = quality.quality_scores(odd(spark), quality.train(odd(spark), none)).collect()
    assert {round(r.score, 6) for r in scores} == {0.5}
    one = spark.createDataFrame([(k, 1) for k in (1, 2, 3, 4)] + [(None, 0), (5, None)],
                                "doc_id bigint, quality int")
    assert all(r.score > 0.5 for r in quality.quality_scores(
        odd(spark), quality.train(odd(spark), one)).collect())
    assert quality.quality_scores(odd(spark).where(F.lit(False)), quality.train(
        odd(spark), one)).count() == 0
