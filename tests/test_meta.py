"""Learned fusion: folds, average precision, no leak of labels, saved models."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import meta
from tidewatch.plans import model_queries

QUICK = meta.Learners(trees=10, forest_depth=3, rounds=3, boost_depth=2)


@pytest.fixture(scope="module")
def known(spark):
    """Two models and a feature that tell 20 of 120 entities apart, not quite."""
    rng = random.Random(5)
    scores, features = [], []
    for e in range(120):
        bad = e % 6 == 0
        scores.append(("one", e, min(1.0, max(0.0, rng.gauss(0.7 if bad else 0.3, 0.15)))))
        if e % 4:
            scores.append(("two", e, rng.random()))
        features.append((e, rng.lognormvariate(3 if bad else 2, 1), rng.random()))
    truth = [(e,) for e in range(0, 120, 6)]
    return (
        spark.createDataFrame(scores, "model string, entity_id long, score double"),
        spark.createDataFrame(features, "entity_id long, amt_mean double, hour_entropy double"),
        spark.createDataFrame(truth, "entity_id long"),
    )


def test_folds_are_stratified(spark):
    rows = spark.range(103).select(F.col("id").alias("entity_id"), (F.col("id") % 9 == 0).cast("double").alias("label"))
    counts = {(r["label"], r["fold"]): r["count"] for r in meta.dealt(rows, 4).groupBy("label", "fold").count().collect()}
    for label in (0.0, 1.0):
        sizes = [counts[label, f] for f in range(4)]
        assert max(sizes) - min(sizes) <= 1


def _precision(rows):
    total, hits = 0.0, sum(y for _, y in rows)
    for p in sorted({p for p, _ in rows}):
        above = [y for q, y in rows if q >= p]
        total += sum(y for q, y in rows if q == p) * sum(above) / len(above)
    return total / hits


def test_average_precision(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 30) / 30, float(rng.random() < 0.3)) for _ in range(200)]
    assert meta.average_precision(spark.createDataFrame(rows, "p double, label double")) == pytest.approx(_precision(rows))
    assert meta.average_precision(spark.createDataFrame([(0.5, 0.0)], "p double, label double")) == 0


def test_fit_save_load(spark, known, tmp_path):
    scores, features, truth = known
    found = meta.fit(scores, features, truth, QUICK, 3)
    held = {r["entity_id"]: r["score"] for r in found.held.collect()}
    assert len(held) == 120 and set(found.precision) == {"forest", "boosted"} and max(found.precision.values()) > 0.5
    path = f"file://{tmp_path}/model"
    assert {r["entity_id"] for r in meta.apply_saved(scores, features, path).collect()} == set(held)  # points: none is saved
    meta.save(found.model, path)
    own = {r["entity_id"]: r["score"] for r in meta.apply(found.model, scores, features).collect()}
    back = {r["entity_id"]: r["score"] for r in meta.apply_saved(scores, features, path).collect()}
    assert own == back and own != held
    # A model that is missing counts as silent.
    assert meta.apply_saved(scores.where("model = 'one'"), features, path).count() == 120


def test_own_label_does_not_count(spark, known):
    """An entity that nothing but its label tells from 59 others is not found: it
    scores as they do, whichever of them is labelled."""
    scores = spark.createDataFrame([("one", e, 0.9 if e < 12 else 0.1) for e in range(72)], "model string, entity_id long, score double")
    features = spark.createDataFrame([(e, 1.0) for e in range(72)], "entity_id long, amt_mean double")
    truth = spark.createDataFrame([(e,) for e in (0, 1, 2, 3, 4, 5, 6, 40)], "entity_id long")
    got = {r["entity_id"]: r["score"] for r in meta.learned(scores, features, truth, QUICK, 3).collect()}
    assert min(got[e] for e in range(12)) > max(got[e] for e in range(12, 72))
    assert got[40] <= max(got[e] for e in range(41, 72)) + 1e-9


def test_too_little_falls_back_to_points(known):
    scores, features, truth = known
    few = meta.learned(scores, features, truth.limit(1), QUICK)
    assert few.count() == 120 and few.columns == ["entity_id", "score"]


def test_fits_share_tasks_whatever_the_settings(spark, known, monkeypatch):
    """A fit takes one task for each ``SHARE`` entities, none is made in vain, and
    scores don't depend on how shuffles are cut."""
    seen = []
    for kind in (meta.RandomForestClassifier, meta.GBTClassifier):
        monkeypatch.setattr(kind, "_fit", lambda self, rows, plain=kind._fit: seen.append(rows.rdd.getNumPartitions()) or plain(self, rows))
    held = {}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in ("3", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            held[n] = {r["entity_id"]: r["score"] for r in meta.learned(*known, QUICK, 2).collect()}
        assert held["3"] == held["7"] and len(held["3"]) == 120
        assert seen == [1] * 8
        monkeypatch.setattr(meta, "SHARE", 50)
        assert meta.fit(*known, QUICK, 2).held.count() == 120 and seen[8:] == [3] * 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_learned_query_makes_features_once(spark, monkeypatch):
    sf, made, given = "/root/testdata/sf0.001", [], []
    plain = model_queries.features.build_features
    want = model_queries.QUERIES["statml_zscore"](spark, sf).collect()
    monkeypatch.setattr(model_queries.features, "build_features", lambda events: made.append(1) or plain(events))
    monkeypatch.setattr(model_queries.meta, "learned", lambda scores, feats, truth: given.append(feats) or scores.where("model = 'statml_zscore'").drop("model"))
    got = model_queries.QUERIES["fusion_learned"](spark, sf).collect()
    assert len(made) == 1 and sorted(got) == sorted(want) and given[0].count() == len(want)
