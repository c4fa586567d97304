"""Generated tables, comparisons and saved runs."""

import json
import pathlib

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import evaluation, fusion, rules, temporal
from tidewatch.plans import research
from tidewatch.sinks import runs, snapshot
from tidewatch.sources import detect, synthetic


@pytest.fixture(scope="module")
def made(spark):
    who = synthetic.people(spark)
    return who, synthetic.events(who).persist()


def test_generation_repeats_and_plants(spark, made):
    who, rows = made
    again = synthetic.events(synthetic.people(spark))
    assert rows.exceptAll(again).count() == 0 and rows.count() == again.count()
    assert rows.select("event_id").distinct().count() == rows.count()
    kinds = {r["kind"]: r["count"] for r in synthetic.truth(who).groupBy("kind").count().collect()}
    assert kinds == dict.fromkeys(synthetic.STORIES, 3)
    assert synthetic.truth(who, True).count() == 12 and who.count() == 123


def test_models_find_their_storylines(made):
    who, rows = made
    of = lambda story: {r["entity_id"] for r in synthetic.truth(who, None).where(F.col("kind") == story).collect()}
    head = lambda df, k: {r["entity_id"] for r in fusion.top_k(df, k).collect()}
    assert head(rules.structuring(rows), len(of("structuring"))) == of("structuring")
    assert len(head(temporal.burst(rows), 8) & of("post_burst")) >= 3
    assert of("dormant_flip") <= {r["entity_id"] for r in rules.behavioral(rows).collect()}
    assert of("silence") <= {r["entity_id"] for r in rules.behavioral(rows).collect()}
    assert {r["entity_id"] for r in rules.chain(rows).collect()} & of("chain")


@pytest.mark.parametrize("style", [0, 1, 2])
def test_exports_are_detected(made, style):
    for source, df in synthetic.exports(made[1], style).items():
        found = detect.detect_columns(df)
        slots = {r.slot for r in found}
        assert detect.classify_source(found) == source and {"timestamp", "counterparty"} <= slots


def test_detection_modes(made):
    df = synthetic.exports(made[1], 0)["bank"]
    want = {"txn_date": "timestamp", "amount": "amount", "beneficiary": "counterparty"}
    got = {r["mode"]: r for r in research.detection_modes([(df, want), (df.withColumnRenamed("txn_date", "c1"), {"c1": "timestamp"})])}
    assert got["header"]["recall"] == 0.75 and got["hybrid"]["recall"] == 1.0 and got["hybrid"]["rescued"] == 1


def test_substitution(spark):
    """Entities 0 and 1 are true; only the candidate ranks both first."""
    rows = [(m, e, s) for m, scores in {"good": [0.9, 0.8, 0.2, 0.1], "bad": [0.1, 0.2, 0.8, 0.9], "rest": [0.5, 0.4, 0.3, 0.2]}.items() for e, s in enumerate(scores)]
    scores = spark.createDataFrame(rows, "model string, entity_id long, score double").coalesce(1)
    truth = spark.createDataFrame([(0, "a"), (1, "a")], "entity_id long, kind string")
    got = {r["candidate"]: r["hits"] for r in research.substitution(scores, truth, ["rest", "bad"], "bad", ["good"], 2, fusion.score_mean).collect()}
    assert got == {"bad": 0, "good": 2}


def test_saved_runs(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert runs.list_runs(spark, root).count() == 0
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    first = runs.save_run(spark, root, "r1", {"ranking": table})
    second = runs.save_run(spark, root, "r2", {"ranking": table.where("id = 1")}, note="again")
    assert first != second
    with pytest.raises(ValueError):
        runs.save_run(spark, root, "r2", {"ranking": table})
    assert [r["run_id"] for r in runs.list_runs(spark, root).collect()] == ["r2", "r1"]
    assert sorted(map(tuple, runs.load_run(spark, root, "r1", ["ranking"])["ranking"].collect())) == [(1, "a"), (2, "b")]
    states = lambda run: {r["status"] for r in runs.verify_run(spark, root, run).collect()}
    assert states("r1") == states("r2") == {"ok"} and all(r["ok"] for r in runs.verify_chain(spark, root).collect())
    part = next(p for p in pathlib.Path(tmp_path, "files/r2/ranking").glob("part-*") if p.stat().st_size)
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    part.write_text('{"id":9,"x":"z"}\n')
    assert "MISMATCH" in states("r2")
    assert runs.delete_run(spark, root, "r1") and not runs.delete_run(spark, root, "r1")
    assert states("r1") == {"MISSING"} and [r["run_id"] for r in runs.list_runs(spark, root).collect()] == ["r2"]


def test_snapshot(spark, tmp_path):
    ranked = spark.createDataFrame([(i, 1 - i / 20, "a,b" if i < 3 else None) for i in range(20)], "entity_id long, score double, models_fired string")
    scores = spark.createDataFrame([("a", i, 0.5) for i in range(20)] + [("b", 1, 0.5)], "model string, entity_id long, score double")
    truth = spark.createDataFrame([(0, "chain"), (7, "fan"), (15, "fan"), (1, "surprise")], "entity_id long, kind string")
    found = snapshot.collect(ranked, scores, truth, {"benford": "BLOCKED"})
    assert found["figures"]["main"] == {"recall@5": 0.3333, "precision@5": 0.2, "recall@10": 0.6667, "precision@10": 0.2}
    assert found["figures"]["held"] == {"recall@5": 1.0, "precision@5": 0.2, "recall@10": 1.0, "precision@10": 0.1}
    assert found["type_recall@10"] == {"chain": 1.0, "fan": 0.5} and found["model_scores_n"] == {"a": 20, "b": 1}
    paths = snapshot.write(found, str(tmp_path / "s"))
    assert json.loads(open(paths[0], encoding="utf-8").read())["anomalies"] == 3
    assert "| 2 | 1 | 0.95 | a,b |" in open(paths[1], encoding="utf-8").read()


def test_mode_means(spark):
    rows = [("easy", "d1", "borda", 0.5), ("easy", "d2", "borda", 1.0), ("easy", "d2", "meta", None), ("hard", "d3", "meta", 0.25)]
    table = spark.createDataFrame(rows, "mode string, dataset string, fusion string, recall double")
    assert sorted(map(tuple, evaluation.mode_means(table).collect())) == [("easy", "borda", 2, 0.75), ("hard", "meta", 1, 0.25)]
