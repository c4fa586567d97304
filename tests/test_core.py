"""The core engine: oracle equality on the smallest tables, and units."""

import glob
import pathlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import scaling
from tidewatch.functions.amounts import parse_amount
from tidewatch.operators import outliers, sequences, truth
from tidewatch.plans.catalog import ORACLE, QUERIES
from tidewatch.plans.sufficiency import BLOCKED, DEGRADED, SUPPORTED, Holdings, verdicts
from tidewatch.sinks import archive, runs
from tidewatch.sources import views

SF = "/root/testdata/sf0.001"
QUICK = ["structuring", "structuring_banded", "benford", "benford_ks", "reciprocity", "scatter_gather", "degree_deviation", "network_oddball", "time_velocity",
         "burst", "time_correlation", "time_correlation_anypair", "parse_amounts", "source_counts", "distinct_events", "window_tumbling", "window_sliding",
         "parse_dates", "prose_fields", "key_value_lines", "json_field", "normalized_orders", "entity_resolution", "window_session",
         "event_sequences", "cross_source_entities", "truth_entities", "archive_verify", "archive_chain", "chart_source_counts", "chart_entity_daily",
         "sufficiency_verdicts", "evidence_trails", "display_names", "chain", "chain_deep", "insights_worded", "largest_per_party", "statml_kde", "statml_lof"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {pathlib.Path(path).stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_oracle(spark, duck, name):
    frames = [QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE[name]).df()]
    columns = sorted(frames[0].columns)
    assert columns == sorted(frames[1].columns)
    a, b = (f[columns].sort_values(columns).reset_index(drop=True).astype(object) for f in frames)
    pd.testing.assert_frame_equal(a.where(a.notna(), None), b.where(b.notna(), None), check_dtype=False, rtol=1e-9)


def test_amount_styles(spark):
    cases = {"ACCT-1001": None, "T512": None, "12abc34": None, "2024-01-09": None, "Rs 1,200": 1200.0, "₹ 99.5": 99.5, "(USD 5)": -5.0, "+3": 3.0, "-$4.20": -4.2, "1.5e3": 1500.0, "130.85000000000002": 130.85000000000002, "nil": None, "1,2345": 12345.0, "()": None, "$": None, "$1,234.50": 1234.5, "(99.10)": -99.1, "1.234,56 EUR": 1234.56, "12,50": 12.5, "1,234,567.89": 1234567.89, "12.345": 12345.0, "-7": -7.0, "n/a": None, "x": None, "": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["v"] for r in rows.select("t", parse_amount(rows.t).alias("v")).collect()} == cases


def test_quantile_against_numpy(spark):
    rng = np.random.default_rng(1)
    for values in (rng.lognormal(3, 3, 3000), np.repeat([1.0, 5.0], [2500, 500]), np.array([7.0]), np.concatenate([rng.normal(0, 1e-9, 2000), [1e12]]), np.array([1.0, 9.0] * 50)):
        rows = spark.createDataFrame(pd.DataFrame({"v": values}))
        for q in (0.0, 0.1, 0.5, 0.9, 0.99, 1.0):
            assert scaling.quantile(rows, "v", q, 16, 40) == pytest.approx(np.quantile(values, q), rel=1e-12)
    assert scaling.quantile(rows.where("v > 100"), "v", 0.5) is None


def test_density_models_in_cells(spark):
    """The same scores in one cell and in many."""
    events = views.events_view(spark, "/root/testdata/sf0.01")
    one, many = ({r["entity_id"]: r["score"] for r in outliers.kernel_density(events, points=size).collect()} for size in (20_000, 8))
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-9 for k in one)


def test_sequence_gradients():
    rng = np.random.default_rng(2)
    model, x = sequences.Recurrent(5, 4, 1), rng.uniform(0, 1, (6, 5, len(sequences.SIGNALS)))
    _, grads = model.gradients(x)
    for p, g in zip(model.params, grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        up, down = (model.gradients(x)[0] for p[at] in (old + 1e-5, old - 1e-5))
        p[at] = old
        assert (up - down) / 2e-5 == pytest.approx(g[at], rel=1e-4)


def test_sequence_autoencoder_marks_the_odd_one(spark):
    rng, rows = np.random.default_rng(4), []
    for e in range(60):
        at = pd.Timestamp("2024-01-01")
        for i in range(12):
            at += pd.Timedelta(hours=float(rng.uniform(1, 3)) if e else float(rng.choice([0.01, 95.0])))
            rows.append((e * 100 + i, e, at, float(rng.uniform(90, 110)) if e else 9e6, "transaction"))
    events = spark.createDataFrame(pd.DataFrame(rows, columns=["event_id", "entity_id", "timestamp", "amount", "event_type"])).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    scores = {r["entity_id"]: r["score"] for r in sequences.lstm_autoencoder(events, 16, 8).collect()}
    assert max(scores, key=scores.get) == 0 and len(scores) == 60
    assert sequences.lstm_autoencoder(events.limit(0)).count() == 0


def test_answer_key_of_a_file(spark, tmp_path):
    (tmp_path / "key.json").write_text('{"entities": {"p1": {"person_type": "storyline", "account": "A1", "phone": "555"}, "p2": {"name": "Cruz Maria"}, "p3": {"name": "maria cruzz", "handle": "@no"}, "p4": {}}, "meta": {}}')
    key = truth.read_key(spark, f"file://{tmp_path}/key.json")
    assert {r["person"]: r["person_type"] for r in key.collect()} == {"p1": "storyline", "p2": "background", "p3": "background", "p4": "background"}
    mapping = spark.createDataFrame([("A1", "E:A1"), ("555", "E:555"), ("Z", "E:Z")], "identifier string, entity_id string")
    named = spark.createDataFrame([("Maria Cruz", "E:Z"), (None, "E:A1")], "name string, entity_id string")
    got = {tuple(r) for r in truth.to_entities(key, mapping, named).collect()}
    assert got == {("p1", "E:A1"), ("p1", "E:555"), ("p2", "E:Z"), ("p3", "E:Z")}


def test_changed_manifest_breaks_the_chain(spark, tmp_path):
    root = f"file://{tmp_path}"
    for run in ("r1", "r2"):
        runs.save_run(spark, root, run, {"t": spark.range(3)})
    assert {r["run_id"]: r["ok"] for r in runs.verify_chain(spark, root).collect()} == {"r1": True, "r2": True}
    changed = spark.read.parquet(f"{root}/manifest/run_id=r1").withColumn("sha256", F.sha2(F.col("sha256").cast("binary"), 256)).collect()
    spark.createDataFrame(changed, "path string, sha256 string").write.mode("overwrite").parquet(f"{root}/manifest/run_id=r1")
    assert {r["run_id"]: r["ok"] for r in runs.verify_chain(spark, root).collect()} == {"r1": False, "r2": True}


def test_verdicts():
    full = Holdings(10_000, 100, frozenset({"bank", "cdr"}), True, True, True)
    assert set(verdicts(full).values()) == {SUPPORTED}
    bank = verdicts(Holdings(10_000, 100, frozenset({"bank"}), True, True, True))
    assert bank["time_correlation"] == bank["network"] == DEGRADED and bank["benford"] == SUPPORTED
    assert verdicts(Holdings(100, 100, frozenset({"bank"}), True, True, True))["benford"] == BLOCKED
    assert verdicts(Holdings(5000, 50, frozenset({"social"}), True, True, False))["network"] == BLOCKED


def test_archive(spark):
    files = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], "path string, content binary")
    sealed = archive.seal(files)
    later = spark.createDataFrame([("a", bytearray(b"1")), ("c", bytearray(b"3"))], "path string, content binary")
    assert {r["path"]: r["status"] for r in archive.verify(sealed, later).collect()} == {"a": "ok", "b": "MISSING", "c": "EXTRA"}
