"""Settings: read, written, and each of them moving what it is meant to move."""

import dataclasses
import json

import pytest

from tidewatch.plans import config
from tidewatch.sources import detect

yaml = pytest.importorskip("yaml")

#: Measures of a column with no pattern at all.
PLAIN = dict.fromkeys(["epoch", "phone", "date", "money", "fraction", "marker", "median", "huge", "place", "id", "whole", "top", "words", "at"], 0.0) | {"n": 9, "distinct": 9}


def test_files(tmp_path):
    path = str(tmp_path / "c.yaml")
    assert config.read(path) == config.settings() and config.settings().keys() == config.SETTINGS.keys()
    for empty in ("", "pipeline:", "other: {top_k: 1}"):
        (tmp_path / "c.yaml").write_text(empty)
        assert config.read(path) == config.settings()
    (tmp_path / "c.yaml").write_text("pipeline: {top_k: 3, probe_id_ratio: 0.5, unknown: 1}")
    got = config.read(path)
    assert got == config.settings(top_k=3, probe_id_ratio=0.5)
    config.write(got, path)
    assert config.read(path) == got
    with pytest.raises(KeyError):
        config.settings(top=3)


@pytest.mark.parametrize(("name", "low", "high", "column", "slot"), [
    ("probe_date_parse_ratio", 0.5, 0.9, {"date": 0.8}, "timestamp"),
    ("probe_phone_ratio", 0.5, 0.9, {"phone": 0.8}, "counterparty"),
    ("probe_id_ratio", 0.5, 0.9, {"id": 0.8}, "counterparty"),
    ("probe_numeric_ratio", 0.5, 0.9, {"money": 0.8, "median": 500.0}, "amount"),
    ("probe_amount_frac_ratio", 0.2, 0.5, {"money": 1.0, "fraction": 0.4}, "amount"),
    ("probe_amount_marker_ratio", 0.2, 0.5, {"money": 1.0, "marker": 0.4}, "amount"),
    ("probe_amount_integer_median", 10.0, 99.0, {"money": 1.0, "median": 50.0}, "amount"),
    ("probe_big_code_magnitude", 10.0, 99.0, {"whole": 1.0, "top": 50.0}, "event_type"),
])
def test_probe_settings_act(name, low, high, column, slot):
    probed = lambda value: detect.probe(PLAIN | column, config.thresholds(config.settings(**{name: value})))
    assert probed(low)[0] == slot and probed(high) is None


def test_places_and_names_go_by_no_setting():
    every = config.thresholds(config.settings(probe_id_ratio=0.99, probe_phone_ratio=0.99))
    assert detect.probe(PLAIN | {"place": 0.8}, every)[0] == "location"
    assert dataclasses.asdict(config.thresholds(config.settings())) == dataclasses.asdict(detect.Thresholds())


def test_run_by_settings(spark, tmp_path):
    """Generated files, screened under settings that move models and report."""
    chosen = config.settings(data_dir=f"file://{tmp_path}/data", seeds=[7], report_dir=f"{tmp_path}/report", top_k=2, with_models=False)
    made = config.generate(spark, chosen, background=12, per_story=1, surprise=0)
    assert [p.rpartition("/")[2] for p in made] == ["bank_csv", "cdr_csv", "social_csv"]
    folder = tmp_path / "sources"
    folder.mkdir()
    spark.read.option("header", True).csv(made[0]).toPandas().to_csv(folder / "bank.csv", index=False)
    chosen["sources_dir"] = f"file://{folder}"
    run, files = config.run(spark, chosen)
    assert run.ranking is None and files == [] and run.events.count() > 0
    one = config.models(config.settings(tol_minutes=5, structuring_threshold=400.0))
    assert one["time_correlation"].keywords == {"tolerance_minutes": 5} and one["structuring"].keywords == {"threshold": 400.0}
    chosen |= {"with_models": True, "min_events_per_entity": 1}
    few = {k: v for k, v in config.models(chosen).items() if k in ("structuring", "benford")}
    found = config.screening.screen(spark, [chosen["sources_dir"]], models=few, **config.used_by(chosen, "screen"))
    told = json.loads(open(config.screening.save(found, **config.used_by(chosen, "report"))[0], encoding="utf-8").read())
    assert len(told["rankings"]) == 2
