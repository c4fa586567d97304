"""Settings of a screening run, and a run by its settings.

Every setting is one row of ``SETTINGS``: where it goes and what it is there.
Reading, writing and running all go by that table, so none is read in vain.
"""

from __future__ import annotations

from functools import partial
from pathlib import Path

from pyspark.sql import SparkSession

from tidewatch.operators import rules, temporal
from tidewatch.plans import screening
from tidewatch.sources import synthetic
from tidewatch.sources.detect import Thresholds

SECTION = "pipeline"

# The names and defaults of a settings file, each with its user and
# what it is called there. A name that is not listed has no effect.
SETTINGS: dict[str, tuple[object, str, str]] = {
    "data_dir": ("data", "generate", "folder"),
    "sources_dir": ("data/sources", "input", "folder"),
    "report_dir": ("data/report", "report", "folder"),
    "top_k": (10, "report", "k"),
    "min_events_per_entity": (30, "screen", "least_events"),
    "tol_minutes": (30, "time_correlation", "tolerance_minutes"),
    "structuring_threshold": (10_000.0, "structuring", "threshold"),
    "with_models": (True, "models", "run"),
    "seeds": ([42, 99], "generate", "seeds"),
    "probe_date_parse_ratio": (0.9, "probe", "dates"),
    "probe_phone_ratio": (0.7, "probe", "phones"),
    "probe_numeric_ratio": (0.9, "probe", "numbers"),
    "probe_id_ratio": (0.7, "probe", "ids"),
    "probe_amount_frac_ratio": (0.3, "probe", "fractions"),
    "probe_amount_marker_ratio": (0.5, "probe", "markers"),
    "probe_big_code_magnitude": (10_000.0, "probe", "code"),
    "probe_amount_integer_median": (100.0, "probe", "median"),
}

Settings = dict[str, object]


def settings(**given: object) -> Settings:
    """All settings: those given over the defaults. Unknown names are an error."""
    if unknown := given.keys() - SETTINGS.keys():
        raise KeyError(f"no such settings: {sorted(unknown)}")
    return {name: given.get(name, default) for name, (default, _, _) in SETTINGS.items()}


def read(path: str) -> Settings:
    """A file's settings; names it does not share with the table are passed over,
    and a missing file is all defaults."""
    import yaml

    file = Path(path)
    held = yaml.safe_load(file.read_text("utf-8")) if file.exists() else None
    return settings(**{k: v for k, v in ((held or {}).get(SECTION) or {}).items() if k in SETTINGS})


def write(chosen: Settings, path: str) -> None:
    import yaml

    Path(path).write_text(yaml.safe_dump({SECTION: chosen}, sort_keys=False), "utf-8")


def used_by(chosen: Settings, user: str) -> dict[str, object]:
    """The arguments of one user of settings."""
    return {argument: chosen[name] for name, (_, of, argument) in SETTINGS.items() if of == user}


def thresholds(chosen: Settings) -> Thresholds:
    """What the content probe goes by."""
    return Thresholds(**used_by(chosen, "probe"))


def models(chosen: Settings) -> dict[str, screening.Model]:
    """The models of a run, two of them with settings of their own."""
    if not used_by(chosen, "models")["run"]:
        return {}
    own = {
        "time_correlation": partial(temporal.time_correlation, **used_by(chosen, "time_correlation")),
        "structuring": partial(rules.structuring, **used_by(chosen, "structuring")),
    }
    return screening.MODELS | own


def run(spark: SparkSession, chosen: Settings) -> tuple[screening.Run, list[str]]:
    """(run, report files) over the sources folder; no report if nothing was ranked."""
    source = used_by(chosen, "input")["folder"]
    found = screening.screen(spark, [source], models=models(chosen), thresholds=thresholds(chosen), **used_by(chosen, "screen"))
    return found, screening.save(found, **used_by(chosen, "report")) if found.ranking is not None else []


def generate(spark: SparkSession, chosen: Settings, **sizes: int) -> list[str]:
    """The exports of a made-up population for each seed, as CSV folders below the
    data folder; header styles take turns."""
    at, made = used_by(chosen, "generate"), []
    for i, seed in enumerate(at["seeds"]):
        rows = synthetic.events(synthetic.people(spark, seed, **sizes), seed)
        for source, table in synthetic.exports(rows, i % 3).items():
            made.append(f"{at['folder']}/{seed}/{source}_csv")
            table.write.mode("overwrite").option("header", True).csv(made[-1])
    return made
