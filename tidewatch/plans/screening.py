"""From files to a ranked report: load, detect, normalise, resolve, gate, score,
fuse, explain. Stages are DataFrame plans; lineage is cut once, before the
models read the events many times."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.lineage import cut
from tidewatch.operators import digits, fusion, graph, insights, outliers, resolution, rules, temporal
from tidewatch.plans.sufficiency import BLOCKED, holdings, verdicts
from tidewatch.sinks import report
from tidewatch.sources import detect, loaders

Model = Callable[[DataFrame], DataFrame]
#: The models of the default run, by gated stage.
MODELS: dict[str, Model] = {
    "time_correlation": temporal.time_correlation, "network": graph.oddball, "statml": outliers.isolation_forest, "benford": digits.benford,
    "structuring": rules.structuring, "behavioral": rules.behavioral, "chain": rules.chain,
}


@dataclass(frozen=True)
class Run:
    events: DataFrame
    verdicts: dict[str, str]
    scores: DataFrame | None
    ranking: DataFrame | None
    evidence: DataFrame
    sources: list[dict]


def ingest(
    spark: SparkSession, paths: list[str], mode: str = "hybrid", thresholds: detect.Thresholds = detect.Thresholds()
) -> tuple[DataFrame, list[dict]]:
    """(resolved events, source registry) of all supported files below ``paths``.
    Rows that are equal in every column count once, across files and formats; the
    registry tells how many rows each file gave before that."""
    parts, registry = [], []
    for file in loaders.collect_files(spark, paths):
        loaded = loaders.load_any(spark, file)
        found = detect.detect_columns(loaded.df, mode, thresholds)
        source = detect.classify_source(found)
        rows, said = detect.normalize(loaded.df, found, source)
        parts.append(rows.withColumn("file", F.lit(len(parts))))
        registry.append({"file": file, "source": source, "format": loaded.format, "slots": sorted({r.slot for r in found}),
                         "warnings": [*([loaded.warning] if loaded.warning else []), *said]})
    if not parts:
        raise ValueError(f"no supported files below {paths}")
    rows = cut(reduce(DataFrame.unionByName, parts))
    counts = {r["file"]: r["count"] for r in rows.groupBy("file").count().collect()}
    for i, entry in enumerate(registry):
        entry["rows"] = counts.get(i, 0)
    keyed = cut(rows.drop("file").dropDuplicates().withColumn("event_id", F.xxhash64(*detect.EVENT_COLUMNS)))
    return cut(resolution.apply(keyed, resolution.resolve(keyed))), registry


def screen(
    spark: SparkSession, paths: list[str], least_events: int = 30, fuse: str = "borda", models: dict[str, Model] | None = None,
    thresholds: detect.Thresholds = detect.Thresholds(),
) -> Run:
    """Run all models that the data support; blocked ones are not planned. Without
    ``models`` it is the default ones, with none of them evidence alone."""
    events, registry = ingest(spark, paths, thresholds=thresholds)
    allowed = verdicts(holdings(events), least_events)
    ready = {name: op(events) for name, op in (MODELS if models is None else models).items() if allowed.get(name) != BLOCKED}
    evidence = insights.build_insights(events)
    if not ready:
        return Run(events, allowed, None, None, evidence, registry)
    scores = cut(fusion.stack(ready))
    ranked = fusion.ranking(events, scores, fusion.FUSIONS[fuse](scores))
    return Run(events, allowed, scores, ranked, evidence, registry)


def save(run: Run, folder: str, k: int = report.TOP) -> list[str]:
    """Report files of a run that ranked something, of its ``k`` best."""
    if run.ranking is None:
        raise ValueError("every model was blocked; nothing to report")
    return report.write(report.payload(run.ranking, run.scores, run.evidence, run.verdicts, run.sources, run.events, k), folder)
