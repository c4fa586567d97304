"""Evaluation snapshots: the quality of one run as JSON and Markdown."""

from __future__ import annotations

import json
import pathlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import evaluation
from tidewatch.operators.fusion import top_k


def collect(ranked: DataFrame, scores: DataFrame, truth: DataFrame, verdicts: dict[str, str], held: str = "surprise", k: int = 10) -> dict:
    """A payload of bounded size: figures at 5 and k, recall by kind, the first k
    entities, and how many each model scored."""
    figures: dict[str, dict] = {"main": {}, "held": {}}
    for r in evaluation.by_part(ranked, truth, held, (5, k)).collect():
        figures[r["part"]] |= {f"recall@{r['k']}": r["recall"], f"precision@{r['k']}": r["precision"]}
    kinds = {r["kind"]: r["recall"] for r in evaluation.type_recall(ranked, truth.where(F.col("kind") != held), k).collect()}
    counts = {r["part"]: r["n"] for r in truth.groupBy((F.col("kind") == held).alias("part")).agg(F.count_distinct("entity_id").alias("n")).collect()}
    return {
        "anomalies": counts.get(False, 0), "held_mapped": counts.get(True, 0), "figures": figures, f"type_recall@{k}": kinds, "sufficiency": verdicts,
        "n_entities": ranked.count(), "top": [r.asDict() for r in top_k(ranked, k).collect()],
        "model_scores_n": {r["model"]: r["count"] for r in scores.groupBy("model").count().orderBy("model").collect()},
    }


def markdown(found: dict) -> str:
    lines = ["# Evaluation snapshot", "", f"- anomalies: {found['anomalies']}, of {found['n_entities']} entities; held out: {found['held_mapped']}"]
    lines += [f"- {part}: " + ", ".join(f"{name} {value:.3f}" for name, value in sorted(values.items())) for part, values in found["figures"].items()]
    lines += ["", "| rank | entity | score | models |", "|-|-|-|-|"]
    lines += [f"| {i} | {r['entity_id']} | {r['score']} | {r['models_fired'] or ''} |" for i, r in enumerate(found["top"], 1)]
    return "\n".join(lines) + "\n"


def write(found: dict, folder: str) -> list[str]:
    """eval.json and eval.md in a driver-side folder."""
    at = pathlib.Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    (at / "eval.json").write_text(json.dumps(found, indent=1, default=str), "utf-8")
    (at / "eval.md").write_text(markdown(found), "utf-8")
    return [str(at / "eval.json"), str(at / "eval.md")]
