"""Run reports: a payload of bounded size, as JSON, Markdown and HTML."""

from __future__ import annotations

import html
import json
import pathlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import insights

TOP = 20
#: Records of an entity that a report lists.
TRAIL = 25


def top_scores(scores: DataFrame, k: int = TOP) -> DataFrame:
    """(model, entity_id, score, place): each model's k best."""
    place = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("score"), "entity_id"))
    return scores.withColumn("place", place).where(F.col("place") <= k)


def payload(ranked: DataFrame, scores: DataFrame, evidence: DataFrame, verdicts: dict[str, str], sources: list[dict], events: DataFrame, k: int = TOP) -> dict:
    """What a report tells: at most k entities, k scores a model, and of those
    entities the evidence and the first records."""
    best = ranked.orderBy(F.desc("score"), "entity_id").limit(k)
    people = [r.asDict() for r in best.collect()]
    shown = evidence.join(F.broadcast(best.select("entity_id")), "entity_id", "left_semi")
    for person in people:
        person["evidence"] = []
    by_id = {p["entity_id"]: p["evidence"] for p in people}
    for r in shown.orderBy("entity_id", "kind").collect():
        by_id[r["entity_id"]].append({"kind": r["kind"], "detail": r["detail"]})
    trails = {p["entity_id"]: p.setdefault("trail", []) for p in people}
    own = events.join(F.broadcast(best.select("entity_id")), "entity_id", "left_semi")
    for r in insights.trails(own, cap=TRAIL).orderBy("entity_id", "place").collect():
        trails[r["entity_id"]].append({c: r[c] for c in ("timestamp", "source", "counterparty_id", "amount")})
    models: dict[str, dict] = {}
    for r in top_scores(scores, k).orderBy("model", "place").collect():
        models.setdefault(r["model"], {})[str(r["entity_id"])] = r["score"]
    records, entities = events.agg(F.count("*"), F.count_distinct("entity_id")).first()
    summary = {"records": records, "entities": entities, "files": len(sources), "shown": len(people)}
    return {"summary": summary, "sufficiency": verdicts, "sources": sources, "model_scores": models, "rankings": people}


def _table(head: list[str], rows: list[list]) -> list[str]:
    cell = lambda x: str(x).replace("|", "\\|").replace("\n", " ")
    return ["| " + " | ".join(head) + " |", "|" + "-|" * len(head), *("| " + " | ".join(map(cell, r)) + " |" for r in rows), ""]


def _sections(p: dict) -> list[tuple[str, list[str], list[list]]]:
    said = lambda person: "; ".join(f"{e['kind']} {e['detail']}" for e in person["evidence"]) or "none"
    return [
        ("Summary", ["What", "Count"], [list(kv) for kv in p["summary"].items()]),
        ("What the data could support", ["Stage", "Verdict"], [list(kv) for kv in p["sufficiency"].items()]),
        ("Entities that stand out", ["Entity", "Score", "Risk", "Events", "Models", "Evidence"],
         [[r["entity_id"], r["score"], r["risk"], r["n_events"], r["models_fired"] or "", said(r)] for r in p["rankings"]]),
        ("Records behind them", ["Entity", "Time", "Source", "Counterparty", "Amount"],
         [[r["entity_id"], *("" if x is None else x for x in t.values())] for r in p["rankings"] for t in r["trail"]]),
        ("Sources", ["File", "Source", "Rows", "Warnings"], [[s["file"], s["source"], s["rows"], "; ".join(s["warnings"])] for s in p["sources"]]),
    ]


def markdown(p: dict) -> str:
    return "\n".join(["# Risk report", "", *(line for name, head, rows in _sections(p) for line in [f"## {name}", "", *_table(head, rows)])])


def page(p: dict) -> str:
    """The same tables as one HTML page, all text escaped."""
    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape(str(c))}</{tag}>" for c in cells) + "</tr>"
    body = "".join(f"<h2>{name}</h2><table>{row(head, 'th')}{''.join(row(r, 'td') for r in rows)}</table>" for name, head, rows in _sections(p))
    return f"<!doctype html><meta charset=utf-8><title>Risk report</title><h1>Risk report</h1>{body}"


def write(p: dict, folder: str) -> list[str]:
    """report.json, report.md and report.html in a driver-side folder."""
    at = pathlib.Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    made = {"report.json": json.dumps(p, indent=1, default=str, ensure_ascii=False), "report.md": markdown(p), "report.html": page(p)}
    for name, text in made.items():
        (at / name).write_text(text, encoding="utf-8")
    return [str(at / name) for name in made]
