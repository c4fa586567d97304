"""Registered queries for comparisons of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import rules
from tidewatch.plans import research, sampling
from tidewatch.plans.model_queries import _SCORES_SQL, _TRUTH_SQL, EV, _scores, _truth
from tidewatch.sources.views import EVENTS_SQL, LEDGER_SQL, events_view, ledger_view, table


def _bands(spark: SparkSession, sf: str) -> DataFrame:
    """Structuring with other bands and thresholds."""
    settings = {"threshold": EV["threshold"], "band": 0.8}
    grid = {"band": [0.7, 0.8, 0.9], "threshold": [300.0, 400.0]}
    return research.sweep(events_view(spark, sf), rules.structuring, settings, grid, _truth(spark, sf))


def _band_sql(parameter: str, value: float, threshold: float, band: float) -> str:
    low = f"amount >= {band}::DOUBLE * {threshold}::DOUBLE AND amount < {threshold}"
    return f"""SELECT '{parameter}' AS parameter, {value}::DOUBLE AS value, count(*) AS hits, round(count(*) / greatest((SELECT count(*) FROM tr), 1)::DOUBLE, 4) AS recall
FROM (SELECT entity_id FROM (SELECT entity_id, round(raw / max(raw) OVER (), 6) AS score FROM (SELECT entity_id, pow(count(*) FILTER ({low}), 1.5) / sqrt(count(*)) AS raw
  FROM ev WHERE source = 'bank' AND amount IS NOT NULL GROUP BY 1 HAVING count(*) FILTER ({low}) > 0)) ORDER BY score DESC, entity_id LIMIT 10) WHERE entity_id IN (SELECT entity_id FROM tr)"""


#: Sign-ups and errors are the kinds of cases among events.
_QUOTAS = sampling.Quotas(per_kind=6, rows=40, context=5, active=50, total=1500)


def _strata(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    rows = events_view(spark, sf).select("event_id", F.col("entity_id").alias("account"), F.col("counterparty_id").alias("other"), kind.alias("kind"), kind.isin("signup", "error").alias("labelled"))
    return sampling.stratified(rows, _QUOTAS)


_STRATA_SQL = sampling.stratified_sql(
    f"""{EVENTS_SQL}, rw AS (SELECT event_id, entity_id AS account, counterparty_id AS other, event_type AS kind, event_type IN ('signup', 'error') AS labelled FROM ev)""", _QUOTAS
)

QUERIES = {
    "research_sample_strata": _strata,
    "research_model_matrix": lambda spark, sf: research.model_matrix(_scores(spark, sf), _truth(spark, sf)),
    "research_sweep": _bands,
    "research_sample_accounts": lambda spark, sf: research.sample_accounts(ledger_view(spark, sf).select("event_id", "entity_id", "direction"), "entity_id", ["event_id"], F.col("direction") == "credit", 5),
    "research_overlap": lambda spark, sf: research.overlap(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")), "k"),
}

_K = "k AS (SELECT unnest([5, 10, 20])::INT AS k), p AS (SELECT count(*) AS p FROM tr)"
_MATRIX = """{names}, count(tr.entity_id) AS hits, round(count(tr.entity_id) / greatest(any_value(p), 1)::DOUBLE, 4) AS recall, round(count(tr.entity_id) / k::DOUBLE, 4) AS precision"""
ORACLE = {
    "research_sample_strata": _STRATA_SQL,
    "research_model_matrix": f"""WITH {_SCORES_SQL}, {EVENTS_SQL}, {_TRUTH_SQL}, {_K}, pl AS (SELECT model, entity_id, row_number() OVER (PARTITION BY model ORDER BY score DESC, entity_id) AS place FROM sc)
SELECT {_MATRIX.format(names="model, k")} FROM pl JOIN k ON place <= k LEFT JOIN tr USING (entity_id) CROSS JOIN p GROUP BY model, k""",
    "research_sweep": f"WITH {EVENTS_SQL}, {_TRUTH_SQL} " + " UNION ALL ".join(
        [_band_sql("band", b, 400.0, b) for b in (0.7, 0.8, 0.9)] + [_band_sql("threshold", t, t, 0.8) for t in (300.0, 400.0)]
    ),
    "research_sample_accounts": f"""WITH {LEDGER_SQL}, nu AS (SELECT event_id, entity_id, direction, row_number() OVER (PARTITION BY entity_id ORDER BY event_id) AS nth FROM lg WHERE direction <> 'credit')
SELECT event_id, entity_id, direction FROM lg WHERE direction = 'credit' UNION ALL SELECT event_id, entity_id, direction FROM nu WHERE nth <= 5""",
    "research_overlap": """SELECT "both", either, round("both" / either::DOUBLE, 6) AS jaccard FROM (SELECT count(*) FILTER (n = 2) AS "both", count(*) AS either
FROM (SELECT k, count(DISTINCT s) AS n FROM (SELECT o_custkey AS k, 1 AS s FROM orders UNION ALL SELECT s_suppkey, 2 FROM supplier) GROUP BY 1))""",
}
