"""Registered queries for sequences, answer keys, sealed files and charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.lineage import cut
from tidewatch.functions.scaling import rounded
from tidewatch.operators import charts, insights, resolution, sequences, truth
from tidewatch.plans import sufficiency
from tidewatch.plans.model_queries import _SCORES_SQL, _scores
from tidewatch.plans.source_queries import ORACLE as SOURCE_ORACLE
from tidewatch.plans.source_queries import actors
from tidewatch.sinks import archive, report
from tidewatch.sources.views import EVENTS_SQL, LEDGER_SQL, events_view, ledger_view, table


def _sequences(spark: SparkSession, sf: str) -> DataFrame:
    rows = sequences.event_sequences(events_view(spark, sf), 16)
    return rows.select("entity_id", "place", *(F.round(c, 6).alias(c) for c in sequences.SIGNALS))


def _cross_source(spark: SparkSession, sf: str) -> DataFrame:
    events = actors(spark, sf).withColumn("counterparty_id_raw", F.lit(None).cast("string"))
    return resolution.cross_source(resolution.apply(events, resolution.resolve(events)))


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth customer as a listed person, known by account, by name, or by
    a name with a slip in it."""
    people = actors(spark, sf)
    mapping = resolution.resolve(people)
    named = people.join(mapping, people.actor_raw == mapping.identifier).select(F.col("actor_name").alias("name"), "entity_id")
    own = people.where("source = 'bank'").withColumn("i", F.substring("actor_raw", 2, 20).cast("long")).where("i % 5 = 0")
    by_account = F.col("i") % 3 == 0
    slip = F.concat(F.col("actor_name"), F.lit("0"))
    name = F.when(by_account, "").when(F.col("i") % 3 == 1, F.col("actor_name")).otherwise(slip)
    key = own.select(F.concat(F.lit("P"), "i").alias("person"), F.when(by_account, F.col("actor_raw")).otherwise("").alias("account"), F.lit("").alias("phone"), F.lit("").alias("handle"), name.alias("name"))
    return truth.to_entities(key, mapping, named)


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.concat(F.lit("f"), "c_custkey").alias("path"), F.col("c_name").cast("binary").alias("content"))


def _verified(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as files: of those sealed some change, go, or come new."""
    files, i = _files(spark, sf), F.substring("path", 2, 20).cast("long")
    now = files.withColumn("content", F.when(i % 7 == 0, F.lit("x").cast("binary")).otherwise(F.col("content"))).where(i % 11 != 0)
    return archive.verify(archive.seal(files.where(i % 13 != 0)), now)


def _chain(spark: SparkSession, sf: str) -> DataFrame:
    """Days of orders as runs, each linked to the one before; of every fifth the
    files were changed afterwards."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    days = table(spark, sf, "orders").groupBy(day.alias("run_id")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("k"), F.max("o_orderkey").alias("m"))
    runs = cut(archive.chained(days.select("run_id", F.sha2(F.concat_ws(":", "n", "k", "m"), 256).alias("files_sha256"))))
    changed = F.crc32(F.col("run_id")) % 5 == 4
    now = runs.withColumn("files_sha256", F.when(changed, F.sha2(F.lit("forged"), 256)).otherwise(F.col("files_sha256")))
    return archive.verify_chain(now).join(runs.select("run_id", "chain_hash"), "run_id")


_DAYS = """dy AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS run_id, sha256(count(*) || ':' || min(o_orderkey) || ':' || max(o_orderkey)) AS files FROM orders GROUP BY 1),
nu AS (SELECT *, row_number() OVER (ORDER BY run_id) AS i FROM dy)"""


def _crc32_sql(text: str) -> str:
    """CRC-32 of a short ASCII text, bit by bit."""
    step = "list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"
    codes = f"list_transform(range(strlen({text})), lambda j: ascii(substring({text}, (j + 1)::INT, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: {step}), 4294967295)"


def _aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Customers, every third known to a second source by the next one's name too,
    under which a third source lists it."""
    i = F.col("i")
    own = actors(spark, sf).where("source = 'bank'").withColumn("i", F.substring("actor_raw", 2, 20).cast("long"))
    named = own.select((i - 1).alias("i"), F.col("actor_name").alias("alias"))
    third = own.join(named, "i").where(i % 3 == 0)
    other = third.select("actor_raw", F.col("alias").alias("actor_name"), F.lit("cdr").alias("source"))
    listed = third.select(F.concat(F.lit("H"), i).alias("actor_raw"), F.col("alias").alias("actor_name"), F.lit("social").alias("source"))
    return resolution.resolve(own.select("actor_raw", "actor_name", "source").unionByName(other).unionByName(listed))


def _parties(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger rows by entity and party; suppliers without a customer's name are
    actors too, other counterparties stay open."""
    rows = ledger_view(spark, sf).select("event_id", F.concat(F.lit("C"), "entity_id").alias("actor_raw"), F.concat(F.lit("S"), F.col("counterparty_id") + 40).alias("counterparty_id_raw"))
    known = resolution.resolve(actors(spark, sf))
    return resolution.apply(rows, known).groupBy("entity_id").agg(F.count("*").alias("n"), F.count("counterparty_id").alias("resolved"), F.min("counterparty_id").alias("least"))


def _gating(spark: SparkSession, sf: str) -> DataFrame:
    """What each source alone, and all together, can support."""
    rows, events = [], events_view(spark, sf)
    for name in ("all", "bank", "cdr", "social"):
        held = sufficiency.holdings(events if name == "all" else events.where(F.col("source") == name))
        rows += [(name, stage, verdict) for stage, verdict in sufficiency.verdicts(held, 20).items()]
    return spark.createDataFrame(rows, "source string, stage string, verdict string")


def _gating_sql() -> str:
    sided = "CASE WHEN src = 1 THEN 'DEGRADED' ELSE 'SUPPORTED' END"
    stages = {
        "time_correlation": f"CASE WHEN ts = 0 THEN 'BLOCKED' ELSE {sided} END",
        "network": f"CASE WHEN cp = 0 OR name = 'social' THEN 'BLOCKED' ELSE {sided} END",
        "statml": "CASE WHEN ts = 0 THEN 'BLOCKED' WHEN am > 0 THEN 'SUPPORTED' ELSE 'DEGRADED' END",
        **dict.fromkeys(("benford", "structuring", "behavioral"), "CASE WHEN am > 0 THEN 'SUPPORTED' ELSE 'BLOCKED' END"),
        "chain": "CASE WHEN ts > 0 AND cp > 0 AND am > 0 THEN 'SUPPORTED' ELSE 'BLOCKED' END",
    }
    gated = " UNION ALL ".join(f"SELECT name AS source, '{s}' AS stage, CASE WHEN n < 20 * e THEN 'BLOCKED' ELSE {v} END AS verdict FROM ho" for s, v in stages.items())
    return f"""WITH {EVENTS_SQL}, pa AS (SELECT 'all' AS name, * FROM ev UNION ALL SELECT source, * FROM ev),
ho AS (SELECT name, count(*) AS n, count(DISTINCT entity_id) AS e, count(DISTINCT source) AS src, count(timestamp) AS ts, count(counterparty_id) AS cp, count(amount) AS am FROM pa GROUP BY 1)
SELECT name AS source, 'schema_detection' AS stage, 'SUPPORTED' AS verdict FROM ho UNION ALL
SELECT name, 'entity_resolution', CASE WHEN cp > 0 THEN 'SUPPORTED' ELSE 'DEGRADED' END FROM ho UNION ALL {gated}"""


QUERIES = {
    "entity_aliases": _aliases,
    "entity_counterparties": _parties,
    "sufficiency_verdicts": _gating,
    "model_top_scores": lambda spark, sf: report.top_scores(_scores(spark, sf), 5),
    "evidence_trails": lambda spark, sf: insights.trails(events_view(spark, sf), cap=25),
    "display_names": lambda spark, sf: insights.display_names(table(spark, sf, "customer").select(F.col("c_nationkey").alias("entity_id"), F.when(F.col("c_nationkey") % 4 > 0, F.col("c_name")).alias("name"))),
    "event_sequences": _sequences,
    "statml_lstm": lambda spark, sf: rounded(sequences.lstm_autoencoder(events_view(spark, sf))),
    "cross_source_entities": _cross_source,
    "truth_entities": _truth,
    "archive_verify": _verified,
    "archive_chain": _chain,
    "chart_source_counts": lambda spark, sf: charts.source_counts(events_view(spark, sf)),
    "chart_entity_daily": lambda spark, sf: charts.entity_daily(events_view(spark, sf)),
}
ORACLE = {
    "entity_aliases": """SELECT 'C' || c_custkey AS identifier, 'E:C' || c_custkey AS entity_id FROM customer
UNION ALL SELECT 'H' || c_custkey, 'E:C' || c_custkey FROM customer WHERE c_custkey % 3 = 0 AND c_custkey + 1 IN (SELECT c_custkey FROM customer)""",
    "entity_counterparties": f"""WITH {LEDGER_SQL}, rs AS (SELECT s_suppkey, CASE WHEN s_suppkey IN (SELECT c_custkey FROM customer) THEN 'E:C' ELSE 'E:S' END || s_suppkey AS e FROM supplier)
SELECT 'E:C' || entity_id AS entity_id, count(*) AS n, count(e) AS resolved, min(e) AS least FROM lg LEFT JOIN rs ON s_suppkey = counterparty_id + 40 GROUP BY 1""",
    "sufficiency_verdicts": _gating_sql(),
    "model_top_scores": f"WITH {_SCORES_SQL} SELECT model, entity_id, score, row_number() OVER (PARTITION BY model ORDER BY score DESC, entity_id)::INT AS place FROM sc QUALIFY place <= 5",
    "evidence_trails": f"""WITH {EVENTS_SQL}, di AS (SELECT DISTINCT entity_id, timestamp, source, counterparty_id, amount FROM ev WHERE entity_id IS NOT NULL)
SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY timestamp, source NULLS FIRST, counterparty_id NULLS FIRST, amount NULLS FIRST)::INT AS place FROM di QUALIFY place <= 25""",
    "display_names": "SELECT c_nationkey AS entity_id, coalesce(min(c_name) FILTER (c_nationkey % 4 > 0), c_nationkey::VARCHAR) AS name FROM customer GROUP BY 1",
    "event_sequences": f"""WITH {EVENTS_SQL}, o AS (SELECT *, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY entity_id ORDER BY timestamp, event_id)) / 3600e6 AS gap_,
  (row_number() OVER (PARTITION BY entity_id ORDER BY timestamp DESC, event_id DESC) - 1)::INT AS place, count(*) OVER (PARTITION BY entity_id) AS n FROM ev)
SELECT entity_id, place, round(ln(1 + coalesce(amount, 0)) / ln(1 + (SELECT max(amount) FROM ev)), 6) AS amount, round(least(coalesce(gap_, 0) / 96, 1.0), 6) AS gap, round(hour(timestamp) / 24.0::DOUBLE, 6) AS hour,
  (event_type = 'call')::INT::DOUBLE AS is_call, (event_type = 'transaction')::INT::DOUBLE AS is_transaction, (event_type = 'post')::INT::DOUBLE AS is_post FROM o WHERE n >= 8 AND place < 16""",
    "cross_source_entities": f"SELECT count(DISTINCT entity_id) AS n_entities, count(*) - count(DISTINCT entity_id) AS n_cross_source FROM ({SOURCE_ORACLE['entity_resolution']})",
    "truth_entities": "SELECT 'P' || c_custkey AS person, 'E:C' || c_custkey AS entity_id FROM customer WHERE c_custkey % 5 = 0",
    "archive_verify": """SELECT 'f' || c_custkey AS path, CASE WHEN c_custkey % 11 = 0 THEN 'MISSING' WHEN c_custkey % 13 = 0 THEN 'EXTRA' WHEN c_custkey % 7 = 0 THEN 'MISMATCH' ELSE 'ok' END AS status
FROM customer WHERE NOT (c_custkey % 11 = 0 AND c_custkey % 13 = 0)""",
    "archive_chain": f"""WITH RECURSIVE {_DAYS}, ch AS (SELECT run_id, i, sha256(files) AS chain_hash FROM nu WHERE i = 1
  UNION ALL SELECT nu.run_id, nu.i, sha256(ch.chain_hash || nu.files) FROM ch JOIN nu ON nu.i = ch.i + 1)
SELECT run_id, chain_hash, {_crc32_sql("run_id")} % 5 <> 4 AS ok FROM ch""",
    "chart_source_counts": f"WITH {EVENTS_SQL} SELECT source, count(*) AS n, count(DISTINCT entity_id) AS entities FROM ev GROUP BY 1",
    "chart_entity_daily": f"WITH {EVENTS_SQL} SELECT entity_id, strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS n, round(sum(amount), 2) AS total FROM ev GROUP BY 1, 2",
}
