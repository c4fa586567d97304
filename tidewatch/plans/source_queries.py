"""Registered queries for cleansing, gating inputs and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.amounts import parse_amount
from tidewatch.functions.dates import parse_timestamp
from tidewatch.operators import resolution
from tidewatch.sources import detect, loaders, prose
from tidewatch.sources.views import EVENTS_SQL, events_view, table
from tidewatch.streaming import windows


def _amounts(spark: SparkSession, sf: str) -> DataFrame:
    """Order totals written in four money styles and read back."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    us = F.format_number("o_totalprice", 2)
    eu = F.translate(us, ",.", ".,")
    style = F.col("o_orderkey") % 4
    text = F.when(style == 0, F.concat(F.lit("$"), us)).when(style == 1, F.concat(F.lit("("), us, F.lit(")"))).when(style == 2, F.concat(eu, F.lit(" EUR"))).otherwise("n/a")
    return o.select("o_orderkey", F.round(parse_amount(text), 2).alias("amount"))


def _props(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON field of event rows, counted by source."""
    e = events_view(spark, sf)
    return e.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("counterparty_id").alias("parties"), F.count("amount").alias("amounts"))


def _dates(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates written in six styles and read back."""
    d = F.col("o_orderdate")
    styles = ["yyyy-MM-dd", "dd/MM/yyyy", "yyyy/M/d HH:mm", "d MMMM yyyy", "MMM d, yyyy"]
    text = F.unix_millis(d.cast("timestamp")).cast("string")
    for i, style in enumerate(styles):
        text = F.when(F.col("o_orderkey") % 6 == i, F.date_format(d, style)).otherwise(text)
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("t"))
    return rows.select("o_orderkey", F.date_format(parse_timestamp(F.col("t"), day_first=True), "yyyy-MM-dd HH:mm:ss").alias("at"))


def _log_lines(spark: SparkSession, sf: str) -> DataFrame:
    e = events_view(spark, sf).where("source = 'bank'")
    money = F.format_number("amount", 2)
    text = F.concat(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit(" INFO transfer from ACCT-"), F.lpad(F.col("entity_id").cast("string"), 6, "0"),
                    F.lit(" to ACCT-"), F.lpad(F.col("counterparty_id").cast("string"), 6, "0"), F.lit(" amount "),
                    F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("$"), money)).otherwise(F.concat(money, F.lit(" EUR"))))
    return e.select("event_id", text.alias("line"))


def _prose(spark: SparkSession, sf: str) -> DataFrame:
    """Bank rows as prose, read back into fields."""
    rows = _log_lines(spark, sf).select("event_id", *prose.fields(F.col("line")))
    return rows.withColumn("amount", F.col("amount").cast("double")).drop("duration")


def _key_values(spark: SparkSession, sf: str) -> DataFrame:
    """Event rows as key=value lines, read back into columns."""
    e = table(spark, sf, "events")
    line = F.format_string('id=%d kind=%s at="%s" user=%d', "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "user_id")
    rows = loaders.from_key_values(e.select(line.alias("value")))
    return rows.select(F.col("id").cast("long").alias("event_id"), "kind", "at", F.col("user").cast("long").alias("user_id"))


def _json_field(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


def _normalized(spark: SparkSession, sf: str) -> DataFrame:
    """Orders under foreign headers and texts, detected and made event rows."""
    o = table(spark, sf, "orders")
    raw = o.select(F.concat(F.lit("ORD"), "o_orderkey").alias("nro_cuenta"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("fecha"),
                   F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("monto"), F.concat(F.lit("C"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")).alias("beneficiario"))
    found = detect.detect_columns(raw)
    rows, _ = detect.normalize(raw, found, detect.classify_source(found))
    return rows.select("actor_raw", F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "source", "event_type", F.round("amount", 2).alias("amount"), "counterparty_id_raw")


def actors(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers, named by hashes of their number, as actors of two
    sources: equal numbers have equal names, others are far apart."""
    name = lambda key: F.concat(F.lit("n"), F.conv(F.sha2(F.col(key).cast("string"), 256).substr(1, 14), 16, 36), F.lit(" "), F.sha2(F.col(key).cast("string"), 256).substr(20, 24))
    c = table(spark, sf, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("actor_raw"), name("c_custkey").alias("actor_name"), F.lit("bank").alias("source"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("actor_raw"), name("s_suppkey").alias("actor_name"), F.lit("cdr").alias("source"))
    return c.union(s)


def _entities(spark: SparkSession, sf: str) -> DataFrame:
    """Equal names of both sources make one entity."""
    return resolution.resolve(actors(spark, sf))


_WINDOW_SQL = """SELECT entity_id, strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(s + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n, round(sum(amount), 3) AS total"""
QUERIES = {
    "parse_amounts": _amounts,
    "source_counts": _props,
    "distinct_events": lambda spark, sf: events_view(spark, sf).drop("event_id").union(events_view(spark, sf).drop("event_id")).distinct().groupBy("source").count().withColumnRenamed("count", "n"),
    "parse_dates": _dates, "prose_fields": _prose, "key_value_lines": _key_values, "json_field": _json_field, "normalized_orders": _normalized,
    "entity_resolution": _entities, "window_session": lambda spark, sf: windows.session(events_view(spark, sf)),
    "window_tumbling": lambda spark, sf: windows.tumbling(events_view(spark, sf)),
    "window_sliding": lambda spark, sf: windows.sliding(events_view(spark, sf)),
}
ORACLE = {
    "parse_amounts": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN round(o_totalprice, 2) WHEN 1 THEN -round(o_totalprice, 2) WHEN 2 THEN round(o_totalprice, 2) END AS amount FROM orders",
    "source_counts": f"WITH {EVENTS_SQL} SELECT source, count(*) AS n, count(DISTINCT counterparty_id) AS parties, count(amount) AS amounts FROM ev GROUP BY 1",
    "distinct_events": f"WITH {EVENTS_SQL} SELECT source, count(*) AS n FROM (SELECT DISTINCT * EXCLUDE (event_id) FROM ev) GROUP BY 1",
    "window_tumbling": f"WITH {EVENTS_SQL} {_WINDOW_SQL} FROM (SELECT *, date_trunc('hour', timestamp) AS s FROM ev) GROUP BY 1, s",
    "window_sliding": f"""WITH {EVENTS_SQL} {_WINDOW_SQL} FROM (SELECT *, unnest([0, 1, 2, 3]) AS k, time_bucket(INTERVAL 15 MINUTE, timestamp) - k * INTERVAL 15 MINUTE AS s FROM ev) GROUP BY 1, s""",
    "parse_dates": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at FROM orders",
    "prose_fields": f"""WITH {EVENTS_SQL} SELECT event_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS ts, round(amount, 2) AS amount,
  'ACCT-' || lpad(entity_id::VARCHAR, 6, '0') AS account, 'ACCT-' || lpad(counterparty_id::VARCHAR, 6, '0') AS counterparty, 'debit' AS direction, 'transaction' AS event_type
  FROM ev WHERE source = 'bank'""",
    "key_value_lines": "SELECT event_id, event_type AS kind, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, user_id FROM events",
    "json_field": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "normalized_orders": """SELECT 'ORD' || o_orderkey AS actor_raw, strftime(o_orderdate, '%Y-%m-%d') AS day, 'bank' AS source, 'transaction' AS event_type,
  round(o_totalprice, 2) AS amount, 'C' || lpad(o_custkey::VARCHAR, 6, '0') AS counterparty_id_raw FROM orders""",
    # Names are hashes of the key: equal keys have equal names, others are far apart.
    "entity_resolution": """SELECT 'C' || c_custkey AS identifier, 'E:C' || c_custkey AS entity_id FROM customer
UNION ALL SELECT 'S' || s_suppkey, CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_custkey = s_suppkey) THEN 'E:C' ELSE 'E:S' END || s_suppkey FROM supplier""",
    "window_session": f"""WITH {EVENTS_SQL}, st AS (SELECT *, CASE WHEN timestamp < lag(timestamp) OVER o + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM ev
  WINDOW o AS (PARTITION BY entity_id ORDER BY timestamp, event_id)), no AS (SELECT *, sum(fresh) OVER (PARTITION BY entity_id ORDER BY timestamp, event_id) AS nth FROM st)
SELECT entity_id, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(timestamp) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n, round(sum(amount), 3) AS total FROM no GROUP BY entity_id, nth""",
}
