"""Canonical event tables over the benchmark tables.

``events_view`` maps the stream table: purchases are bank rows, clicks and views
calls, the rest posts. ``ledger_view`` maps order lines: customers pay suppliers
and returned lines are credits. The mappings are ours; see the README.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    source = F.when(F.col("event_type") == "purchase", "bank").when(F.col("event_type").isin("click", "view"), "cdr").otherwise("social")
    return e.select(
        "event_id", F.col("user_id").alias("entity_id"), source.alias("source"), "event_type", F.col("ts").alias("timestamp"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("amount"),
        F.get_json_object("props", "$.k").cast("long").alias("counterparty_id"),
        F.when(F.col("event_type") == "purchase", F.when(F.col("event_id") % 3 == 0, "credit").otherwise("debit")).alias("direction"),
    )


EVENTS_SQL = """ev AS (SELECT event_id, user_id AS entity_id,
  CASE WHEN event_type = 'purchase' THEN 'bank' WHEN event_type IN ('click', 'view') THEN 'cdr' ELSE 'social' END AS source,
  event_type, ts AS timestamp, CASE WHEN event_type = 'purchase' THEN value END AS amount,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS counterparty_id,
  CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'credit' ELSE 'debit' END END AS direction
  FROM events)"""


def ledger_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_returnflag")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"), F.col("o_custkey").alias("entity_id"),
        F.lit("bank").alias("source"), F.lit("transaction").alias("event_type"), F.col("o_orderdate").alias("timestamp"),
        F.col("l_extendedprice").alias("amount"), F.col("l_suppkey").alias("counterparty_id"),
        F.when(F.col("l_returnflag") == "R", "credit").otherwise("debit").alias("direction"),
    )


LEDGER_SQL = """lg AS (SELECT l_orderkey * 10 + l_linenumber AS event_id, o_custkey AS entity_id, 'bank' AS source,
  'transaction' AS event_type, o_orderdate AS timestamp, l_extendedprice AS amount, l_suppkey AS counterparty_id,
  CASE WHEN l_returnflag = 'R' THEN 'credit' ELSE 'debit' END AS direction
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def orders_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bank rows; the narrowest table for amount rules."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("entity_id"), F.lit("bank").alias("source"),
        F.col("o_orderdate").alias("timestamp"), F.col("o_totalprice").alias("amount"),
    )


ORDERS_SQL = """od AS (SELECT o_orderkey AS event_id, o_custkey AS entity_id, 'bank' AS source,
  o_orderdate AS timestamp, o_totalprice AS amount FROM orders)"""
