"""The aggregates that stand behind report charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.graph import edges


def daily_by_source(events: DataFrame) -> DataFrame:
    """(day, bank, cdr, social) with a row for every day of the span."""
    rows = events.where("timestamp is not null").withColumn("day", F.to_date("timestamp"))
    counts = rows.groupBy("day").pivot("source", ["bank", "cdr", "social"]).count()
    span = rows.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null")
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(counts, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("bank", "cdr", "social")))


def source_counts(events: DataFrame) -> DataFrame:
    """(source, n, entities): events and entities of each source."""
    per = events.groupBy("source", "entity_id").agg(F.count("*").alias("n"))
    return per.groupBy("source").agg(F.sum("n").alias("n"), F.count("entity_id").alias("entities"))


def entity_daily(events: DataFrame) -> DataFrame:
    """(entity_id, day, n, total): an entity's events and amounts by day."""
    rows = events.where("entity_id is not null and timestamp is not null")
    return rows.groupBy("entity_id", F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))


def model_peaks(scores: DataFrame) -> DataFrame:
    """(model, peak, fired): the best score and how many exceed 0.6."""
    return scores.groupBy("model").agg(F.round(F.max("score"), 6).alias("peak"), F.count_if(F.col("score") > 0.6).alias("fired"))


def shared_counterparties(events: DataFrame, hubs: DataFrame, least: int = 2) -> DataFrame:
    """(counterparty_id, hubs, w): parties that several hub entities meet."""
    e = edges(events).join(hubs.select(F.col("entity_id").alias("src")), "src", "left_semi")
    return e.groupBy(F.col("dst").alias("counterparty_id")).agg(F.count_distinct("src").alias("hubs"), F.sum("w").alias("w")).where(F.col("hubs") >= least)


def location_volume(events: DataFrame, flagged: DataFrame, location: str, k: int = 200) -> DataFrame:
    """(location, n, flagged, pct): the busiest places, whether a flagged entity
    was there, and the average percentile rank of the volume."""
    marked = events.join(flagged.select("entity_id", F.lit(True).alias("f")).distinct(), "entity_id", "left")
    per = marked.where(F.col(location).isNotNull()).groupBy(F.col(location).alias("location")).agg(
        F.count("*").alias("n"), F.coalesce(F.bool_or(F.col("f")), F.lit(False)).alias("flagged")
    )
    top = per.orderBy(F.desc("n"), "location").limit(k)
    by_n = top.groupBy("n").agg(F.count("*").alias("c"))
    # At most k rows by now.
    below = F.coalesce(F.sum("c").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    all_ = F.sum("c").over(Window.partitionBy())
    pct = by_n.select("n", ((below + (F.col("c") + 1) / 2) / all_).alias("pct"))
    return top.join(F.broadcast(pct), "n").select("location", "n", "flagged", F.round("pct", 6).alias("pct"))
