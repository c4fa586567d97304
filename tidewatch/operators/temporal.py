"""Operators on the order and distance of events in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scaling import scoremin


def _micros(ts: str) -> F.Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")


def asof_match(left: DataFrame, right: DataFrame, tolerance_minutes: int, by: list[str] | None = None) -> DataFrame:
    """``left`` rows with ``match``: the first ``right`` row at or after their
    timestamp within the tolerance, lowest event_id among equals.

    Time is cut into buckets one tolerance wide. A right row stands in its own
    bucket and the one before, so every answer lies in its left row's bucket and
    one sort per bucket, latest first, and a running last find it; no pairs are
    made. Both sides have event_id,
    timestamp and the columns ``by``, which must be equal.
    """
    by = by or []
    width = tolerance_minutes * 60_000_000
    bucket = F.floor(_micros("timestamp") / width)
    keep = [c for c in right.columns if c not in by]
    one = left.select(F.struct(*left.columns).alias("l"), F.lit(None).cast(right.select(F.struct(*keep).alias("r")).schema["r"].dataType).alias("r"),
                      "timestamp", "event_id", F.lit(0).alias("side"), bucket.alias("bucket"), *by)
    two = right.select(F.lit(None).cast(left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType).alias("l"), F.struct(*keep).alias("r"),
                       "timestamp", "event_id", F.lit(1).alias("side"), F.explode(F.array(bucket, bucket - 1)).alias("bucket"), *by)
    latest = [F.desc(c) for c in ("timestamp", "side", "event_id")]
    ahead = Window.partitionBy("bucket", *by).orderBy(*latest).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = one.unionByName(two).withColumn("match", F.last("r", ignorenulls=True).over(ahead)).where("side = 0 and match is not null")
    near = F.expr("timestampdiff(MICROSECOND, l.timestamp, match.timestamp)") <= width
    return found.where(near).select("l.*", "match")


def _matched(events: DataFrame, forward: bool, tolerance_minutes: int, episodes: int, same_entity: bool) -> DataFrame:
    cols = ["event_id", "entity_id", "counterparty_id", "timestamp"]
    calls = events.where("source in ('cdr', 'social') and counterparty_id is not null and timestamp is not null").select(*cols)
    bank = events.where("source = 'bank' and counterparty_id is not null and timestamp is not null").select(*cols)
    by = ["entity_id"] if same_entity else []
    met = asof_match(calls, bank, tolerance_minutes, by) if forward else asof_match(bank, calls, tolerance_minutes, by)
    same = met.where("counterparty_id = match.counterparty_id")
    txn = F.col("match.event_id") if forward else F.col("event_id")
    n = same.groupBy("entity_id").agg(F.count_distinct(txn).alias("n"))
    return n.select("entity_id", F.least(F.col("n") / episodes, F.lit(1.0)).alias("score"))


def time_correlation(events: DataFrame, tolerance_minutes: int = 30, min_episodes: int = 3, same_entity: bool = False) -> DataFrame:
    """Calls and posts followed by a bank row: the next one of anybody decides
    (of the same entity with ``same_entity``), and must share the counterparty."""
    return _matched(events, True, tolerance_minutes, min_episodes, same_entity)


def time_correlation_backward(events: DataFrame, tolerance_minutes: int = 30, min_episodes: int = 3, same_entity: bool = False) -> DataFrame:
    """Bank rows followed by a call or post to the same counterparty."""
    return _matched(events, False, tolerance_minutes, min_episodes, same_entity)


def time_correlation_anypair(events: DataFrame, tolerance_minutes: int = 25, min_episodes: int = 3) -> DataFrame:
    """Pairs of a call or post and a bank row of one entity and counterparty
    within the tolerance, counted; entities with fewer than ``min_episodes``
    pairs have no score. Pairs are counted over time-range windows, not made."""
    width = tolerance_minutes * 60_000_000
    rows = events.where("entity_id is not null and counterparty_id is not null and timestamp is not null").withColumn("at", _micros("timestamp"))
    around = Window.partitionBy("entity_id", "counterparty_id").orderBy("at").rangeBetween(-width, width)
    pairs = rows.withColumn("banks", F.count_if(F.col("source") == "bank").over(around)).where("source <> 'bank'")
    n = pairs.groupBy("entity_id").agg(F.sum("banks").alias("n")).where(F.col("n") >= min_episodes)
    return n.select("entity_id", F.least(F.col("n") / min_episodes, F.lit(1.0)).alias("score"))


def time_velocity(events: DataFrame) -> DataFrame:
    """Distinct counterparties per day of an entity's span, scaled."""
    rows = events.where("entity_id is not null and counterparty_id is not null and timestamp is not null")
    days = F.expr("timestampdiff(MICROSECOND, min(timestamp), max(timestamp))") / 86_400_000_000.0
    per = rows.groupBy("entity_id").agg(F.count_distinct("counterparty_id").alias("n"), days.alias("days"))
    return scoremin(per.withColumn("raw", F.col("n") / F.when(F.col("days") > 0, F.col("days")).otherwise(1 / 24.0)), "raw")


def burst_sizes(events: DataFrame, hours: int = 36) -> DataFrame:
    """(entity_id, burst): most distinct counterparties within ``hours`` of any
    event, either side.

    A counterparty is near while some event of its own is within reach: its
    spells are runs of events at most two reaches apart, drawn out by one reach at
    either end. The spells open at an event are a running sum.
    """
    width = hours * 3_600_000_000
    rows = events.where("entity_id is not null and counterparty_id is not null and timestamp is not null")
    rows = rows.select("entity_id", "counterparty_id", _micros("timestamp").alias("at"))
    own = Window.partitionBy("entity_id", "counterparty_id").orderBy("at")
    opens = F.coalesce(F.col("at") - F.lag("at").over(own) > 2 * width, F.lit(True))
    ends = F.coalesce(F.lead("at").over(own) - F.col("at") > 2 * width, F.lit(True))
    # At one moment spells open before events are counted and close after.
    mark = lambda at, place, step: F.struct(at.alias("at"), F.lit(place).alias("place"), F.lit(step).alias("step"))
    marks = F.array(
        F.when(opens, mark(F.col("at") - width, 0, 1)), mark(F.col("at"), 1, 0), F.when(ends, mark(F.col("at") + width, 2, -1))
    )
    swept = rows.withColumn("marks", marks).select("entity_id", F.explode(F.array_compact("marks")).alias("m")).select("entity_id", "m.*")
    running = Window.partitionBy("entity_id").orderBy("at", "place").rowsBetween(Window.unboundedPreceding, 0)
    counted = swept.withColumn("n", F.sum("step").over(running)).where("place = 1")
    return counted.groupBy("entity_id").agg(F.max("n").cast("long").alias("burst"))


def burst(events: DataFrame, hours: int = 36) -> DataFrame:
    """Burst sizes between their 70th and 98th percentile, as 0 to 1."""
    sizes = burst_sizes(events, hours)
    # Distinct counts are small whole numbers: few distinct values meet here.
    q = sizes.agg(F.percentile("burst", F.lit(0.7)).alias("low"), F.percentile("burst", F.lit(0.98)).alias("high"))
    span = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    score = (F.col("burst") - F.col("low")) / span
    return sizes.join(F.broadcast(q)).select("entity_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))
