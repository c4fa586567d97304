"""Per-entity behaviour features: one window for gaps, then one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.lineage import cut

COUNTS = ["n_events", "n_calls", "n_txns", "n_posts", "n_credit", "n_debit"]
FEATURES = [
    *COUNTS, "amt_total", "amt_mean", "amt_max", "amt_std", "fan_out", "fan_in",
    "gap_max", "gap_min", "gap_std", "hour_entropy", "night_ratio", "weekend_ratio",
]
#: Features taken as logarithms before outlier models see them.
LOGGED = [*COUNTS, "amt_total", "amt_mean", "amt_max", "amt_std", "fan_out", "fan_in", "gap_max", "gap_min", "gap_std"]


def build_features(events: DataFrame) -> DataFrame:
    """(entity_id, the 18 features); whatever an entity lacks is 0.

    Hours and parties are counted in tables of their own, grouped before they
    meet the entity: no row is repeated for a distinct count."""
    rows = events.where("entity_id is not null")
    by_time = Window.partitionBy("entity_id").orderBy("timestamp", "event_id")
    seconds = lambda c: F.expr(f"timestampdiff(MICROSECOND, {c}, timestamp)") / 1e6
    seq = rows.withColumn("before", F.lag("timestamp").over(by_time)).withColumn("gap", seconds("before"))
    hour, n = F.hour("timestamp"), F.count("*")
    positive = F.when(F.col("amount") > 0, F.col("amount"))
    kind = lambda k: F.count_if(F.col("event_type") == k)
    wide = seq.groupBy("entity_id").agg(
        n.alias("n_events"), kind("call").alias("n_calls"), kind("transaction").alias("n_txns"), kind("post").alias("n_posts"),
        kind("credit").alias("n_credit"), kind("debit").alias("n_debit"),
        F.sum(positive).alias("amt_total"), F.avg(positive).alias("amt_mean"), F.max(positive).alias("amt_max"), F.stddev_samp(positive).alias("amt_std"),
        F.max("gap").alias("gap_max"), F.min("gap").alias("gap_min"), F.stddev_samp("gap").alias("gap_std"),
        (F.count_if((hour >= 22) | (hour <= 5)) / n).alias("night_ratio"), (F.count_if(F.weekday("timestamp") >= 5) / n).alias("weekend_ratio"),
    )
    credit = F.coalesce("direction", F.lit("")) == "credit"
    pairs = rows.where("counterparty_id is not null").groupBy("entity_id", "counterparty_id").agg(F.bool_or(credit).alias("c"), F.bool_or(~credit).alias("d"))
    fans = pairs.groupBy("entity_id").agg(F.count_if("d").alias("fan_out"), F.count_if("c").alias("fan_in"))
    hours = rows.where("timestamp is not null").groupBy("entity_id", hour.alias("h")).agg(F.count("*").alias("k"))
    # -sum(p ln(p + EPS)) over the at most 24 hours of an entity.
    total = F.aggregate("ks", F.lit(0).cast("long"), lambda acc, k: acc + k)
    entropy = F.aggregate(F.transform("ks", lambda k: k / F.col("total")), F.lit(0.0), lambda acc, p: acc - p * F.log(p + 1e-9))
    spread = hours.groupBy("entity_id").agg(F.array_sort(F.collect_list("k")).alias("ks")).withColumn("total", total).select("entity_id", entropy.alias("hour_entropy"))
    met = wide.join(fans, "entity_id", "left").join(spread, "entity_id", "left")
    return met.select("entity_id", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES))


def feature_matrix(events: DataFrame) -> DataFrame:
    """(entity_id, features standardised): logs, then (x - mean) / (std + EPS)."""
    return standardised(build_features(events))


def standardised(f: DataFrame) -> DataFrame:
    """``feature_matrix`` of features that are made already."""
    f = cut(f.select("entity_id", *(F.log1p(F.greatest(F.col(c), F.lit(0.0))).alias(c) if c in LOGGED else F.col(c) for c in FEATURES)))
    stats = f.agg(*(g(c).alias(f"_{tag}_{c}") for c in FEATURES for tag, g in (("m", F.avg), ("s", F.stddev_samp))))
    met = f.join(F.broadcast(stats))
    scaled = [F.coalesce((F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-9), F.lit(0.0)).alias(c) for c in FEATURES]
    return met.select("entity_id", *scaled)
