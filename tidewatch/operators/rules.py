"""Rule operators: thresholds, regime changes, layering chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import scaling
from tidewatch.functions.lineage import cut
from tidewatch.functions.scaling import minmax, over_max


def structuring(events: DataFrame, threshold: float = 10_000.0, band: float = 0.88) -> DataFrame:
    """Bank amounts just under a threshold: count^1.5 / sqrt(all), over the max."""
    bank = events.where("source = 'bank' and amount is not null and entity_id is not null")
    inside = (F.col("amount") >= band * threshold) & (F.col("amount") < threshold)
    per = bank.groupBy("entity_id").agg(F.count_if(inside).alias("k"), F.count("*").alias("n")).where("k > 0")
    return over_max(per.select("entity_id", (F.pow("k", F.lit(1.5)) / F.sqrt("n")).alias("raw")), "raw")


def structuring_banded(events: DataFrame, threshold: float = 10_000.0, band: float = 0.8) -> DataFrame:
    """A wider band, count^1.2 over the maximum."""
    bank = events.where("source = 'bank' and entity_id is not null")
    inside = (F.col("amount") >= band * threshold) & (F.col("amount") < threshold)
    per = bank.where(inside).groupBy("entity_id").agg(F.count("*").alias("k"))
    return over_max(per.select("entity_id", F.pow("k", F.lit(1.2)).alias("raw")), "raw")


def behavioral(
    events: DataFrame, cold_days: float = 45, gap_days: float = 45, tail_days: float = 15, quantile: float = 0.99, gap_factor: float = 5, median_factor: float = 20
) -> DataFrame:
    """The greatest of three regime changes: a cold start late in the window, a
    dormant spell in mid-life, and silence after an unusually large amount."""
    days = lambda a, b: F.expr(f"timestampdiff(MICROSECOND, {a}, {b})") / 86_400_000_000.0
    rows = events.where("entity_id is not null and timestamp is not null")
    bank = F.col("source") == "bank"
    span = rows.agg(
        F.min(F.when(bank, F.col("timestamp"))).alias("ws"), F.max(F.when(bank, F.col("timestamp"))).alias("we")
    )
    q = scaling.quantile(rows.where("amount > 0"), "amount", quantile)
    by_time = Window.partitionBy("entity_id").orderBy("timestamp", "event_id")
    seq = rows.withColumn("before", F.lag("timestamp").over(by_time)).withColumn("i", F.row_number().over(by_time))
    seq = seq.withColumn("gap", days("before", "timestamp"))
    own = rows.where(bank & (F.col("amount") > 0)).groupBy("entity_id").agg(F.median("amount").alias("mid"))
    met = seq.join(F.broadcast(span)).join(own, "entity_id", "left")
    big = bank & (F.col("amount") >= F.greatest(F.lit(1e12 if q is None else q), median_factor * F.col("mid")))
    late = bank & (F.col("amount") > 0) & (days("timestamp", "we") <= cold_days)
    per = met.groupBy("entity_id").agg(
        F.count("*").alias("n"), F.first("ws").alias("ws"), F.first("we").alias("we"), F.min(F.when(bank, F.col("timestamp"))).alias("first_bank"),
        F.count_if(late).alias("late"), F.max("gap").alias("g"), F.median("gap").alias("gm"),
        F.max_by("i", F.struct("gap", -F.col("i"))).alias("gi"), F.max("timestamp").alias("last"), F.max(F.when(big, F.col("timestamp"))).alias("lump"),
    ).where("n >= 3")
    lag, tail, after, p = days("ws", "first_bank"), days("last", "we"), days("lump", "last"), F.col("gi") - 2
    cold = F.when((F.col("n") >= 5) & (lag >= cold_days) & (F.col("late") >= 3), F.least(0.5 + lag / 200, F.lit(1.0)))
    mid = F.when(
        (F.col("n") >= 15) & (F.col("g") >= gap_days) & (F.col("g") >= gap_factor * F.col("gm")) & (p >= 2) & (p < F.col("n") - 2),
        F.least(0.4 + F.col("g") / 90, F.lit(1.0)),
    )
    silent = F.when((F.col("n") >= 10) & (after <= 2) & (tail >= tail_days), F.least(0.4 + tail / 45, F.lit(1.0)))
    none = F.lit(0.0)
    score = F.greatest(F.coalesce(cold, none), F.coalesce(mid, none), F.coalesce(silent, none))
    return per.select("entity_id", score.alias("score")).where("score > 0")


def chain(
    events: DataFrame, min_amount: float = 10_000.0, hop_days: float = 7, min_nodes: int = 3, quantile: float = 0.9, factor: float = 10
) -> DataFrame:
    """Layering chains of unusually large bank rows: the next hop leaves the
    party the last one reached, within ``hop_days`` either way, to a party not
    yet on the path. Paths that cannot grow are chains; all their nodes but the
    last are scored. Paths grow hop by hop until none can; each hop meets only
    rows of its party in the time buckets around it."""
    bank = events.where("source = 'bank' and amount > 0 and entity_id is not null and counterparty_id is not null and timestamp is not null")
    q = scaling.quantile(bank, "amount", quantile) or 0.0
    own = bank.groupBy("entity_id").agg(F.median("amount").alias("mid"))
    limit = F.greatest(F.lit(max(min_amount, q)), factor * F.col("mid"))
    big = bank.join(own, "entity_id").where(F.col("amount") >= limit)
    width = int(hop_days * 86_400_000_000)
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', timestamp)")
    big = cut(big.select(F.col("entity_id").alias("src"), F.col("counterparty_id").alias("dst"), "amount", at.alias("at")))
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    hop = big.select(F.col("src").alias("tip"), F.col("dst").alias("to"), F.col("amount").alias("more"), F.col("at").alias("then"), bucket("at").alias("bucket"))
    paths = big.select(F.array("src", "dst").alias("nodes"), F.array("amount").alias("amounts"), F.col("dst").alias("tip"), "at")
    done = None
    if big.limit(min_nodes).count() < min_nodes:
        paths = paths.limit(0)
    while True:
        paths = cut(paths.withColumn("id", F.monotonically_increasing_id()))
        around = F.explode(F.array(*(bucket("at") + i for i in (-1, 0, 1)))).alias("bucket")
        near = (F.abs(F.col("then") - F.col("at")) <= width) & ~F.array_contains("nodes", F.col("to"))
        grown = cut(paths.select("*", around).join(hop, ["tip", "bucket"]).where(near))
        ended = paths.join(grown.select("id").distinct(), "id", "left_anti").where(F.size("nodes") >= min_nodes).select("nodes", "amounts")
        done = ended if done is None else done.unionByName(ended)
        if grown.isEmpty():
            break
        paths = grown.select(
            F.concat("nodes", F.array("to")).alias("nodes"), F.concat("amounts", F.array("more")).alias("amounts"), F.col("to").alias("tip"), F.col("then").alias("at")
        )
    depth_score = F.least(F.lit(1.0), 0.5 + F.size("amounts") / (2 * min_nodes))
    scored = done.select(depth_score.alias("ds"), F.explode(F.arrays_zip(F.slice("nodes", 1, F.size("amounts")).alias("node"), "amounts")).alias("x"))
    raw = F.col("ds") * (0.6 + 0.4 * F.least(F.lit(1.0), F.col("x.amounts") / (20 * min_amount)))
    return minmax(scored.groupBy(F.col("x.node").alias("entity_id")).agg(F.max(raw).alias("raw")), "raw").select("entity_id", "score")
