"""Evidence extractors: (entity_id, kind, detail) where a pattern is met."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.temporal import burst_sizes


def _evidence(df: DataFrame, kind: str, n: str) -> DataFrame:
    return df.select("entity_id", F.lit(kind).alias("kind"), F.col(n).cast("long").alias("detail"))


def call_then_transfer(events: DataFrame, tolerance_minutes: int = 30) -> DataFrame:
    """Bank rows with a call or post to the same party within the tolerance."""
    width = tolerance_minutes * 60_000_000
    rows = events.where("entity_id is not null and counterparty_id is not null and timestamp is not null")
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', timestamp)")
    around = Window.partitionBy("entity_id", "counterparty_id").orderBy("at").rangeBetween(-width, width)
    near = rows.withColumn("at", at).withColumn("calls", F.count_if(F.col("source") != "bank").over(around))
    n = near.where("source = 'bank' and calls > 0").groupBy("entity_id").agg(F.count("*").alias("n"))
    return _evidence(n, "call_then_transfer", "n")


def under_threshold(events: DataFrame, threshold: float = 10_000.0, band: float = 0.88, least: int = 3) -> DataFrame:
    inside = events.where("entity_id is not null and amount > 0").where((F.col("amount") >= band * threshold) & (F.col("amount") < threshold))
    return _evidence(inside.groupBy("entity_id").agg(F.count("*").alias("n")).where(F.col("n") >= least), "under_threshold", "n")


def hub(events: DataFrame) -> DataFrame:
    """Many parties of credits and debits with an amount: 5 in and 8 out, which
    counts both sides, else 10 on one side, which counts that side."""
    sides = events.where("entity_id is not null and counterparty_id is not null and amount is not null and direction in ('credit', 'debit')")
    per = sides.groupBy("entity_id", "counterparty_id").agg(F.bool_or(F.col("direction") == "credit").alias("c"), F.bool_or(F.col("direction") == "debit").alias("d"))
    per = per.groupBy("entity_id").agg(F.count_if("c").alias("i"), F.count_if("d").alias("o"))
    n = F.when((F.col("i") >= 5) & (F.col("o") >= 8), F.col("i") + F.col("o")).when(F.col("i") >= 10, F.col("i")).when(F.col("o") >= 10, F.col("o"))
    return _evidence(per.withColumn("n", n).where("n is not null"), "hub", "n")


def burst_of_parties(events: DataFrame, hours: int = 48, parties: int = 12, least: int = 10) -> DataFrame:
    busy = events.where("entity_id is not null and counterparty_id is not null and timestamp is not null").groupBy("entity_id").agg(F.count("*").alias("all")).where(F.col("all") >= least)
    met = burst_sizes(events, hours).where(F.col("burst") >= parties).join(busy, "entity_id", "left_semi")
    return _evidence(met, "burst", "burst")


def dormancy(events: DataFrame, days: float = 30, least: int = 10) -> DataFrame:
    by_time = Window.partitionBy("entity_id").orderBy("timestamp", "event_id")
    seq = events.where("entity_id is not null and timestamp is not null").withColumn("before", F.lag("timestamp").over(by_time))
    gap = F.expr("timestampdiff(MICROSECOND, before, timestamp)") / 86_400_000_000.0
    per = seq.groupBy("entity_id").agg(F.count("*").alias("all"), F.max(gap).alias("gap")).where((F.col("all") >= least) & (F.col("gap") >= days))
    return _evidence(per.withColumn("n", F.floor("gap")), "dormancy", "n")


def lump_then_silence(events: DataFrame, quantile: float = 0.95, days: float = 14, least: int = 5) -> DataFrame:
    """The last amount at or above the entity's own quantile, then days until its
    last row with an amount; ``least`` such rows at least."""
    rows = events.where("entity_id is not null and timestamp is not null and amount is not null")
    q = rows.groupBy("entity_id").agg(F.percentile("amount", F.lit(quantile)).alias("q"), F.count("*").alias("all"))
    q = q.where((F.col("all") >= least) & (F.col("q") > 0))
    met = rows.join(q, "entity_id").groupBy("entity_id").agg(
        F.max(F.when(F.col("amount") >= F.col("q"), F.col("timestamp"))).alias("lump"), F.max("timestamp").alias("last")
    )
    quiet = F.expr("timestampdiff(MICROSECOND, lump, last)") / 86_400_000_000.0
    return _evidence(met.withColumn("quiet", quiet).where(F.col("quiet") >= days).withColumn("n", F.floor("quiet")), "lump_then_silence", "n")


def round_amounts(events: DataFrame, share: float = 0.5, least: int = 15) -> DataFrame:
    rows = events.where("entity_id is not null and amount is not null")
    per = rows.groupBy("entity_id").agg(F.count_if(F.pmod("amount", F.lit(1.0)) < 0.01).alias("n"), F.count("*").alias("all"))
    return _evidence(per.where((F.col("all") >= least) & (F.col("n") / F.col("all") >= share)), "round_amounts", "n")


def build_insights(events: DataFrame, tolerance_minutes: int = 30, threshold: float = 10_000.0, dormant_days: float = 30, quiet_days: float = 14) -> DataFrame:
    """All evidence, one row for each entity and pattern."""
    found = [
        call_then_transfer(events, tolerance_minutes), under_threshold(events, threshold), hub(events), burst_of_parties(events),
        dormancy(events, dormant_days), lump_then_silence(events, days=quiet_days), round_amounts(events),
    ]
    return reduce(DataFrame.unionByName, found)


def worded(found: DataFrame, tolerance_minutes: int = 30, threshold: float = 10_000.0, hours: int = 48) -> DataFrame:
    """``build_insights``'s rows with ``sentence``, which says what was met."""
    n = F.format_string("%,d", "detail")
    said = {
        "call_then_transfer": [n, f" transfers to a party called or posted to within {tolerance_minutes} minutes"],
        "under_threshold": [n, f" amounts just under the limit of {threshold:,.0f}"],
        "hub": ["money moved with ", n, " different parties"],
        "burst": ["dealt with ", n, f" different parties within {hours} hours"],
        "dormancy": ["silent for ", n, " days, then active again"],
        "lump_then_silence": ["a large amount, then quiet for ", n, " days"],
        "round_amounts": [n, " amounts without cents, half of all or more"],
    }
    text = F.lit(None).cast("string")
    for kind, parts in said.items():
        text = F.when(F.col("kind") == kind, F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))).otherwise(text)
    return found.withColumn("sentence", text)


def largest_per_party(events: DataFrame, k: int = 20) -> DataFrame:
    """An entity's evidence by party: of each counterparty the row of the largest
    amount (ties: the earliest event_id), the ``k`` largest of them."""
    rows = events.where("entity_id is not null and counterparty_id is not null and amount is not null")
    best = rows.groupBy("entity_id", "counterparty_id").agg(F.max(F.struct("amount", (-F.col("event_id")).alias("id"))).alias("x"))
    best = best.select("entity_id", "counterparty_id", F.col("x.amount").alias("amount"), (-F.col("x.id")).alias("event_id"))
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("amount"), "event_id"))
    return best.withColumn("place", place).where(F.col("place") <= k)


def display_names(named: DataFrame) -> DataFrame:
    """(entity_id, name): the first name in order, else the id as text."""
    per = named.where("entity_id is not null").groupBy("entity_id").agg(F.min("name").alias("name"))
    return per.select("entity_id", F.coalesce("name", F.col("entity_id").cast("string")).alias("name"))


def trails(events: DataFrame, entities: DataFrame | None = None, cap: int = 200) -> DataFrame:
    """``trail`` of all entities, or of those in ``entities``, in one plan, with
    ``place`` from 1. No task keeps more than ``cap`` rows of an entity to send."""
    own = events.where("entity_id is not null")
    if entities is not None:
        own = own.join(entities.select("entity_id").distinct(), "entity_id", "left_semi")
    keys = ["timestamp", "source", "counterparty_id", "amount"]
    rows = own.select("entity_id", *keys).dropDuplicates()
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(*keys))
    return rows.withColumn("place", place).where(F.col("place") <= cap)


def trail(events: DataFrame, entity_id, cap: int = 200) -> DataFrame:
    """An entity's evidence rows without repeats, oldest first, ``cap`` at most."""
    own = events.where(F.col("entity_id") == entity_id).dropDuplicates(["timestamp", "source", "counterparty_id", "amount"])
    return own.orderBy("timestamp", "source", "counterparty_id", "amount").limit(cap)
