"""Digit-distribution operators on amounts, against the population's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.lineage import cut
from tidewatch.functions.scaling import EPS, chi2_sf_even8, chi2_sf_odd9


def _digits(events: DataFrame, second: bool) -> DataFrame:
    """(entity_id, digit) of amounts above 0: the first significant digit, or
    the second. Digits are read from the amount's scientific form."""
    rows = events.where("entity_id is not null and amount > 0").select("entity_id", "amount")
    x = F.col("amount")
    power = F.floor(F.log10(x))
    first = F.floor(x / F.pow(F.lit(10.0), power) + 1e-9)
    if not second:
        return rows.select("entity_id", F.greatest(F.lit(1), F.least(F.lit(9), first)).cast("int").alias("digit"))
    return rows.where("amount >= 1").select("entity_id", (F.floor(x / F.pow(F.lit(10.0), power - 1) + 1e-9) % 10).cast("int").alias("digit"))


def _table(events: DataFrame, second: bool, least: int) -> DataFrame:
    """(entity_id, n, digit, p, q): the entity's and the population's share of
    every digit; entities with fewer than ``least`` amounts are left out."""
    low, high = (0, 9) if second else (1, 9)
    wanted = list(range(low, high + 1))
    d = _digits(events, second)
    one = lambda k: F.count_if(F.col("digit") == k).alias(f"c{k}")
    per = cut(d.groupBy("entity_id").agg(F.count("*").alias("n"), *(one(k) for k in wanted)))
    every = per.agg(F.sum("n").alias("all"), *(F.sum(f"c{k}").alias(f"t{k}") for k in wanted))
    cells = F.array(*(F.struct(F.lit(k).alias("digit"), (F.col(f"c{k}") / F.col("n")).alias("p"), (F.col(f"t{k}") / F.col("all")).alias("q")) for k in wanted))
    return per.where(F.col("n") >= least).join(F.broadcast(every)).select("entity_id", "n", F.col("all"), cells.alias("cells"))


def _chi2(cells: str) -> F.Column:
    return F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + F.pow(c["p"] - c["q"], 2) / (c["q"] + EPS))


def benford(events: DataFrame, least: int = 8) -> DataFrame:
    """One minus the tail of the chi-square of first-digit shares, 8 degrees."""
    t = _table(events, False, least)
    return t.select("entity_id", (1 - chi2_sf_even8(_chi2("cells"))).alias("score"))


def benford_ks(events: DataFrame, least: int = 8) -> DataFrame:
    """Four times the largest gap between cumulated shares, at most 1."""
    t = _table(events, False, least)
    step = lambda acc, c: F.struct(
        (acc["run"] + c["p"] - c["q"]).alias("run"), F.greatest(acc["gap"], F.abs(acc["run"] + c["p"] - c["q"])).alias("gap")
    )
    gap = F.aggregate("cells", F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("gap")), step, lambda acc: acc["gap"])
    return t.select("entity_id", F.least(4 * gap, F.lit(1.0)).alias("score"))


def benford_second(events: DataFrame, least: int = 20, overall: int = 30) -> DataFrame:
    """As ``benford`` on second digits, 9 degrees, amounts of 1 and more."""
    t = _table(events, True, least).where(F.col("all") >= overall)
    return t.select("entity_id", (1 - chi2_sf_odd9(_chi2("cells"))).alias("score"))
