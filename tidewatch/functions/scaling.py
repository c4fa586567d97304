"""Scaling over a whole score set.

Extremes come from one aggregate whose single row is broadcast; an unpartitioned
window would pull every row into one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.lineage import cut

EPS = 1e-9


def with_totals(df: DataFrame, **totals: Column) -> DataFrame:
    """``df`` with global aggregates as columns (one broadcast row). ``df`` has a
    row an entity; it is stored, so that what made it is not run twice."""
    df = cut(df)
    row = df.agg(*(c.alias(name) for name, c in totals.items()))
    return df.join(F.broadcast(row))


def minmax(df: DataFrame, column: str, out: str = "score", power: int = 1) -> DataFrame:
    """(x - min) / (max - min + EPS), raised to ``power``."""
    x = F.col(column)
    scaled = (x - F.col("_low")) / (F.col("_high") - F.col("_low") + EPS)
    rows = with_totals(df, _low=F.min(column), _high=F.max(column))
    return rows.withColumn(out, F.pow(scaled, power) if power != 1 else scaled).drop("_low", "_high")


def quantile(df: DataFrame, column: str, q: float, cells: int = 4096, few: int = 100_000) -> float | None:
    """The exact ``q`` quantile of a column, linear between neighbours; null where
    there is no value.

    Counts of equal cells narrow the range down to the values around the rank,
    of which at most ``few`` rows, or a single repeated value, are looked at: no
    task holds all distinct values."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    n, low, high = x.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return None
    rank = q * (n - 1)
    want, share, below = (math.floor(rank), math.ceil(rank)), rank - math.floor(rank), 0
    while n > few and low < high:
        width = (high - low) / cells
        cell = F.least(F.floor((F.col("x") - low) / width), F.lit(cells - 1)).alias("cell")
        rows = x.where(F.col("x").between(low, high)).groupBy(cell).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).orderBy("cell").collect()
        held, at = [], below
        for r in rows:
            held += [(at, r)] * any(at <= w < at + r["n"] for w in want)
            at += r["n"]
        if len(held) == 2:  # the ranks stand on either side of a gap
            return held[0][1]["b"] + (held[1][1]["a"] - held[0][1]["b"]) * share
        below, (n, low, high) = held[0][0], (held[0][1][c] for c in ("n", "a", "b"))
    if low == high:
        return low
    found, at = [], below
    for r in x.where(F.col("x").between(low, high)).groupBy("x").count().orderBy("x").collect():
        found += [r["x"] for w in want if at <= w < at + r["count"]]
        at += r["count"]
    return found[0] + (found[1] - found[0]) * share


def scoremin(df: DataFrame, column: str) -> DataFrame:
    """(entity_id, score): squared min-max of a raw anomaly value."""
    return minmax(df, column, power=2).select("entity_id", "score")


def over_max(df: DataFrame, column: str) -> DataFrame:
    """(entity_id, score): x / max(x); nothing where the maximum is not positive."""
    rows = with_totals(df, _high=F.max(column)).where("_high > 0")
    return rows.select("entity_id", (F.col(column) / F.col("_high")).alias("score"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumn("score", F.round("score", digits))


def chi2_sf_even8(x: Column) -> Column:
    """Upper tail of chi-square with 8 degrees of freedom, in closed form."""
    h = x / 2.0
    return F.exp(-h) * (1 + h + h * h / 2.0 + h * h * h / 6.0)


def chi2_sf_odd9(x: Column) -> Column:
    """Upper tail with 9 degrees: erfc(sqrt(h)) plus the half-integer terms; the
    error function by its Maclaurin-type series, good to the sizes met here."""
    h = x / 2.0
    # erf(z) = 2/sqrt(pi) * exp(-h) * sum z^(2k+1) 2^k / (2k+1)!!, z = sqrt(h)
    z = F.sqrt(h)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(z.alias("term"), z.alias("total")),
        lambda acc, k: F.struct(
            (acc["term"] * h * 2.0 / (2.0 * k + 1.0)).alias("term"),
            (acc["total"] + acc["term"] * h * 2.0 / (2.0 * k + 1.0)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    erf = F.lit(1.1283791670955126) * F.exp(-h) * series
    terms = F.exp(-h) * (
        F.pow(h, 0.5) / 0.8862269254527580 + F.pow(h, 1.5) / 1.3293403881791370
        + F.pow(h, 2.5) / 3.3233509704478426 + F.pow(h, 3.5) / 11.631728396567448
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - erf + terms))
