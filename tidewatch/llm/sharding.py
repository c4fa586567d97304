"""Sharding by weighted rendezvous hashing of stable record keys.

Every (key, shard) pair has a hash; the shard whose weighted score is best takes
the record. A shard's scores don't depend on the others, so a shard that is
added takes rows only into itself, and one that goes gives up only its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rank buckets in a shard, so that no task numbers a whole shard.
BUCKETS = 1024


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard (from 0) of a string key; a null key counts as empty.

    Scores are weight / -ln(u), where u in (0, 1) is the pair's hash over 2^63.
    Ties, which need equal hashes, go to the lower shard.
    """
    key = F.coalesce(key, F.lit(""))
    scores = []
    for i, weight in enumerate(weights):
        if weight <= 0:
            raise ValueError("weights are positive")
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(i)), 1).cast("double")
        u = (bits + 0.5) / F.lit(float(2**63))
        scores.append(F.struct((F.lit(float(weight)) / -F.log(u)).alias("score"), F.lit(-i).alias("shard")))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["shard"]).cast("int")


def with_slots(df: DataFrame, shard: str, order: Sequence[str], spread: Column) -> DataFrame:
    """``df`` with ``slot``: gapless from 0 within each shard. Rows are numbered
    within (shard, bucket of ``spread``), and each bucket starts where the
    shard's buckets before it end; of those there are at most shards * BUCKETS.
    """
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(spread), F.lit(BUCKETS)).cast("int"))
    counts = dealt.groupBy(shard, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(shard, "_bucket").orderBy(*order)
    numbered = dealt.withColumn("_nth", F.row_number().over(within) - 1)
    met = numbered.join(F.broadcast(starts), [shard, "_bucket"])
    return met.withColumn("slot", F.col("_start") + F.col("_nth")).drop("_bucket", "_nth", "_start")


def assign(docs: DataFrame, weights: Sequence[float] = (1.0,) * 24, added: float = 1.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row.

    ``law`` is ``key``: doc_id and the shards alone decide. A null text has
    size 8 and the checksum of nothing; a null doc_id is the empty key. Repeated
    rows share a shard and have slots of their own. An empty table stays empty.
    """
    key = F.col("doc_id").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, weights).alias("shard"),
        shard_of(key, [*weights, added]).alias("grown_shard"),
    )
    spread = F.struct("doc_id", "text_crc32", "size")
    slotted = with_slots(rows, "shard", ["doc_id", "text_crc32", "size"], spread)
    return slotted.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
