"""Audit of how filters interact, over all orders of applying them.

Each document has a mask of the filters that it fails. What any order removes,
and in which step, follows from how many documents of a part have which mask, so
texts are read for the masks alone and orders are worked out on counts: at most
32 masks a part. Duplicates are found by refining a partition of the texts, first
by their length, then by hashes of successive blocks; classes of one row drop out
of each round, and the texts that survive are compared in full.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._common import materialize

FILTERS = "ABCDE"
#: Code points at which a text's blocks end; the last block takes the rest.
BLOCKS = (64, 1024)
#: A class of over this share of all rows is heavy: there are at most as many.
HEAVY = 10_000
WORD_GAP = r"[\x20\x09-\x0D]+"


def masks(text: Column) -> Column:
    """The bits of filters A to D that a text fails: A is bit 0."""
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    count, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    fails = [count < 50, 100 * distinct < 65 * count, 100 * capitals.cast("long") > 5 * F.length(text), text.rlike(r"[#$%&*|]")]
    bits = [F.when(fail, 1 << i).otherwise(0) for i, fail in enumerate(fails)]
    return (bits[0] + bits[1] + bits[2] + bits[3]).cast("int")


def block_hashes(text: Column, bits: int) -> list[Column]:
    """The text's length and a hash of each of its blocks, of ``bits`` bits."""
    starts, ends = (0, *BLOCKS), (*BLOCKS, 2**31 - 2)
    parts = [F.substring(text, a + 1, b - a) for a, b in zip(starts, ends, strict=True)]
    return [F.length(text).alias("k0"), *(F.shiftrightunsigned(F.xxhash64(p), 64 - bits).alias(f"k{i}") for i, p in enumerate(parts, 1))]


KEYS = [f"k{i}" for i in range(len(BLOCKS) + 2)]


def met(rows: DataFrame, classes: DataFrame, keys: list[str], size: str, total: int, how: str = "inner", most: int = 1_000_000) -> DataFrame:
    """``rows`` joined to a stored table with one row a class. Up to ``most``
    classes are sent to all tasks. Beyond that only those with more than 1 in
    ``HEAVY`` of all rows are, of which there are fewer than ``HEAVY``, and the
    others' join is a shuffle in which no key is large."""
    if classes.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(classes), keys, how)
    large = F.col(size) > total / HEAVY
    heavy = F.broadcast(classes.where(large))
    rest = rows.join(heavy.select(*keys), keys, "left_anti").join(classes.where(~large), keys, how)
    return rows.join(heavy, keys, "left_semi" if how == "left_semi" else "inner").unionByName(rest)


def refined(classes: DataFrame, total: int, most: int = 1_000_000) -> DataFrame:
    """The classes (keys, n) that may hold equal texts: in each round rows whose
    length, then whose first block, then next block is like no other's drop out."""
    for depth in range(1, len(KEYS) + 1):
        keys = KEYS[:depth]
        alike = classes.groupBy(*keys).agg(F.sum("n").alias("alike")).where("alike > 1")
        classes = materialize(met(classes, materialize(alike, "alike"), keys, "alike", total, "left_semi", most), "alive")
    return classes


def with_first(docs: DataFrame, bits: int = 64, most: int = 1_000_000) -> DataFrame:
    """(doc_id, part, mask, first): ``first`` is the smallest doc_id with the same
    text if another row may have it, else null."""
    text = F.coalesce("text", F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = materialize(read.select("doc_id", "part", masks(F.col("text")).alias("mask"), *block_hashes(F.col("text"), bits)), "masks")
    total = rows.count()
    classes = materialize(rows.groupBy(*KEYS).agg(F.count("*").alias("n")), "classes")
    alive = refined(classes, total, most)
    # Full texts of the survivors: equal ones meet in the map tasks already.
    keyed = read.select("doc_id", "text", *block_hashes(F.col("text"), bits))
    texts = met(keyed, alive, KEYS, "n", total, "left_semi", most).groupBy(*KEYS, "text").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    texts = materialize(texts, "texts")
    per_key = materialize(texts.groupBy(*KEYS).agg(F.count("*").alias("texts"), F.min("first").alias("first"), F.sum("n").alias("n")), "firsts")
    found = met(rows, per_key, KEYS, "n", total, "left", most)
    if not per_key.where("texts > 1").limit(1).count():
        return found.select("doc_id", "part", "mask", "first")
    # Different texts with equal hashes: their rows meet the texts themselves.
    mixed = texts.join(per_key.where("texts > 1").select(*KEYS), KEYS, "left_semi")
    whole = read.select("doc_id", "part", "text", masks(F.col("text")).alias("mask"), *block_hashes(F.col("text"), bits))
    apart = met(whole, materialize(mixed, "mixed"), [*KEYS, "text"], "n", total, "inner", most)
    plain = found.where("texts is null or texts = 1")
    return plain.select("doc_id", "part", "mask", "first").unionByName(apart.select("doc_id", "part", "mask", "first"))


def mask_counts(docs: DataFrame, labels: DataFrame, bits: int = 64, most: int = 1_000_000) -> DataFrame:
    """(part, mask, n, good, toxic), at most 32 rows a part."""
    rows = with_first(docs, bits, most)
    repeat = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    rows = rows.withColumn("mask", F.col("mask") + repeat)
    # Counted by id first, so that no id is many rows of the join.
    per_id = rows.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    said = said.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("good").alias("good"), F.bool_or("toxic").alias("toxic"))
    counted = lambda name: F.sum(F.when(F.col(name), F.col("n")).otherwise(0))
    per_part = per_id.join(said, "doc_id", "left").groupBy("part", "mask")
    return per_part.agg(F.sum("n").alias("n"), counted("good").alias("good"), counted("toxic").alias("toxic"))


def _steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bits applied before, bit of the step's filter), 600 in all."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    orders = ["".join(p) for p in permutations(FILTERS)]
    return [(o, i + 1, sum(bit[f] for f in o[:i]), bit[o[i]]) for o in orders for i in range(len(o))]


def interactions(docs: DataFrame, labels: DataFrame, bits: int = 64, most: int = 1_000_000) -> DataFrame:
    """One row for each part, order of the five filters and step.

    A null text is empty, a null source the part ''. A row without a doc_id has
    no place among ids: it is never a repeat, nor is another one for its sake.
    Repeated rows of one id count each and aren't repeats of each other. If labels
    repeat an id, any of its rows counts. An empty table has no parts; other
    columns are ignored. ``bits`` narrows the block hashes, for tests of collisions.
    """
    spark = docs.sparkSession
    counts = materialize(mask_counts(docs, labels, bits, most), "mask-counts")
    steps = _steps()
    # 80 pairs of filters applied before and a filter; their sums give all orders.
    pairs = F.explode(F.array(*[F.struct(F.lit(b).alias("before"), F.lit(f).alias("own")) for b, f in sorted({s[2:] for s in steps})]))
    each = counts.select("*", pairs.alias("pair")).select("part", "mask", "n", "good", "toxic", "pair.*")
    own, before = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    when = lambda condition, name="n": F.coalesce(F.sum(F.when(condition, F.col(name)).otherwise(0)), F.lit(0)).cast("long")
    sums = each.groupBy("part", "before", "own").agg(
        when(~own & ~before).alias("kept"), when(own & ~before).alias("removed"), when(own & before).alias("redundant"),
        when(F.col("mask") == F.col("own")).alias("unique_fails"), when(own & ~before, "good").alias("good_lost"), when(own & ~before, "toxic").alias("toxic_lost"),
    )
    sums = materialize(sums, "sums")
    k = F.bit_count("before").cast("int")
    orders_of = F.element_at(F.array(*[F.lit(factorial(i) * factorial(4 - i)) for i in range(5)]), k + 1)
    shares = sums.groupBy("part", "own").agg(F.sum(F.col("removed") * orders_of).cast("long").alias("shapley"))
    table = spark.createDataFrame(steps, "filter_order string, step int, before int, own int")
    met_all = sums.join(F.broadcast(table), ["before", "own"]).join(shares, ["part", "own"])
    return met_all.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def sql() -> str:
    """DuckDB SQL for ``interactions``."""
    words = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    values = ", ".join(f"('{o}', {i}, {b}, {f})" for o, i, b, f in _steps())
    return f"""with
said as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
texts as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
split as (select doc_id, part, t, {words} as w, min(doc_id) over (partition by t) as first from texts),
masked as (select s.part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
  case when len(w) < 50 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 65 * len(w) then 2 else 0 end
  + case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) then 4 else 0 end
  + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end + case when s.doc_id > first then 16 else 0 end as mask
  from split s left join said l on l.doc_id = s.doc_id),
counts as (select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from masked group by part, mask),
steps(filter_order, step, before, own) as (values {values}),
audit as (select part, filter_order, step, own,
  coalesce(sum(n) filter (mask & (before | own) = 0), 0)::bigint as kept,
  coalesce(sum(n) filter (mask & own <> 0 and mask & before = 0), 0)::bigint as removed,
  coalesce(sum(n) filter (mask & own <> 0 and mask & before <> 0), 0)::bigint as redundant,
  coalesce(sum(n) filter (mask = own), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (mask & own <> 0 and mask & before = 0), 0)::bigint as good_lost,
  coalesce(sum(toxic) filter (mask & own <> 0 and mask & before = 0), 0)::bigint as toxic_lost
  from counts, steps group by part, filter_order, step, own)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, own))::bigint as shapley from audit"""
