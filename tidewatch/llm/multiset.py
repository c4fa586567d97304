"""Homomorphic multiset fingerprints of documents, in DataFrame expressions only.

A text is a multiset of paragraph pieces (lines, cut again at clause ends). Each
piece is hashed to a wide vector and a document's fingerprint is the sum of its
pieces' vectors modulo powers of two, so order doesn't matter, equal multisets
have equal sums, and a piece is inserted or deleted by one addition.

A vector has the piece count, ``DENSE`` lanes modulo 2^32 that decide equality,
and 64 bit lanes modulo 2^32 that count set hash bits. Every two dense lanes and
the bit lanes are hashed from the piece's text under seeds of their own, so that
pieces which collide in one hash differ in the others. Around half the count the
bit lanes are sums of random signs, whose cosine estimates how much two
multisets share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm._common import fan_out

DENSE = 8
_LOW = 0xFFFFFFFF
_PAIR = 0x0000000100000001


def piece_hashes(text: Column) -> Column:
    """For each of a text's pieces, blanks at their ends left out, 64-bit hashes
    under seeds 0 (the bit lanes) and 1 to ``DENSE`` / 2 (two dense lanes each)."""
    pieces = F.transform(F.split(text, r"(?<=[.!?,;:])\s+|[\r\n]+"), lambda p: F.trim(p))
    # The seed goes first: the text is then hashed from another state each time.
    seeded = [lambda p, i=i: F.xxhash64(F.lit(i), p).alias(f"h{i}") for i in range(DENSE // 2 + 1)]
    return F.transform(F.filter(pieces, lambda p: p != ""), lambda p: F.struct(*(h(p) for h in seeded)))


def vector(hashes: Column) -> Column:
    """array<long>: piece count, dense lanes, bit lanes. ``hashes`` should be a
    plain column: each lane walks it."""
    zero = F.lit(0).cast("long")

    def total(of) -> Column:
        return F.aggregate(hashes, zero, lambda acc, h: acc + of(h))

    dense = [total(half(f"h{i}")) for i in range(1, DENSE // 2 + 1) for half in (_low, _high)]
    # Two bit lanes to a long: neither reaches the other below 2^32 pieces.
    pairs = F.array(*(total(_bits(j)) for j in range(32)))
    lanes = F.concat(F.transform(pairs, lambda x: x.bitwiseAND(F.lit(_LOW))), F.transform(pairs, lambda x: F.shiftrightunsigned(x, 32)))
    head = F.array(F.size(hashes).cast("long"), *(d.bitwiseAND(F.lit(_LOW)) for d in dense))
    return F.concat(head, lanes)


def _low(name: str):
    return lambda x: x[name].bitwiseAND(F.lit(_LOW))


def _high(name: str):
    return lambda x: F.shiftrightunsigned(x[name], 32)


def _bits(j: int):
    return lambda x: F.shiftrightunsigned(x["h0"], j).bitwiseAND(F.lit(_PAIR))


def add(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint vector of a multiset with ``b``'s pieces inserted, or
    with ``sign`` -1 deleted."""
    return F.zip_with(a, b, lambda x, y: (x + sign * y).bitwiseAND(F.lit(_LOW)))


def as_text(v: Column) -> Column:
    """The vector as lower-case hex, eight digits to a lane."""
    return F.lower(F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: one for equal vectors, else the cosine of the sign sums, not
    below zero; zero if one side alone is empty."""
    signs = lambda v: F.transform(F.slice(v, DENSE + 2, 64), lambda x: (2 * x - v[0]).cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, z: acc + z)
    x, y = signs(a), signs(b)
    size = F.sqrt(dot(x, x) * dot(y, y))
    cosine = F.when(size > 0, dot(x, y) / F.when(size > 0, size)).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for each row; a null, empty or blank text is the
    empty multiset, all zeros. Repeated rows repeat, null ids stay null, other
    columns are ignored, an empty table stays empty."""
    hashed = docs.select(F.col("doc_id").cast("long"), piece_hashes(F.coalesce("text", F.lit(""))).alias("hashes"))
    return hashed.select("doc_id", vector(F.col("hashes")).alias("v")).select("doc_id", as_text(F.col("v")).alias("fingerprint"))


def with_next(rows: DataFrame, carried: list[str], parts: int) -> DataFrame:
    """``rows`` with struct column ``next``: the ``carried`` columns of the row
    that follows in (doc_id, tie) order, the first row's for the last.

    Rows are dealt to ``parts`` ranges of doc_id at its quantiles and ordered
    within each; the first row of a range is also sent to the range before it,
    where it stands last. No task sees more than its range.
    """
    bounds = sorted(set(rows.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    cuts = F.array(*(F.lit(int(b)).cast("long") for b in bounds)) if bounds else F.array().cast("array<long>")
    place = F.lit(0)
    step = 1 << max(0, len(bounds).bit_length() - 1)
    if bounds:
        steps = []
        while step:
            steps.append(step)
            step >>= 1
        place = F.aggregate(
            F.array(*(F.lit(s) for s in steps)), F.lit(0),
            lambda at, s: F.when((at + s <= len(bounds)) & (F.get(cuts, at + s - 1) <= F.col("doc_id")), at + s).otherwise(at),
        )
    dealt = rows.withColumn("range", place)
    order = F.struct("doc_id", "tie")
    # One row for each range: at most ``parts``.
    firsts = dealt.groupBy("range").agg(F.min(order).alias("head"))
    around = Window.orderBy("range")
    ends = firsts.select(
        "range", "head", F.coalesce(F.lag("range").over(around), F.last("range").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before")
    )
    met = dealt.join(F.broadcast(ends), "range")
    own = F.struct(F.col("range").alias("to"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("before").alias("to"), F.lit(True).alias("guest"))
    sent = met.select("*", F.explode(F.when(F.col("head") == order, F.array(own, guest)).otherwise(F.array(own))).alias("seat")).drop("head", "before")
    seated = Window.partitionBy("seat.to").orderBy("seat.guest", "doc_id", "tie")
    return sent.withColumn("next", F.lead(F.struct(*carried)).over(seated)).where("not seat.guest").drop("seat", "range")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) for each row.

    The edited text has the last quarter of its code points replaced by as many
    from the front of the next document's, or all there are. Null texts are
    empty. Null ids come first in the order and repeated ids are ordered by a
    hash of their text; a single row is its own next. An empty table stays
    empty; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    hashed = rows.withColumn("hashes", piece_hashes(F.col("text")))
    own = hashed.select("doc_id", "text", "tie", vector(F.col("hashes")).alias("v"))
    met = with_next(own, ["text", "v"], fan_out(docs.sparkSession))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = met.select(
        "doc_id", n.cast("long").alias("n_chars"), "v", F.col("next.v").alias("next_v"),
        F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next.text", F.lit(1), quarter)).alias("edited"),
    )
    again = edited.withColumn("edited_hashes", piece_hashes(F.col("edited")))
    both = again.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "v", "next_v", vector(F.col("edited_hashes")).alias("w"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("v")).alias("fingerprint"), as_text(F.col("w")).alias("edited_fingerprint"),
        likeness(F.col("v"), F.col("w")).alias("near_edited"), likeness(F.col("v"), F.col("next_v")).alias("near_next"),
    )
