"""SimHash near-duplicates linked through Gray-order hierarchical indexes.

Fingerprints are made once per text and reduced to the distinct values, so a
group of exact copies costs one index entry. Values within ``max_bits`` of each
other agree on at least one of ``max_bits + 1`` bit segments; each segment value
is a block, and inside a block a hierarchical index over the Gray-ordered values
finds the links. A block emits a spanning forest, never all its pairs. Forests
are merged by star contraction, which runs distributed to its fixed point.

``near_copies`` links by shingle similarity instead: sketches of several
fingerprints block texts by bands of bits, the same index finds candidates in a
block, and every link that joins two groups is verified on the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._common import fan_out, materialize, sent, text_slices, tidy
from tidewatch.llm.merges import mix

#: Shingles whose bits are counted at a time, and leaves under one index node.
BLOCK, FANOUT = 250_000, 16
#: Distinct fingerprints in one block before it is divided further.
MAX_BLOCK = 100_000
#: Blocks up to so many texts are compared side by side, without an index, those
#: up to ``WIDE`` texts one by one.
SMALL, WIDE = 64, 4096
#: Each byte's bits, one to a byte of a long: sums of up to 255 don't carry.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of ``width`` words, as unsigned 64 bits."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = [words] if len(words) < width else zip(*(words[i:] for i in range(width)), strict=False)
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(42)), np.uint64)


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set in the hashes from each start on."""
    sizes = np.diff(np.append(starts, len(hashes)))
    pieces = -(-sizes // 255)
    first = np.cumsum(pieces) - pieces
    cuts = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    sums = np.add.reduceat(_LANES[hashes.view(np.uint8)].reshape(-1, 8), cuts, axis=0)
    return np.add.reduceat(sums.view(np.uint8).reshape(-1, 64), first, axis=0, dtype=np.int64)


def sketches(texts: list[str], width: int, words: int) -> np.ndarray:
    """(texts, words): the majority bits of each text's shingle hashes, then of
    the same hashes mixed anew for each further word; zero without words."""
    counts, sizes = np.zeros((len(texts), words, 64), np.int64), np.zeros(len(texts), np.int64)
    pending: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        rows = [i for i, _ in pending]
        hashes = np.concatenate([h for _, h in pending])
        starts = np.cumsum([0, *(len(h) for _, h in pending)])[:-1]
        for j in range(words):
            with np.errstate(over="ignore"):
                mine = mix(hashes + np.uint64(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) if j else hashes
            np.add.at(counts, (rows, j), bit_counts(mine, starts))
        pending.clear()

    held = 0
    for i, text in enumerate(texts):
        hashes = shingle_hashes(text, width)
        sizes[i] = len(hashes)
        for at in range(0, len(hashes), BLOCK):
            piece = hashes[at : at + BLOCK]
            pending.append((i, piece))
            held += len(piece)
            if held >= BLOCK:
                flush()
                held = 0
    if pending:
        flush()
    set_bits = (2 * counts > sizes[:, None, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=2, bitorder="little").view("<u8").reshape(len(texts), words)


def fingerprints(texts: list[str], width: int) -> np.ndarray:
    """One 64-bit fingerprint for each text."""
    return sketches(texts, width, 1).ravel()


def with_fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_slices(batches, 4_000_000):
            fp = fingerprints(texts, width).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each code word in the reflected Gray order."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Nodes over Gray-ordered fingerprints. A node keeps the bits on which all
    below it agree (``mask``, ``bits``); a level above factors what its own
    children share. ``levels[0]`` is the fingerprints themselves."""

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps = fps[self.order]
        full = np.full(len(fps), ~np.uint64(0))
        self.levels = [(full, self.fps)]
        while len(self.levels[-1][0]) > 1:
            mask, bits = self.levels[-1]
            starts = np.arange(0, len(mask), FANOUT)
            ones = np.bitwise_and.reduceat(bits, starts)
            zeros = np.bitwise_and.reduceat(~bits, starts)
            mask = np.bitwise_and.reduceat(mask, starts) & (ones | zeros)
            self.levels.append((mask, ones & mask))

    def distance(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits that differ among those which both nodes have factored: a lower
        bound for any pair below them, which only grows on the way down."""
        mask, bits = self.levels[level]
        return np.bitwise_count((bits[a] ^ bits[b]) & mask[a] & mask[b])

    def forest(self, *reaches: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Index pairs that span every component of pairs within each of the
        rising ``reaches``: of two ways to join groups the nearer is taken."""
        n, edges = len(self.fps), []
        label = np.arange(n)
        max_bits = reaches[0]

        def link(a: np.ndarray, b: np.ndarray) -> None:
            nonlocal label
            while len(a):
                ra, rb = label[a], label[b]
                keep = ra != rb
                a, b, ra, rb = a[keep], b[keep], ra[keep], rb[keep]
                if not len(a):
                    return
                high, low = np.maximum(ra, rb), np.minimum(ra, rb)
                _, first = np.unique(high, return_index=True)
                label[high[first]] = low[first]
                edges.append((a[first], b[first]))
                while not np.array_equal(up := label[label], label):
                    label = up

        def uniform(level: int) -> np.ndarray:
            """The single component below each node, or -1."""
            starts = np.arange(0, n, FANOUT**level)
            low, high = np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts)
            return np.where(low == high, low, -1)

        def descend(level: int, a: np.ndarray, b: np.ndarray) -> None:
            one = uniform(level)
            todo = (one[a] < 0) | (one[a] != one[b])
            a, b = a[todo], b[todo]
            near = self.distance(level, a, b) <= max_bits
            a, b = a[near], b[near]
            if level == 0:
                link(a, b)
                return
            below = len(self.levels[level - 1][0])
            for at in range(0, len(a), 4096):
                ca = (a[at : at + 4096, None] * FANOUT + np.arange(FANOUT))[:, :, None]
                cb = (b[at : at + 4096, None] * FANOUT + np.arange(FANOUT))[:, None, :]
                ca, cb = (x.ravel() for x in np.broadcast_arrays(ca, cb))
                keep = (ca < below) & (cb < below) & ((ca < cb) if level == 1 else (ca <= cb))
                descend(level - 1, ca[keep], cb[keep])

        top = len(self.levels) - 1
        for max_bits in reaches:
            for step in (1, 2):
                a = np.arange(n - step)
                link(a[near := self.distance(0, a, a + step) <= max_bits], a[near] + step)
            if top:
                descend(top, np.zeros(1, np.int64), np.zeros(1, np.int64))
        return edges


def _segment(fp: F.Column, low: int, width: int) -> F.Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def _segments(max_bits: int) -> list[tuple[int, int]]:
    cuts = [64 * i // (max_bits + 1) for i in range(max_bits + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _block_edges(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(fps: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            values = np.concatenate(fps)
            if len(values) < 2:
                return
            index = GrayIndex(values)
            found = index.forest(max_bits)
            if found:
                a, b = (index.fps[np.concatenate(x)].view(np.int64) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        last, held = None, []
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            fp = batch.column("fp").to_numpy().view(np.uint64)
            if not len(fp):
                continue
            cuts = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(fp)], strict=True):
                key = (k1[lo], k2[lo])
                if key != last and held:
                    yield from out(held)
                    held = []
                last = key
                held.append(fp[lo:hi])
        if held:
            yield from out(held)

    return run


def links(distinct: DataFrame, max_bits: int = 4, max_block: int = MAX_BLOCK) -> DataFrame:
    """(a, b): pairs of fingerprints that span every component of the distinct
    column ``fp`` under Hamming distance ``max_bits``.

    A block over ``max_block`` values is divided by a second segment of the bits
    outside its own: the same pigeonhole, so no link is lost.
    """
    spark = distinct.sparkSession
    parts = _segments(max_bits)
    fp = F.col("fp")
    first = F.array(*(F.lit(i).cast("long") * (1 << 24) + _segment(fp, lo, w) for i, (lo, w) in enumerate(parts)))
    blocks = distinct.select("fp", F.explode(first).alias("k1"))
    large = blocks.groupBy("k1").count().where(F.col("count") > max_block).select("k1", F.lit(True).alias("large"))

    def within(outer: int) -> F.Column:
        rest = [(lo + i, 1) for j, (lo, w) in enumerate(parts) if j != outer for i in range(w)]
        cuts = [len(rest) * i // (max_bits + 1) for i in range(max_bits + 2)]
        keys = []
        for i, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
            value = reduce(
                lambda acc, bit: F.shiftleft(acc, 1).bitwiseOR(_segment(fp, bit[0], 1)), rest[x:y], F.lit(0).cast("long")
            )
            keys.append(F.lit(i).cast("long") * (1 << 24) + value)
        return F.array(*keys)

    second = F.lit(None).cast("array<long>")
    for i in range(len(parts)):
        second = F.when(F.shiftright(F.col("k1"), 24) == i, within(i)).otherwise(second)
    keyed = blocks.join(large, "k1", "left").select(
        "fp", "k1", F.explode(F.when(F.col("large"), second).otherwise(F.array(F.lit(-1).cast("long")))).alias("k2")
    )
    dealt = keyed.repartition(fan_out(spark), "k1", "k2").sortWithinPartitions("k1", "k2")
    return dealt.mapInArrow(_block_edges(max_bits), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable from each node of ``edges(a, b)``,
    by alternating large and small stars until nothing changes."""

    def state(e: DataFrame) -> tuple:
        row = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        else:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        met = both.join(least, "u")
        if large:
            out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        return out.where("a <> b").distinct()

    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "stars")
    before = None
    while (now := state(edges)) != before:
        before = now
        edges = materialize(star(star(edges, True), False), "stars")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4, max_block: int = MAX_BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Null and blank texts have fingerprint zero and link like any other; a text
    under ``width`` words is one shingle. Repeated rows each return a row. The
    component is the least non-null doc_id reachable over fingerprints at most
    ``max_bits`` apart. An empty table returns no rows; other columns are
    ignored.
    """
    rows = materialize(with_fingerprints(docs, width), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, max_bits, max_block))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "named")
    # Only components of several fingerprints need their least id looked up.
    several = named.where("root <> fp").groupBy("root").agg(F.min("least").alias("other"))
    own = named.where("root = fp").select("root", "least").join(several, "root", "left")
    least = own.select("root", F.least("least", "other").alias("component_id"))
    of_fp = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _few_pairs(fp: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray] | None:
    """All pairs of one block within ``reach``; None if they are over three a text."""
    a, b, held = [], [], 0
    for at in range(0, len(fp), 256):
        x, y = np.nonzero(np.bitwise_count(fp[at : at + 256, None] ^ fp[None, at:]) <= reach)
        some = y > x
        a.append(at + x[some])
        b.append(at + y[some])
        held += int(some.sum())
        if held > 3 * len(fp):
            return None
    return np.concatenate(a), np.concatenate(b)


def _band_edges(reach: int):
    """Candidates of blocks sorted by (k1, k2): all within ``reach`` where they
    are few, a forest of the nearest in dense blocks and in those over ``WIDE``.
    Such a block is told as a row (k1, k2, -1)."""
    reaches = (reach * 3 // 8, reach * 11 // 16, reach)

    def found(k1: np.ndarray, k2: np.ndarray, node: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(node) < 2:
            return
        cuts = np.concatenate([[0], np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1])
        sizes = np.diff(np.append(cuts, len(node)))
        block = np.repeat(np.arange(len(cuts)), sizes)
        # Past a row, so many more of its block: none where the block is large.
        left = np.where(sizes <= SMALL, sizes, 0)[block] - (np.arange(len(node)) - cuts[block]) - 1
        pairs, at, lag = [], np.flatnonzero(left > 0), 1
        while len(at):
            near = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= reach]
            pairs.append((near, near + lag))
            lag += 1
            at = at[left[at] >= lag]
        a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int64),) * 2
        dense = (np.bincount(block[a], minlength=len(cuts)) > 3 * sizes) | (sizes > WIDE)
        keep = ~dense[block[a]]
        a, b = [a[keep]], [b[keep]]
        # Large blocks of texts that chance alone brought together are no dense ones.
        for i in np.flatnonzero((sizes > SMALL) & ~dense):
            few = _few_pairs(fp[cuts[i] : cuts[i] + sizes[i]], reach)
            if few is None:
                dense[i] = True
            else:
                a.append(cuts[i] + few[0])
                b.append(cuts[i] + few[1])
        for i in np.flatnonzero(dense):
            index = GrayIndex(fp[cuts[i] : cuts[i] + sizes[i]])
            for x, y in index.forest(*reaches):
                a.append(cuts[i] + index.order[x])
                b.append(cuts[i] + index.order[y])
        a, b = np.concatenate(a), np.concatenate(b)
        bits = np.append(np.bitwise_count(fp[a] ^ fp[b]).astype(np.int32), np.full(dense.sum(), -1, np.int32))
        high, low = np.maximum(node[a], node[b]), np.minimum(node[a], node[b])
        high, low = np.append(high, k1[cuts[dense]]), np.append(low, k2[cuts[dense]])
        yield pa.RecordBatch.from_arrays([pa.array(high), pa.array(low), pa.array(bits)], ["a", "b", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)]
        for batch in batches:
            new = [batch.column(c).to_numpy() for c in ("k1", "k2", "node")] + [batch.column("fp").to_numpy().view(np.uint64)]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            k1, k2 = held[:2]
            if not len(k1):
                continue
            # The last block may go on in the next batch.
            done = int(np.searchsorted(k1, k1[-1]))
            done += int(np.searchsorted(k2[done:], k2[-1]))
            yield from found(*(x[:done] for x in held))
            held = [x[done:] for x in held]
        yield from found(*held)

    return run


def band_blocks(sketched: DataFrame, words: int, band_bits: int, max_block: int = MAX_BLOCK) -> DataFrame:
    """(k1, k2, node, fp): the distinct ``node`` of ``sketched(node, sketch
    array<long>)`` in the blocks of their bands.

    Texts share a block if they agree on a band of ``band_bits``, four of which
    are cut from each word; ``fp`` is the word half the sketch away. A block over
    ``max_block`` is dealt by hash into groups, and every two groups meet in a
    block of their own, so that no pair is lost.
    """
    word = lambda j: F.col("sketch")[j]
    bands = [
        F.struct((F.lit(4 * j + i).cast("long") * (1 << band_bits) + _segment(word(j), 16 * i, band_bits)).alias("k1"), word((j + words // 2) % words).alias("fp"))
        for j in range(words) for i in range(4)
    ]
    rows = sketched.select("node", F.explode(F.array(*bands)).alias("x")).select("node", "x.k1", "x.fp")
    # Only the few large blocks are listed.
    large = rows.groupBy("k1").count().where(F.col("count") > max_block).select("k1", F.ceil(F.col("count") * 2 / max_block).alias("groups"))
    large = sent(materialize(large, "large"))
    mine = F.pmod(F.xxhash64("node"), F.col("groups"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1), lambda t: F.least(mine, t) * F.col("groups") + F.greatest(mine, t))
    return rows.join(large, "k1", "left").select(
        "k1", F.explode(F.when(F.col("groups").isNotNull(), cells).otherwise(F.array(F.lit(-1).cast("long")))).alias("k2"), "node", "fp"
    )


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(fan_out(rows.sparkSession), "k1", "k2").sortWithinPartitions("k1", "k2")


def band_links(blocks: DataFrame, reach: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, bits): candidate pairs a > b of texts that share a block, with the
    bits in which they differ there, and (k1, k2): the blocks of which not all
    pairs within reach are candidates."""
    found = materialize(_dealt(blocks).mapInArrow(tidy(_band_edges(reach)), "a long, b long, bits int"), "band-links")
    edges = found.where("bits >= 0").groupBy("a", "b").agg(F.min("bits").alias("bits"))
    return edges, found.where("bits < 0").select(F.col("a").alias("k1"), F.col("b").alias("k2"))


def similarity(a: str, b: str, width: int) -> float:
    """Jaccard similarity of two texts' sets of shingles; 1 if both have none."""
    x, y = (np.unique(shingle_hashes(t, width)) for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """(a, b, near): whether the texts of two nodes reach ``least``. ``texts`` is
    (node, text), each node once; a node met by very many others is a skewed
    join, which is split at run time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [similarity(x.as_py(), y.as_py(), width) >= least for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near, pa.bool_())], ["a", "b", "near"])

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long, near boolean")


#: Texts of one side of a tile.
TILE = 192


def _between(reach: int, width: int, least: float):
    """Links between groups of one tile: of its pairs of different groups within
    ``reach`` sketch bits those that are verified, one for any two groups."""

    def run(table: pa.Table) -> pa.Table:
        node, root, part = (table.column(c).to_numpy() for c in ("node", "root", "part"))
        sketch = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
        texts, two = table.column("text"), part.min() != part.max()
        group, sets = np.unique(root, return_inverse=True)[1], {}

        def shingles(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = np.unique(shingle_hashes(texts[i].as_py(), width))
            return sets[i]

        found: list[tuple[int, int]] = []
        for i in range(len(node)):
            near = (group != group[i]) & ((part != part[i]) if two else (np.arange(len(node)) > i))
            if two and part[i] != part.min():
                continue
            rows = np.flatnonzero(near)
            rows = rows[np.bitwise_count(sketch[rows] ^ sketch[i]).sum(axis=1) <= reach]
            for g in np.unique(group[rows]):
                if g == group[i]:
                    continue
                mine = shingles(i)
                some = rows[group[rows] == g]
                sizes = np.array([len(shingles(j)) for j in some])
                if len(mine):
                    every = np.concatenate([sets[j] for j in some])
                    hit = np.concatenate([[0], np.cumsum(mine[np.searchsorted(mine, every).clip(max=len(mine) - 1)] == every)])
                    both = hit[np.cumsum(sizes)] - hit[np.cumsum(sizes) - sizes]
                    close = both >= least * (len(mine) + sizes - both)
                else:
                    close = sizes == 0
                if close.any():
                    found.append((int(node[i]), int(node[some[close.argmax()]])))
                    group[group == g] = group[i]
        high, low = [max(p) for p in found], [min(p) for p in found]
        return pa.table({"a": pa.array(high, pa.int64()), "b": pa.array(low, pa.int64())})

    return run


def cross_links(blocks: DataFrame, dense: DataFrame, nodes: DataFrame, roots: DataFrame, texts: DataFrame, reach: int, width: int, least: float) -> DataFrame:
    """(a, b): verified links that join different groups within the ``dense``
    blocks, of all pairs that differ in at most ``reach`` bits of their sketches.
    ``roots`` is (node, root) of grouped texts.

    A block's largest group needn't be met with itself. The block's other texts,
    and those of that group, are dealt into parts of about ``TILE``; a tile has two
    parts, and its task measures and verifies all their pairs, so that pairs are
    never rows of a table and no task holds more than two parts' texts.
    """
    grouped = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    rows = materialize(blocks.select("k1", "k2", "node").join(sent(dense), ["k1", "k2"], "left_semi").join(grouped, "node"), "grouped")
    sizes = rows.groupBy("k1", "k2", "root").agg(F.count("*").alias("n"))
    block = sizes.groupBy("k1", "k2").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.max("n").alias("m"), F.sum("n").alias("n")).where("n > m")
    parts = block.select("k1", "k2", "major", F.ceil((F.col("n") - F.col("m")) / TILE).alias("strays"), F.ceil(F.col("m") / TILE).alias("majors"))
    met = rows.join(sent(materialize(parts, "parts")), ["k1", "k2"])
    own, spread = F.col("root") == F.col("major"), F.xxhash64("node", F.lit(7))
    part = F.when(own, F.col("strays") + F.pmod(spread, F.col("majors"))).otherwise(F.pmod(spread, F.col("strays")))
    last = F.when(own, F.col("strays")).otherwise(F.col("strays") + F.col("majors"))
    dealt = met.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last - 1)))
    tile = [F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y")]
    whole = dealt.select("k1", "k2", *tile, "part", "root", "node").join(nodes, "node").join(texts, "node")
    return whole.groupBy("k1", "k2", "x", "y").applyInArrow(_between(reach, width, least), "a long, b long")


def near_copies(
    docs: DataFrame, width: int = 5, least: float = 0.8, words: int = 8, band_bits: int = 14, reach: int = 16, rounds: int = 2,
    max_block: int = MAX_BLOCK, whole: float = 0.2,
) -> DataFrame:
    """(doc_id, node, root) for every row of ``docs``: its text's 64-bit hash and
    the group of texts that links of shingle similarity ``least`` or more join.

    Candidates come from ``band_links``. Each round verifies for every text its
    nearest candidate that is not yet in its group; after ``rounds`` all that
    remain are verified. Large and dense blocks gave a forest of their nearest
    pairs alone: there, all pairs of different groups that differ in at most the
    share ``whole`` of their sketches' bits are verified too, so that a candidate
    is verified or inside a group, however large its block. Equal texts are one
    node; null is the empty text, and texts without a word are alike. An empty
    table returns no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column("doc_id"), 0
            for nodes, texts in text_slices(iter([batch]), 2_000_000, "node"):
                sketch = sketches(texts, width, words).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids[at : at + len(nodes)], pa.array(nodes, pa.int64()), pa.array(list(sketch), pa.list_(pa.int64()))], ["doc_id", "node", "sketch"])
                at += len(nodes)

    seen = materialize(rows.mapInArrow(tidy(run), "doc_id long, node long, sketch array<long>"), "sketches")
    nodes = materialize(seen.groupBy("node").agg(F.first("sketch").alias("sketch")), "nodes")
    blocks = band_blocks(nodes, words, band_bits, max_block)
    edges, dense = band_links(blocks, reach)
    edges, dense = materialize(edges, "candidates"), materialize(dense, "dense")
    in_dense = blocks.join(sent(dense), ["k1", "k2"], "left_semi").select("node")
    ends = sent(materialize(edges.select(F.explode(F.array("a", "b")).alias("node")).union(in_dense).distinct(), "ends"))
    texts = materialize(rows.select("node", "text").join(ends, "node", "left_semi").dropDuplicates(["node"]), "texts")
    good = None
    for turn in range(rounds + 1):
        nearest = F.min_by(F.struct("b"), F.struct("bits", F.xxhash64("a", "b")))
        chosen = edges.groupBy("a").agg(nearest.alias("x")).select("a", "x.b") if turn < rounds else edges
        judged = materialize(verified(chosen, texts, width, least), "judged")
        good = judged if good is None else good.union(judged)
        roots = materialize(components(good.where("near").select("a", "b")), "roots")
        if turn == rounds:
            break
        of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        apart = edges.join(judged.select("a", "b"), ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
        apart = apart.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b", "bits")
        edges = materialize(apart, "candidates")
        if edges.isEmpty():
            break
    if not dense.isEmpty():
        more = materialize(cross_links(blocks, dense, nodes, roots, texts, int(whole * 64 * words), width, least), "cross")
        if not more.isEmpty():
            roots = materialize(components(good.where("near").select("a", "b").union(more)), "roots")
    return seen.select("doc_id", "node").join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))


def keep_first(docs: DataFrame, **params) -> DataFrame:
    """One row of ``docs`` for each group of ``near_copies``: the least doc_id's.

    Rows without a doc_id can't be told apart and stay. Of repeated rows with
    the same doc_id and text one stays; rows that share a doc_id but not their
    text are told apart by it. An empty table stays empty; all columns of
    ``docs`` stay, whatever their names.
    """
    grouped = materialize(near_copies(docs.where("doc_id is not null"), **params), "grouped")
    first = grouped.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("one")).select("one.*")
    copies = grouped.groupBy("doc_id", "node").agg(F.count("*").alias("copies")).join(first, ["doc_id", "node"], "left_semi")
    copies = materialize(copies, "first").select(F.col("doc_id").alias("_doc_id"), F.col("node").alias("_node"), "copies")
    known = docs.where("doc_id is not null")
    met = lambda these: (F.col("doc_id").cast("long") == these["_doc_id"]) & (F.xxhash64(F.coalesce("text", F.lit(""))) == these["_node"])
    once, again = (sent(copies.where(f"copies {many} 1").drop("copies")) for many in ("=", ">"))
    kept = known.join(once, met(once), "left_semi")
    # Whole texts are shuffled for repeated rows alone.
    repeated = known.join(again, met(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(repeated).unionByName(docs.where("doc_id is null"))
