"""Sequence packing by non-negative least squares over the length histogram.

Texts are tokenized once. A document is cut at every full window, and what is
left over enters a histogram with at most ``window`` cells, which is all that
the driver sees. Shallow combinations of length bins that fill a window are
enumerated, their repeat counts solved against the histogram by non-negative
least squares and rounded; what the rounding leaves is packed greedily. The plan
maps ranks within a length to sequences, so executors place pieces on their own.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm._common import materialize, text_slices, tidy

END_ID = 1
#: Rank buckets of a length: one length may hold a third of all pieces.
BUCKETS = 256
#: A letter and the sentence mark behind it, which are never one token.
_MARKED = re.compile(r"([A-Za-z])([.,;:!?])(?=\s|$)")


def _byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies: itself where
    it prints, else the next code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordTokenizer:
    """A tokenizer file with a cache of whole words.

    Words between ASCII blanks are encoded alone, which gives the ids of the
    whole text because blanks always part tokens; so does a letter before a
    sentence mark, so marks are split off first. Words of letters alone go straight
    to the merge model, if a probe shows that it gives the file's ids. Texts that
    name a special token are encoded as a whole.
    """

    def __init__(self, path: str, cache: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        added = self.inner.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        self.letters = _byte_letters()
        probe = ["the", "Straße", "éclair", "ÀÉÎ", "zzyzxq", "a"]
        apart = self.inner.encode_batch_fast(probe, add_special_tokens=False)
        self.direct = all(self._model(w) == e.ids for w, e in zip(probe, apart, strict=True))
        self.room, self.known = cache, {}
        self.flat, self.first, self.lens = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def _model(self, word: str) -> list[int]:
        """Ids of a word of Latin-1 letters, by the merge model alone: what the
        file does before it comes down to lower case and byte letters."""
        return [t.id for t in self.inner.model.tokenize(word.lower().encode().decode("latin-1").translate(self.letters))]

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words end to end, and how many each has."""
        ids: list[list[int] | None] = [self._model(w) if self.direct and w.isalpha() and max(w) <= "\xff" else None for w in words]
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, e in zip(rest, self.inner.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            ids[i] = e.ids
        return np.fromiter(chain.from_iterable(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit arrays."""
        whole = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        plain = list(texts)
        for i in whole:
            plain[i] = ""
        words = [_MARKED.sub(r"\1 \2", t).replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") for t in plain]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        every = list(chain.from_iterable(words))
        codes = np.fromiter(map(self.known.get, every, repeat(-1)), np.int64, len(every))
        flat, first, lens = self.flat, self.first, self.lens
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            names: dict[str, int] = {}
            for i in missing.tolist():
                codes[i] = names.setdefault(every[i], len(lens) + len(names))
            more, sizes_of = self._new(list(names))
            first = np.concatenate([first, len(flat) + np.cumsum(sizes_of) - sizes_of])
            flat, lens = np.concatenate([flat, more]), np.concatenate([lens, sizes_of])
            if len(lens) <= self.room:
                self.known |= names
                self.flat, self.first, self.lens = flat, first, lens
        per_word = lens[codes]
        stop = np.cumsum(per_word)
        place = np.arange(stop[-1] if len(stop) else 0) + np.repeat(first[codes] - (stop - per_word), per_word)
        stream = flat[place]
        bounds = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(sizes)])]
        out = [stream[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for i in whole:
            out[i] = np.array(self.inner.encode(texts[i], add_special_tokens=False).ids, "<u4")
        return out


_loaded: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    """One tokenizer, with its cache, for each Python worker."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def pieces(docs: DataFrame, tokenizer: str, window: int) -> DataFrame:
    """One row for each piece: full windows, then the rest of the document.
    ``row`` tells apart pieces of repeated doc_ids."""
    names = ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = _tokenizer(tokenizer), 0
        for keys, texts in text_slices(batches, 2_000_000):
            rows = []
            for key, ids in zip(keys, encoder.encode(texts), strict=True):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for at in range(0, len(ids), window):
                    part = ids[at : at + window]
                    rows.append((key, row, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    schema = ", ".join(f"{n} long" for n in names)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), schema)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """The x >= 0 with least |ax - b|, by the active-set method."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    gradient = a.T @ b
    for _ in range(rounds):
        if free.all() or (best := np.where(free, -np.inf, gradient).max()) <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        free[int(np.where(free, -np.inf, gradient).argmax())] = True
        while free.any():
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            bad = free & (s <= 1e-12)
            if not bad.any():
                x = s
                break
            gap = x[bad] - s[bad]
            step = np.min(np.where(gap > 0, x[bad] / np.where(gap > 0, gap, 1), 0))
            x = x + step * (s - x)
            free &= x > 1e-12
            x[~free] = 0
        gradient = a.T @ (b - a @ x)
    return x


def combinations(bins: int, depth: int) -> list[tuple[int, ...]]:
    """Bin multisets, largest first, of up to ``depth`` bins whose middles add
    up to the window within half a bin."""
    out: list[tuple[int, ...]] = []

    def grow(chosen: tuple[int, ...], room: float) -> None:
        if chosen and abs(room) <= 0.5:
            out.append(chosen)
        if len(chosen) < depth:
            for b in range(min(chosen[-1] if chosen else bins - 1, bins - 1), -1, -1):
                if b + 0.5 <= room + 0.5:
                    grow((*chosen, b), room - b - 0.5)

    grow((), float(bins))
    return out


class _Stock:
    """Lengths still to pack, with their counts and how many are used."""

    def __init__(self, histogram: np.ndarray):
        self.left, self.used = histogram.copy(), np.zeros_like(histogram)

    def largest(self, most: int, least: int = 1, taken: dict[int, int] | None = None) -> int:
        """The largest length in [least, most] with a piece not yet taken."""
        for length in np.flatnonzero(self.left[least : most + 1])[::-1] + least:
            if self.left[length] > (taken or {}).get(int(length), 0):
                return int(length)
        return 0


def plan(histogram: np.ndarray, window: int, bins: int = 64, depth: int = 3) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, count, first sequence, offset): the pieces of a
    length with these ranks go one each to as many sequences in a row.

    ``histogram[l]`` counts pieces of length l, ``l`` up to ``window``. The
    work depends on the lengths that occur, not on how many pieces there are:
    every step either uses up a length or ends a combination, so that there are
    at most ``window`` steps more than combinations, of ``window`` rows at most.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    stock, sequence = _Stock(histogram.astype(np.int64)), 0

    def emit(lengths: list[int], times: int) -> None:
        nonlocal sequence
        offset = 0
        for length in lengths:
            rows.append((length, int(stock.used[length]), times, sequence, offset))
            stock.used[length] += times
            stock.left[length] -= times
            offset += length
        sequence += times

    def times_of(lengths: list[int], most: int) -> int:
        return min(most, *(int(stock.left[x]) // lengths.count(x) for x in set(lengths)))

    def top_up(lengths: list[int]) -> list[int]:
        room = window - sum(lengths)
        taken = {x: lengths.count(x) for x in set(lengths)}
        while room > 0 and (x := stock.largest(room, 1, taken)):
            lengths.append(x)
            taken[x] = taken.get(x, 0) + 1
            room -= x
        return lengths

    if histogram[window]:
        emit([window], int(stock.left[window]))
    step = window // bins
    target = np.array([stock.left[1 + i * step : 1 + (i + 1) * step].sum() for i in range(bins)], float)
    combos = combinations(bins, depth)
    if target.sum() and combos:
        a = np.zeros((bins, len(combos)))
        for j, c in enumerate(combos):
            np.add.at(a[:, j], list(c), 1)
        repeat = np.floor(nnls(a, target) + 0.5).astype(np.int64)
        for j in np.argsort(-repeat, kind="stable"):
            remaining = int(repeat[j])
            while remaining > 0:
                lengths: list[int] = []
                taken: dict[int, int] = {}
                for k, b in enumerate(combos[j]):
                    low, high = 1 + b * step, (b + 1) * step
                    high = min(high, window - sum(lengths) - (len(combos[j]) - k - 1))
                    x = stock.largest(high, low, taken) if high >= low else 0
                    if x:
                        lengths.append(x)
                        taken[x] = taken.get(x, 0) + 1
                if len(lengths) < len(combos[j]):
                    break
                lengths = top_up(lengths)
                times = times_of(lengths, remaining)
                emit(lengths, times)
                remaining -= times
    while x := stock.largest(window):
        lengths = top_up([x])
        emit(lengths, times_of(lengths, int(stock.left[x])))
    return rows


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, bins: int = 64, depth: int = 3) -> DataFrame:
    """One row for each piece, with the sequence that holds it and its offset.

    A null or empty text is the end id alone. Repeated rows and null ids are
    packed as rows of their own. ``padded_length`` is what the sequence takes:
    ``window``, or its fill where that is a power of two. An empty table packs
    into nothing; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = materialize(pieces(docs, tokenizer, window), "pieces")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row", "start"), F.lit(BUCKETS)).cast("int"))
    # At most window * BUCKETS counts, whatever the input.
    counts = rows.groupBy("length", "bucket").count().toPandas()
    table = np.zeros((window + 1, BUCKETS), np.int64)
    table[counts["length"], counts["bucket"]] = counts["count"]
    steps = plan(table.sum(axis=1), window, bins, depth)
    base = np.cumsum(table, axis=1) - table
    starts = spark.createDataFrame(
        [(int(i), [int(x) for x in base[i]]) for i in np.flatnonzero(table.sum(axis=1))], "length long, base array<long>"
    )
    fill: dict[int, int] = {}
    for length, _, _, sequence, offset in steps:
        fill[sequence] = max(fill.get(sequence, 0), offset + length)
    moves = spark.createDataFrame(
        [(n, rank, rank + times, seq, off, fill[seq]) for n, rank, times, seq, off in steps],
        "length long, low long, high long, first long, offset long, filled long",
    )
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "row", "start", "ids_crc32")
    ranked = rows.withColumn("nth", F.row_number().over(within) - 1).join(F.broadcast(starts), "length")
    ranked = ranked.withColumn("rank", F.col("nth") + F.element_at("base", F.col("bucket") + 1))
    power = F.col("filled").bitwiseAND(F.col("filled") - 1) == 0
    placed = ranked.join(
        F.broadcast(moves), (ranked.length == moves.length) & (ranked["rank"] >= moves.low) & (ranked["rank"] < moves.high)
    ).drop(moves.length)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset",
        F.when(power, F.col("filled")).otherwise(F.lit(window)).cast("long").alias("padded_length"),
    )
