"""Token counts by byte-pair merging with a heap and a linked list.

Symbols of a unit are linked to their neighbours; adjacent pairs that have a rank
wait in a heap, and the pair of lowest rank, leftmost among equals, is popped and
merged until none is left. A merge takes away one symbol, so the count is that of
the initial symbols minus the merges, and no ids are made.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._common import text_slices
from tidewatch.llm.merges import _UNIT, MARK, Vocabulary

#: Characters of the units whose counts a worker keeps, and of the longest kept.
ROOM, KEPT = 16_000_000, 64


class Counter:
    """Counts of a merge-type model with byte fallback and no text normalisation
    but a blank mark before each text. Pieces hold a mark only in front, so that
    units between marks are counted alone."""

    def __init__(self, path: str):
        vocabulary = Vocabulary(path)
        self.merges, self.chars, self.size = vocabulary.merges, vocabulary.chars, len(vocabulary.pieces)
        self.known: dict[str, int] = {}
        self.used = 0

    def unit(self, unit: str) -> int:
        """Tokens of one unit. A character outside the vocabulary is as many
        symbols as it has bytes, none of which merges."""
        chars, merges, size = self.chars, self.merges, self.size
        symbol = [int(chars[ord(c)]) for c in unit]
        n = len(symbol)
        count = n + sum(len(c.encode()) - 1 for c, s in zip(unit, symbol, strict=True) if s >= size)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for left in range(n - 1):
            if found := merges.get(symbol[left] << 32 | symbol[left + 1]):
                heap.append((found[0], left, left + 1, found[1]))
        heapify(heap)
        # Where a symbol ends when its pair enters the heap is told by the piece
        # it would make: a pair that has changed makes another piece or none.
        while heap:
            _, left, right, piece = heappop(heap)
            if symbol[left] < 0 or after[left] != right:
                continue
            found = merges.get(symbol[left] << 32 | symbol[right])
            if found is None or found[1] != piece:
                continue
            count -= 1
            symbol[left], symbol[right] = piece, -1
            end = after[left] = after[right]
            if end < n:
                before[end] = left
                if found := merges.get(piece << 32 | symbol[end]):
                    heappush(heap, (found[0], left, end, found[1]))
            ahead = before[left]
            if ahead >= 0 and (found := merges.get(symbol[ahead] << 32 | piece)):
                heappush(heap, (found[0], ahead, left, found[1]))
        return count

    def text(self, text: str) -> int:
        """Tokens of a text; none if it is empty."""
        if not text:
            return 0
        units = _UNIT.findall(MARK + text.replace(" ", MARK))
        known = self.known
        new = {u for u in units if u not in known}
        if self.used > ROOM:
            known.clear()
            self.used, new = 0, set(units)
        own = {u: self.unit(u) for u in new}
        total = sum(known[u] if u in known else own[u] for u in units)
        for unit in new:
            if len(unit) <= KEPT:
                known[unit] = own[unit]
                self.used += len(unit)
        return total


_loaded: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    """One counter, with what it knows, for each Python worker."""
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row.

    A null or empty text has no bytes and no tokens. Blank marks in a text count
    as blanks and strings of control pieces as ordinary text, as the library has
    it. Repeated rows repeat, null ids stay, an empty table stays empty, other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model)
        for keys, texts in text_slices(batches, 4_000_000):
            counts = [counter.text(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
