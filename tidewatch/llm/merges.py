"""SentencePiece encoding with seeded merge-dropout, and its lossless decoding.

The vocabulary is that of a merge-type (BPE) model file. Encoding processes an
agenda of candidate merges, best piece first and leftmost among equals; each
candidate is skipped if a keyed hash of its place falls under the dropout rate.
A candidate is known by where its two symbols start and end, so skipping it when
it is popped and leaving it off the agenda are the same, and many units can be
worked off side by side in numpy. Merges never cross from a text character to
the blank mark behind it (no piece holds one inside), so units are encoded alone.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._common import text_slices

MARK = "▁"
_UNIT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
#: Stands for a blank mark that is in the text itself: a lone surrogate, which no
#: valid text holds. It is encoded by the mark's bytes, and so decoded apart.
_LITERAL = "\ud881"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise on unsigned integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drops(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, rate: float) -> np.ndarray:
    """Whether the keyed hash skips the merge of [start, middle) and [middle, end)."""
    place = (start.astype(np.uint64) << np.uint64(42)) | (middle.astype(np.uint64) << np.uint64(21)) | end.astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix(key ^ (place * np.uint64(0x9E3779B97F4A7C15))) < np.uint64(int(rate * (2**64 - 1)))


class Vocabulary:
    """Pieces, scores, and which two pieces merge into which."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        score = np.array([model.get_score(i) for i in range(n)])
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        of_byte = {int(i): bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.raw = [of_byte.get(i, b"" if special[i] else p.replace(MARK, " ").encode()) for i, p in enumerate(self.pieces)]
        # Characters outside the vocabulary get ids above it: they never merge.
        self.chars = n + np.arange(0x110000, dtype=np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        left, right, merged = [], [], []
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(i)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], np.array(merged, np.int64)[order]
        levels = np.unique(-score[self.merged])
        self.rank = np.searchsorted(levels, -score[self.merged]).astype(np.int32)
        # Tables of pair places, the first taken wins; who finds its cell taken
        # goes to the next table. The place one past the pairs means none.
        self.probe = np.append(self.keys, -1)
        self.tables, todo = [], np.arange(len(self.keys))
        while len(todo):
            bits = max(8, int(8 * len(todo)).bit_length())
            cell, table = self._cell(self.keys[todo], len(self.tables), bits), np.full(1 << bits, len(self.keys), np.int32)
            table[cell[::-1]] = todo[::-1]
            self.tables.append((bits, table))
            todo = todo[table[cell] != todo]

    @cached_property
    def merges(self) -> dict[int, tuple[int, int]]:
        """Rank and merged piece of each pair."""
        return dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.merged.tolist(), strict=True), strict=True))

    def char_ids(self, text: str) -> np.ndarray:
        """The symbol of each character."""
        return self.chars[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]

    @staticmethod
    def _cell(key: np.ndarray, turn: int, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (key.view(np.uint64) ^ (key.view(np.uint64) >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 + 2 * turn)
        return (mixed >> np.uint64(64 - bits)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of the merge of two symbols, or -1."""
        key = a << 32 | b
        out = np.full(len(key), -1, np.int64)
        for turn, (bits, table) in enumerate(self.tables):
            at = table[self._cell(key, turn, bits)]
            np.copyto(out, at, where=self.probe[at] == key)
        return out


_NONE = np.iinfo(np.int32).max
#: Units above this many characters are merged off a heap, one by one.
_LONG = 256
#: Characters of units that are merged side by side.
_CELLS = 100_000


def merge_units(vocabulary: Vocabulary, units: list[str], keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Symbol ids of all units under their keys end to end, and how many each
    has. Units of like length run together; each round makes every unit's best
    live merge. Long units have an agenda of their own."""
    return merge_occurrences(vocabulary, units, np.arange(len(units)), keys, rate)


def merge_occurrences(
    vocabulary: Vocabulary, names: list[str], codes: np.ndarray, keys: np.ndarray, rate: float
) -> tuple[np.ndarray, np.ndarray]:
    """``merge_units`` of the units ``names[codes]``, each under its own key."""
    lens = np.fromiter(map(len, names), np.int64, len(names))
    flat, first, size = vocabulary.char_ids("".join(names)), np.cumsum(lens) - lens, lens[codes]
    order = np.argsort(size, kind="stable")
    ordered = size[order]
    counts, parts, at = np.zeros(len(codes), np.int64), [np.empty(0, np.int64)], 0
    while at < len(order):
        reach = int(ordered[at])
        if reach > _LONG:
            parts.append(_merge_long(vocabulary, names[codes[order[at]]], int(keys[order[at]]), rate))
            counts[order[at]] = len(parts[-1])
            at += 1
            continue
        stop = min(at + max(64, _CELLS // reach), int(np.searchsorted(ordered, min(_LONG, max(reach + 1, reach * 5 // 4)), "right")))
        rows = order[at:stop]
        at = stop
        width = int(size[rows].max())
        place = first[codes[rows]][:, None] + np.arange(width)
        symbol = np.where(np.arange(width) < size[rows][:, None], flat.take(place, mode="clip"), -1)
        merged, counts[rows] = _merge_block(vocabulary, symbol, size[rows], keys[rows], rate)
        parts.append(merged)
    return ragged(np.concatenate(parts), counts[order], np.argsort(order)), counts


def ragged(flat: np.ndarray, lens: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The chosen rows of a ragged array, end to end."""
    first, per = np.cumsum(lens) - lens, lens[rows]
    stop = np.cumsum(per)
    return flat[np.arange(stop[-1] if len(stop) else 0) + np.repeat(first[rows] - (stop - per), per)]


def _merge_block(
    vocabulary: Vocabulary, symbol: np.ndarray, size: np.ndarray, keys: np.ndarray, rate: float
) -> tuple[np.ndarray, np.ndarray]:
    """One row a unit, -1 behind its end. A symbol stays where its first
    character is and links to those around it, so a merge touches its own places
    alone. Arrays are flat: a row has ``step`` places, one behind its last."""
    n, width = symbol.shape
    step = width + 1
    symbols = np.full((n, step), -1, np.int64)
    symbols[:, :width] = symbol
    symbol = symbols.ravel()
    after = np.tile(np.arange(1, step + 1), n)
    before = np.tile(np.arange(-1, width), n)
    index, rank = np.full(n * step, -1, np.int64), np.full((n, step), _NONE, np.int32)
    by_place, ranks = rank.reshape(-1), np.append(vocabulary.rank, np.int32(_NONE))

    def weigh(key: np.ndarray, at: np.ndarray, left: np.ndarray, middle: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """The merges of symbols ``a`` and ``b`` at ``at``, none if dropped."""
        found = vocabulary.pair(a, b)
        if rate > 0 and len(hit := np.flatnonzero(found >= 0)):
            found[hit[drops(key[hit], left[hit], middle[hit], end[hit], rate)]] = -1
        index[at], by_place[at] = found, ranks[found]

    row, col = np.nonzero(np.arange(width) < (size - 1)[:, None])
    at = row * step + col
    weigh(keys[row], at, col, col + 1, col + 2, symbol[at], symbol[at + 1])
    live = np.flatnonzero(size > 1)
    while len(live):
        left = rank[live].argmin(axis=1)
        base = live * step
        at = base + left
        going = by_place[at] < _NONE
        if not going.all():
            live, left, base, at = live[going], left[going], base[going], at[going]
            if not len(live):
                break
        right = base + after[at]
        end, ahead, new, key = after[right], before[at], vocabulary.merged[index[at]], keys[live]
        symbol[at], symbol[right], by_place[right], after[at] = new, -1, _NONE, end
        behind = base + np.minimum(end, width)
        before[behind] = left
        by_place[at] = _NONE
        more, some = np.flatnonzero(end < size[live]), np.flatnonzero(ahead >= 0)
        next_to, prior = behind[more], base[some] + ahead[some]
        weigh(
            np.concatenate([key[more], key[some]]), np.concatenate([at[more], prior]), np.concatenate([left[more], ahead[some]]),
            np.concatenate([end[more], left[some]]), np.concatenate([after[next_to], end[some]]),
            np.concatenate([new[more], symbol[prior]]), np.concatenate([symbol[next_to], new[some]]),
        )
    kept = symbols >= 0
    return symbols[kept], kept.sum(axis=1)


def _merge_long(vocabulary: Vocabulary, unit: str, key: int, rate: float) -> np.ndarray:
    """The same for one unit in n log n steps."""
    full, limit = (1 << 64) - 1, int(rate * (2**64 - 1))
    symbol, n = vocabulary.char_ids(unit).tolist(), len(unit)
    after, before = list(range(1, n + 2)), list(range(-1, n))

    def dropped(start: int, middle: int, end: int) -> bool:
        x = key ^ (((start << 42) & full | middle << 21 | end) * 0x9E3779B97F4A7C15 & full)
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ x >> 27) * 0x94D049BB133111EB & full
        return x ^ x >> 31 < limit

    def candidate(left: int) -> tuple[int, ...] | None:
        middle = after[left]
        if middle >= n or (found := vocabulary.merges.get(symbol[left] << 32 | symbol[middle])) is None:
            return None
        if rate > 0 and dropped(left, middle, after[middle]):
            return None
        return found[0], left, middle, after[middle], found[1]

    agenda = [c for c in map(candidate, range(n)) if c]
    heapify(agenda)
    while agenda:
        _, left, right, end, merged = heappop(agenda)
        # A span has one symbol, so equal spans mean that nothing has changed.
        if symbol[left] < 0 or symbol[right] < 0 or after[left] != right or after[right] != end:
            continue
        symbol[left], symbol[right] = merged, -1
        after[left], before[end] = end, left
        for place in (before[left], left):
            if place >= 0 and (found := candidate(place)):
                heappush(agenda, found)
    return np.array([s for s in symbol if s >= 0], np.int64)


class Encoder:
    """Texts to ids and back. Every occurrence of a unit is merged by its own
    hashes, thousands side by side; nothing is kept from text to text."""

    def __init__(self, path: str, rate: float, seed: int):
        self.vocabulary, self.rate, self.seed = Vocabulary(path), rate, seed

    def _merge(self, names: list[str], codes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all occurrences end to end, and how many each has: symbols
        outside the vocabulary become the ids of their bytes."""
        flat, lens = merge_occurrences(self.vocabulary, names, codes, keys, self.rate)
        n = len(self.vocabulary.pieces)
        if not (outside := np.flatnonzero(flat >= n)).size:
            return flat.astype(np.int32), lens
        spelt = [list(chr(s - n).replace(_LITERAL, MARK).encode()) for s in flat[outside].tolist()]
        per = np.ones(len(flat), np.int64)
        per[outside] = [len(x) for x in spelt]
        wide = np.repeat(flat, per)
        wide[np.repeat(flat >= n, per)] = self.vocabulary.byte_ids[[b for x in spelt for b in x]]
        return wide.astype(np.int32), np.add.reduceat(per, np.cumsum(lens) - lens)

    def encode(self, texts: list[str], row_keys: list[int]) -> list[np.ndarray]:
        """Ids of each text. A unit's merges are dropped by the seed, the row's
        key, the unit's place in the row and the merge's place in the unit."""
        rows = [_UNIT.findall(MARK + t.replace(MARK, _LITERAL).replace(" ", MARK)) if t else [] for t in texts]
        sizes = np.array([len(r) for r in rows], np.int64)
        every = list(chain.from_iterable(rows))
        if not every:
            return [np.empty(0, np.int32)] * len(texts)
        names = list(dict.fromkeys(every))
        index = dict(zip(names, range(len(names)), strict=True))
        codes = np.fromiter(map(index.__getitem__, every), np.int64, len(every))
        with np.errstate(over="ignore"):
            row = mix(np.array([k & 0xFFFFFFFFFFFFFFFF for k in row_keys], np.uint64) ^ np.uint64(self.seed))
            place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keys = mix(np.repeat(row, sizes) + place.astype(np.uint64))
        stream, lens = self._merge(names, codes, keys)
        bounds = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(sizes)])]
        return [stream[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def decode(self, ids: np.ndarray) -> str:
        raw = self.vocabulary.raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


_loaded: dict[tuple, Encoder] = {}


def _encoder(path: str, rate: float, seed: int) -> Encoder:
    """One encoder for each Python worker."""
    if (path, rate, seed) not in _loaded:
        _loaded[path, rate, seed] = Encoder(path, rate, seed)
    return _loaded[path, rate, seed]


def encode(docs: DataFrame, model: str, rate: float = 0.1, seed: int = 17) -> DataFrame:
    """(doc_id, ids array<int>) for each row.

    A null or empty text has no ids. The keyed hash takes doc_id (null: -1) and
    places alone, so repeated rows repeat and a lost task gives the same ids. A
    blank mark that stands in the text itself is encoded by its bytes, so that
    it decodes as itself. Other columns are ignored; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model, rate, seed)
        for keys, texts in text_slices(batches, 2_000_000):
            ids = encoder.encode(texts, [-1 if k is None else k for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) for each row of ``encode``'s result; null ids: null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model, 0.0, 0)
        for batch in batches:
            texts = [None if x.as_py() is None else encoder.decode(np.array(x.as_py(), np.int64)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str, rate: float = 0.1, seed: int = 17) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, n_bytes, decoded_sha256, lossless) for each
    row: what ``encode`` gives and what its decoding returns, in one pass that
    never holds a whole partition's ids. Edge cases are ``encode``'s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model, rate, seed)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        names = ["doc_id", "n_ids", "ids_crc32", "n_bytes", "decoded_sha256", "lossless"]
        for keys, texts in text_slices(batches, 2_000_000):
            rows = []
            for key, text, ids in zip(keys, texts, encoder.encode(texts, [-1 if k is None else k for k in keys]), strict=True):
                back = encoder.decode(ids)
                data = back.encode()
                rows.append((key, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(data), hashlib.sha256(data).hexdigest(), back == text))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "doc_id long, n_ids long, ids_crc32 long, n_bytes long, decoded_sha256 string, lossless boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
