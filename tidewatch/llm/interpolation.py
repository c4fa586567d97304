"""Language-model scoring by deleted interpolation.

Bigram and unigram maximum-likelihood estimates and a uniform floor are mixed;
the weights depend on the bucket of the context's frequency and are learned by
expectation-maximisation on counts held out from the training rows.

The corpus never meets in one place. A task reduces its texts to the sorted
distinct n-gram keys with counts, cut by key range, and keeps its token stream
in the shared folder. Each key range sums the counts of all tasks and answers
every task with totals in the order of its keys. No task sends a key twice, so a
frequent n-gram weighs no more than a rare one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._common import fan_out, materialize, text_slices
from tidewatch.llm.langid import held_out

#: Key of the token that ends every text, and of the context before its first.
END, START = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
#: Cells of a log2-count histogram: the deleted counts are exact up to 63, then
#: two cells for each power of two, to the largest long.
LEVELS = 64 + 2 * 58


@dataclass(frozen=True)
class Params:
    """Training rows leave ``modulus`` with a remainder other than ``skip``;
    among them those with ``deleted`` give the held-out counts. ``slice_chars``
    bounds the text that a task reduces at a time. Of 2^``pair_bits`` pair keys a
    share of the distinct pairs over that number meets another pair's: 4 in a
    million at a billion distinct pairs."""

    modulus: int = 7
    skip: int = 2
    deleted: int = 4
    slice_chars: int = 6_000_000
    pair_bits: int = 48
    rounds: int = 60


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys (XXH64) of all tokens of all texts in order, each text closed
    by the end token, and the number of tokens of each text."""
    keys, sizes = [np.empty(0, np.uint64)], []
    for text in texts:
        words = text.encode().lower().split()
        own = np.empty(len(words) + 1, np.uint64)
        own[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        own[-1] = END
        keys.append(own)
        sizes.append(len(own))
    return np.concatenate(keys), np.array(sizes, np.int64)


def bigram_keys(tokens: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """The key of each token with the one before it in its text: the upper
    ``bits`` of a 64-bit hash, moved down."""
    before = np.empty_like(tokens)
    if len(tokens):
        before[1:] = tokens[:-1]
        before[np.cumsum(sizes) - sizes] = START
    return _mix(before * np.uint64(0xD6E8FEB86659FD93) + tokens) >> np.uint64(64 - bits)


def _press(values: np.ndarray, sorted_keys: bool = False) -> bytes:
    """Integers as compressed byte planes; sorted keys as their differences."""
    values = np.ascontiguousarray(values)
    if sorted_keys:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpress(data: bytes, kind: type, sorted_keys: bool = False) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    values = np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if sorted_keys else values


_REDUCED = "batch string, away boolean, part int, order int, docs binary, stream binary, keys binary, seen binary, deleted binary"


def _reduce(params: Params, parts: int):
    """Texts to token streams (part -1) and distinct keys by range and order."""
    kinds = [pa.string(), pa.bool_(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
    names = ["batch", "away", "part", "order", "docs", "stream", "keys", "seen", "deleted"]

    def out(ids: list, roles: list, tokens: list[np.ndarray], sizes: list[np.ndarray], away: bool) -> pa.RecordBatch:
        name = uuid.uuid4().hex
        toks, lens = np.concatenate(tokens), np.concatenate(sizes)
        role = np.repeat(np.array(roles, np.int8), lens)
        rows = []
        vocabulary, stream = np.unique(toks, return_inverse=True)
        for order, bits in ((1, 64), (2, params.pair_bits)):
            if order == 1:
                keys, place = vocabulary, stream
            else:
                keys, place = np.unique(bigram_keys(toks, lens, bits), return_inverse=True)
            seen = np.bincount(place[role > 0], minlength=len(keys)).astype(np.uint32)
            gone = np.bincount(place[role > 1], minlength=len(keys)).astype(np.uint32)
            cuts = np.searchsorted(keys // np.uint64((1 << bits) // parts + 1), np.arange(parts + 1))
            for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if b > a:
                    rows.append((name, away, part, order, None, None, _press(keys[a:b], True), _press(seen[a:b]), _press(gone[a:b])))
        head = pa.table({"doc_id": pa.array(ids, pa.int64()), "role": pa.array(roles, pa.int8()), "size": lens})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, head.schema) as writer:
            writer.write_table(head)
        rows.append((name, away, -1, 0, sink.getvalue().to_pybytes(), _press(stream.astype(np.uint32)), _press(vocabulary, True), None, None))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Held-out rows go apart: the weights are learned from them alone.
        held: dict[bool, list[list]] = {False: [[], [], [], []], True: [[], [], [], []]}
        chars = {False: 0, True: 0}
        for batch in batches:
            role = batch.column("role").to_numpy()
            for away in (False, True):
                mine = batch.filter(pa.array((role > 1) == away))
                roles, at = mine.column("role").to_pylist(), 0
                for keys, texts in text_slices(iter([mine]), 2_000_000):
                    t, s = token_keys(texts)
                    for store, more in zip(held[away], (keys, roles[at : at + len(keys)], [t], [s]), strict=True):
                        store += more
                    at += len(keys)
                    chars[away] += sum(map(len, texts))
                    if chars[away] >= params.slice_chars:
                        yield out(*held[away], away)
                        held[away], chars[away] = [[], [], [], []], 0
        for away, stores in held.items():
            if stores[0]:
                yield out(*stores, away)

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Totals of one key range, for each task in the order of its keys."""
    out = []
    for order, rows in pdf.groupby("order"):
        keys = [_unpress(k, np.uint64, True) for k in rows["keys"]]
        known, place = np.unique(np.concatenate(keys), return_inverse=True)
        totals = []
        for column in ("seen", "deleted"):
            each = np.concatenate([_unpress(x, np.uint32) for x in rows[column]])
            totals.append(np.bincount(place, weights=each, minlength=len(known)).astype(np.int64))
        distinct, at = int((totals[0] > 0).sum()), 0
        for i, (name, k) in enumerate(zip(rows["batch"], keys, strict=True)):
            mine = place[at : at + len(k)]
            at += len(k)
            seen, gone = (_press(t[mine].astype(np.uint64)) for t in totals)
            first = i == 0 and order == 1
            out.append((name, bool(rows["away"].iloc[i]), rows["part"].iloc[0], order, seen, gone, distinct if first else 0, int(totals[0].sum()) if first else 0, int(totals[1].sum()) if first else 0))
    return pd.DataFrame(out, columns=["batch", "away", "part", "order", "seen", "deleted", "distinct", "tokens", "gone"])


_ANSWER = "batch string, away boolean, part int, order int, seen binary, deleted binary, distinct long, tokens long, gone long"


def _levels(counts: np.ndarray) -> np.ndarray:
    """Histogram cell of a count: exact to 63, then half powers of two."""
    large = 63 + np.floor(2 * np.log2(np.maximum(counts, 1) / 64.0)).astype(np.int64) + 1
    return np.where(counts < 64, counts, large).astype(np.int64)


def _value(level: np.ndarray) -> np.ndarray:
    """The count that stands for a cell."""
    return np.where(level < 64, level, 64.0 * 2 ** ((level - 64) / 2 + 0.25))


def context_bucket(counts: np.ndarray) -> np.ndarray:
    """Bucket of a context by its frequency: powers of two."""
    return np.floor(np.log2(np.maximum(counts, 0) + 1.0)).astype(np.int64)


class _Batch:
    """A task's texts with the corpus totals of each of their tokens."""

    def __init__(self, stored: pd.DataFrame, answers: pd.DataFrame, bits: int):
        row = stored.iloc[0]
        self.docs = pa.ipc.open_stream(row["docs"]).read_pandas()
        stream = _unpress(row["stream"], np.uint32)
        self.sizes = self.docs["size"].to_numpy()
        tokens = _unpress(row["keys"], np.uint64, True)[stream]
        _, pair = np.unique(bigram_keys(tokens, self.sizes, bits), return_inverse=True)
        answers = answers.sort_values(["order", "part"])
        one, two = (answers[answers["order"] == k] for k in (1, 2))
        get = lambda rows, column: np.concatenate([_unpress(x, np.uint64) for x in rows[column]]).astype(np.int64)
        self.word, self.word_gone = (get(one, c)[stream] for c in ("seen", "deleted"))
        self.pair, self.pair_gone = (get(two, c)[pair] for c in ("seen", "deleted"))
        self.first = np.cumsum(self.sizes) - self.sizes

    def context(self, word: np.ndarray, texts: int) -> np.ndarray:
        """Count of what stands before each token; ``texts`` stand at the start."""
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[self.first] = texts
        return before


def _histogram(texts: int, bits: int):
    """Cells (context, pair, word) of the deleted tokens, with totals that leave
    the deleted part out."""

    def run(key, stored: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(stored):
            return pd.DataFrame({"cell": [], "n": []}).astype("int64")
        b = _Batch(stored, answers, bits)
        mine = np.repeat(b.docs["role"].to_numpy() > 1, b.sizes)
        word = b.word - b.word_gone
        context, pair = b.context(word, texts)[mine], (b.pair - b.pair_gone)[mine]
        cell = (_levels(context) * LEVELS + _levels(pair)) * LEVELS + _levels(word[mine])
        cell, n = np.unique(cell, return_counts=True)
        return pd.DataFrame({"cell": cell, "n": n})

    return run


def mixture(cells: np.ndarray, n: np.ndarray, tokens: int, vocabulary: int, rounds: int) -> np.ndarray:
    """Weights (bucket, 3) of bigram, unigram and uniform, by EM on the cells."""
    context, pair, word = cells // LEVELS**2, cells // LEVELS % LEVELS, cells % LEVELS
    c, p, w = (_value(x) for x in (context, pair, word))
    each = np.stack([np.where(c > 0, np.minimum(p / np.maximum(c, 1), 1), 0), w / max(tokens, 1), np.full(len(n), 1 / (vocabulary + 1))])
    bucket = context_bucket(c)
    weights = np.tile([0.5, 0.45, 0.05], (65, 1))
    weights[0] = [0, 0.9, 0.1]
    for _ in range(rounds if len(n) else 0):
        share = weights[bucket].T * each
        share *= n / share.sum(axis=0)
        got = np.stack([np.bincount(bucket, weights=s, minlength=65) for s in share], axis=1) + [1e-3, 1e-3, 1e-2]
        weights = got / got.sum(axis=1, keepdims=True)
    # A bucket that was never held out takes the weights of the one below it.
    known = np.bincount(bucket, weights=n, minlength=65) > 0
    for i in range(1, 65):
        if not known[i] and known[:i].any():
            weights[i] = weights[i - 1]
    weights[0, 1:] = weights[0, 1:] / weights[0, 1:].sum()
    weights[0, 0] = 0
    return weights


def _score(weights: np.ndarray, tokens: int, vocabulary: int, texts: int, bits: int):
    def run(key, stored: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
        if not len(stored):
            return pd.DataFrame({c: [] for c in columns})
        b = _Batch(stored, answers, bits)
        base = np.log10((b.word + 1.0) / (tokens + 1.0 * (vocabulary + 1)))
        context = b.context(b.word, texts)
        w = weights[context_bucket(context)]
        p = w[:, 0] * np.minimum(b.pair / np.maximum(context, 1), 1)
        p += w[:, 1] * b.word / max(tokens, 1) + w[:, 2] / (vocabulary + 1)
        add = lambda x: np.add.reduceat(x, b.first)
        known = add((b.word > 0).astype(np.int64))
        out = zip(columns, (b.docs["doc_id"].astype("Int64"), b.sizes, known, add(base), add(np.log10(p))), strict=True)
        return pd.DataFrame(dict(out))

    return run


def score(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    A null text is empty and has the end token alone. Rows with a null doc_id
    train and get a score like any other; repeated rows count as often as they
    occur. Without training rows every estimate is the uniform one. An empty
    table returns no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    away = held_out(params.modulus, params.skip)
    role = F.when(away, 0).when(held_out(params.modulus, params.deleted), 2).otherwise(1).cast("tinyint")
    parts = fan_out(spark)
    reduced = docs.select(F.col("doc_id").cast("long"), "text", role.alias("role")).mapInArrow(_reduce(params, parts), _REDUCED)
    reduced = materialize(reduced, "ngrams", "none", 8 << 20)
    stored = reduced.where("part < 0")
    asked = reduced.where("part >= 0").select("batch", "away", "part", "order", "keys", "seen", "deleted")
    answers = materialize(asked.groupBy("part").applyInPandas(_answer, _ANSWER), "totals", "none", 8 << 20)
    seen = answers.agg(F.sum("distinct"), F.sum("tokens"), F.sum("gone")).first()
    vocabulary, tokens, gone = (int(x or 0) for x in seen)
    counts = docs.select(role.alias("role")).groupBy("role").count().collect()
    texts = {r["role"]: r["count"] for r in counts}
    trained = texts.get(1, 0) + texts.get(2, 0)
    gone_only = stored.where("away").groupBy("batch").cogroup(answers.where("away").groupBy("batch"))
    cells = gone_only.applyInPandas(_histogram(texts.get(1, 0), params.pair_bits), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    weights = mixture(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(float), tokens - gone, vocabulary, params.rounds)
    met = stored.groupBy("batch").cogroup(answers.groupBy("batch"))
    scored = met.applyInPandas(
        _score(weights, tokens, vocabulary, trained, params.pair_bits), "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(
        "doc_id", away.alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
