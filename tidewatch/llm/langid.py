"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in both directions, labels every byte
position with a distribution over the learned languages, and the document's
distribution is the mean over all its positions. Training is backpropagation
through time in numpy on a bounded sample; prediction streams over whole texts,
in windows whose states are warmed up on the bytes before and behind them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._common import text_slices, tidy

UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass(frozen=True)
class Fit:
    """How the network is fitted. ``per_lang``, ``max_langs`` and ``reach`` bound
    the labelled sample: about so many texts of each label, so many labels (the
    most frequent), and so many characters of each text."""

    per_lang: int = 400
    max_langs: int = 64
    reach: int = 2000
    hidden: int = 8
    window: int = 48
    batch: int = 256
    steps: int = 220
    rate: float = 0.02
    seed: int = 7


def _soft(a: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """a / (1 + |a|), in place."""
    np.abs(a, out=scratch)
    scratch += 1
    a /= scratch
    return a


class Direction:
    """One gated recurrent layer. ``table`` holds what each byte adds to the
    update gate, the reset gate and the candidate; ``back`` is the recurrence."""

    def __init__(self, table: np.ndarray, back: np.ndarray):
        self.table, self.back = table, back

    def run(self, x: np.ndarray, keep: dict | None = None, valid: np.ndarray | None = None) -> np.ndarray:
        """States (T, H, N) for bytes ``x`` (T, N); zero where not ``valid``, so
        that padding leaves no trace in the steps behind it."""
        steps, n = x.shape
        h3 = self.back.shape[0]
        h = h3 // 3
        out = np.empty((steps, h, n), np.float32)
        state = np.zeros((h, n), np.float32)
        full = valid.all(axis=1) if valid is not None else None
        a, s2, s1 = np.empty((h3, n), np.float32), np.empty((2 * h, n), np.float32), np.empty((h, n), np.float32)
        for t in range(steps):
            np.matmul(self.back, state, out=a)
            given = self.table.take(x[t], axis=0, mode="clip").T
            gates, cand = a[: 2 * h], a[2 * h :]
            gates += given[: 2 * h]
            raw = _soft(gates, s2)
            if keep is not None:
                keep["gate"][t], keep["rec"][t], keep["prev"][t] = raw, cand, state
            raw *= 0.5
            raw += 0.5
            cand *= raw[h:]
            cand += given[2 * h :]
            _soft(cand, s1)
            if keep is not None:
                keep["cand"][t] = cand
            np.subtract(cand, state, out=s1)
            s1 *= raw[:h]
            state = np.add(state, s1, out=out[t])
            if valid is not None and not full[t]:
                state *= valid[t]
        return out

    def gradients(self, x: np.ndarray, keep: dict, d_out: np.ndarray, valid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Backpropagation through time: gradients of ``table`` and ``back``."""
        steps, n = x.shape
        h = self.back.shape[0] // 3
        d_pre = np.empty((steps, 3 * h, n), np.float32)
        d_back = np.zeros_like(self.back)
        d_state = np.zeros((h, n), np.float32)
        for t in reversed(range(steps)):
            soft, cand, prev, rec = (keep[k][t] for k in ("gate", "cand", "prev", "rec"))
            z, r = 0.5 + 0.5 * soft[:h], 0.5 + 0.5 * soft[h:]
            d_state = d_state + d_out[t]
            if valid is not None:
                d_state *= valid[t]
            slope = 0.5 * (1 - np.abs(soft)) ** 2
            d_n = d_state * z * (1 - np.abs(cand)) ** 2
            pre = d_pre[t]
            pre[:h] = d_state * (cand - prev) * slope[:h]
            pre[h : 2 * h] = d_n * rec * slope[h:]
            pre[2 * h :] = d_n
            through = np.concatenate([pre[: 2 * h], d_n * r])
            d_back += through @ prev.T
            d_state = d_state * (1 - z) + self.back.T @ through
        d_table = np.zeros_like(self.table)
        np.add.at(d_table, x.ravel(), d_pre.transpose(0, 2, 1).reshape(-1, 3 * h))
        return d_table, d_back


@dataclass
class Model:
    langs: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray
    bias: np.ndarray

    def positions(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """Label probabilities (T, C, N) from the states of both directions."""
        p = np.matmul(self.out, np.concatenate([forward, backward], axis=1))
        p += self.bias[:, None]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def pooled(self, texts: list[bytes], window: int = 256, lead: int = 64, lanes: int = 1024) -> np.ndarray:
        """Mean label probabilities over all bytes of each text. Texts are cut
        into windows that run side by side; none is left out. Either direction
        starts up to ``lead`` bytes outside its window, within the text, and
        what stands beside a window in its batch doesn't reach it."""
        total = np.zeros((len(texts), len(self.langs)))
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        n_windows = -(-sizes // window)
        owner = np.repeat(np.arange(len(texts)), n_windows)
        inside = (np.arange(len(owner)) - (np.cumsum(n_windows) - n_windows)[owner]) * window
        opens = (np.cumsum(sizes) - sizes)[owner]
        length = np.minimum(window, sizes[owner] - inside)
        order = np.lexsort((inside > 0, length))
        for at in range(0, len(order), lanes):
            rows = order[at : at + lanes]
            first, size = opens[rows], sizes[owner[rows]]
            start, reach = first + inside[rows], int(length[rows].max())
            stop = start + length[rows]
            ahead = int(np.minimum(lead, inside[rows]).max())
            behind = int(np.minimum(lead, first + size - stop).max())
            # Windows end together, so that padding stands before the text.
            place = stop - reach - ahead + np.arange(ahead + reach)[:, None]
            ok = (place >= first) & (place >= start - lead)
            forward = self.forward.run(np.where(ok, data.take(place, mode="clip"), 0).astype(np.intp), None, ok)[ahead:]
            place = stop + behind - 1 - np.arange(behind + reach)[:, None]
            ok = (place < first + size) & (place >= start)
            backward = self.backward.run(np.where(ok, data.take(place, mode="clip"), 0).astype(np.intp), None, ok)[behind:][::-1]
            p = self.positions(forward, backward)
            p *= (np.arange(reach)[:, None] >= reach - length[rows])[:, None, :]
            np.add.at(total, owner[rows], p.sum(axis=0).T)
        return total / np.maximum(sizes, 1)[:, None]


def train(samples: list[tuple[bytes, str]], fit: Fit = Fit()) -> Model | None:
    """Fit the network on (bytes, label) pairs; None without any label."""
    langs = sorted({lang for _, lang in samples})
    if not langs:
        return None
    rng = np.random.default_rng(fit.seed)
    h, c = fit.hidden, len(langs)
    params = [
        rng.normal(0, 0.4, (256, 3 * h)), rng.normal(0, 0.3, (3 * h, h)),
        rng.normal(0, 0.4, (256, 3 * h)), rng.normal(0, 0.3, (3 * h, h)),
        rng.normal(0, 0.3, (c, 2 * h)), np.zeros(c),
    ]
    params = [p.astype(np.float32) for p in params]
    model = Model(langs, Direction(*params[:2]), Direction(*params[2:4]), *params[4:])
    by_lang = [[np.frombuffer(t, np.uint8) for t, lang in samples if lang == name and t] for name in langs]
    by_lang = [x or [np.zeros(1, np.uint8)] for x in by_lang]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    steps = fit.steps if c > 1 else 0
    for step in range(1, steps + 1):
        label = rng.integers(0, c, fit.batch)
        x = np.zeros((fit.window, fit.batch), np.intp)
        weight = np.zeros((fit.window, fit.batch), np.float32)
        for j, y in enumerate(label):
            text = by_lang[y][rng.integers(len(by_lang[y]))]
            at = rng.integers(0, max(1, len(text) - fit.window + 1))
            piece = text[at : at + fit.window]
            x[fit.window - len(piece) :, j] = piece
            weight[fit.window - len(piece) :, j] = 1
        shape = (fit.window, h, fit.batch)
        kept = [
            {k: np.empty((fit.window, 2 * h, fit.batch) if k == "gate" else shape, np.float32) for k in ("gate", "cand", "prev", "rec")}
            for _ in range(2)
        ]
        valid = weight > 0
        forward, backward = model.forward.run(x, kept[0], valid), model.backward.run(x[::-1], kept[1], valid[::-1])[::-1]
        states = np.concatenate([forward, backward], axis=1)
        d = model.positions(forward, backward)
        d[:, label, np.arange(fit.batch)] -= 1
        d *= (weight / weight.sum())[:, None, :]
        d_states = np.matmul(model.out.T, d)
        grads = [
            *model.forward.gradients(x, kept[0], d_states[:, :h], valid),
            *model.backward.gradients(x[::-1], kept[1], d_states[::-1, h:], valid[::-1]),
            np.einsum("tcn,tkn->ck", d, states, optimize=True), d.sum(axis=(0, 2)),
        ]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = fit.rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p_, g, (m, v) in zip(params, grads, moments, strict=True):
            g = g / max(1.0, norm)
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(modulus: int, remainder: int) -> F.Column:
    """Whether crc32 of doc_id as text leaves the remainder (null id: no)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def sample_texts(labelled: DataFrame, fit: Fit = Fit()) -> list[tuple[bytes, str]]:
    """A bounded sample of (text window, lang) for fitting: rows are taken by a
    hash of doc_id below a bound set from each label's count, and from each a
    window of ``reach`` characters at a hashed place. Where repeated ids or chance
    give over twice the asked, those of the least hashes are taken."""
    known = labelled.where("lang is not null and text is not null and doc_id is not null")
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(fit.max_langs).collect()
    if not counts:
        return []
    space = 1 << 40
    bound = F.lit(0).cast("long")
    for r in counts:
        share = min(space, space * fit.per_lang // r["count"] + 1)
        bound = F.when(F.col("lang") == r["lang"], F.lit(share).cast("long")).otherwise(bound)
    place = F.pmod(F.xxhash64("doc_id", F.lit(fit.seed)), F.lit(space).cast("long"))
    room = F.greatest(F.length("text") - fit.reach, F.lit(0)) + 1
    at = (F.pmod(F.xxhash64("doc_id", F.lit(fit.seed + 1)), room.cast("long")) + 1).cast("int")
    chosen = known.where(place < bound).select(place.alias("place"), "lang", F.substring("text", at, F.lit(fit.reach)).alias("text"))
    rows = chosen.orderBy("place", "lang", "text").limit(2 * fit.per_lang * len(counts)).collect()
    return [(r["text"].encode(), r["lang"]) for r in rows]


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) for each row; other columns are ignored.

    A null text or one without a letter is ``und`` with score 0, and so is every
    row if the model learned no label. The score is the pooled probability.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_slices(batches, 2_000_000):
            pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            rows = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
            if rows:
                p = model.pooled([texts[i].encode() for i in rows])
                for i, best, q in zip(rows, p.argmax(axis=1), p.max(axis=1), strict=True):
                    pred[i], score[i] = model.langs[best], min(1.0, float(q))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(pred), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, fit: Fit = Fit(), modulus: int = 3, remainder: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row: learn from labelled
    rows that are not held out, then predict every row from its text alone.

    Equal texts get equal results, whatever stands beside them; of labels with
    equal probability the first in order is taken. A null id is not held out and
    never learned from; repeated rows each return a row and weigh as often in
    the sample. Texts of any length are read whole. An empty table, or one
    without labels, learns nothing: its rows, if any, are ``und``. Other columns
    are ignored.
    """
    model = train(sample_texts(docs.where(~held_out(modulus, remainder)), fit), fit)
    return classify(docs, model).select("doc_id", held_out(modulus, remainder).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, fit: Fit = Fit(), least: float = 0.0) -> DataFrame:
    """``docs`` without the rows the network rejects: those it labels ``und``
    (no text or no letter) or whose pooled probability is under ``least``.

    The judgement travels with the row, so repeated and null ids are no matter,
    and all columns stay, whatever their names. Without any label to learn from
    every row is rejected; an empty table stays empty.
    """
    model = train(sample_texts(docs.where(~held_out(3, 1)), fit), fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, place = np.zeros(batch.num_rows, bool), pa.array(range(batch.num_rows))
            only = pa.RecordBatch.from_arrays([place, batch.column("text")], ["doc_id", "text"])
            for at, texts in text_slices(iter([only]), 2_000_000):
                rows = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
                if rows:
                    best = model.pooled([texts[i].encode() for i in rows]).max(axis=1) if least > 0 else np.ones(len(rows))
                    keep[np.array(at)[rows]] = best >= least
            if keep.any():
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(tidy(run), docs.schema)
