"""Entities as sequences of their latest events, and an autoencoder over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.lineage import cut
from tidewatch.functions.scaling import scoremin

#: What an event is to the autoencoder, in this order.
SIGNALS = ["amount", "gap", "hour", "is_call", "is_transaction", "is_post"]


def event_sequences(events: DataFrame, length: int = 64, least: int = 8) -> DataFrame:
    """(entity_id, place, signals): the last ``length`` dated events of entities
    that have ``least`` or more, place 0 the latest; all signals are 0 to 1.

    Amounts are logs over the log of the largest, gaps hours up to 96."""
    dated = events.where("entity_id is not null and timestamp is not null")
    top = events.agg(F.greatest(F.max("amount"), F.lit(0.0)).alias("top"))
    by_time = Window.partitionBy("entity_id").orderBy("timestamp", "event_id")
    latest = Window.partitionBy("entity_id").orderBy(F.desc("timestamp"), F.desc("event_id"))
    hours = F.expr("timestampdiff(MICROSECOND, before, timestamp)") / 3_600_000_000.0
    busy = dated.groupBy("entity_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("entity_id")
    rows = dated.withColumn("before", F.lag("timestamp").over(by_time)).withColumn("place", F.row_number().over(latest) - 1).where(F.col("place") < length)
    scale = F.log1p(F.when(F.col("top") > 0, F.col("top")).otherwise(1.0))
    clipped = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    kind = lambda k: F.coalesce((F.col("event_type") == k).cast("double"), F.lit(0.0))
    return rows.join(busy, "entity_id", "left_semi").join(F.broadcast(top)).select(
        "entity_id", "place", clipped(F.log1p(F.coalesce(F.greatest("amount", F.lit(0.0)), F.lit(0.0))) / scale).alias("amount"),
        clipped(F.coalesce(hours, F.lit(0.0)) / 96).alias("gap"), (F.hour("timestamp") / 24).alias("hour"),
        kind("call").alias("is_call"), kind("transaction").alias("is_transaction"), kind("post").alias("is_post"),
    )


def padded(sequences: DataFrame) -> DataFrame:
    """(entity_id, steps): each entity's signals, oldest first, as one array of at
    most ``length`` steps."""
    steps = F.array_sort(F.collect_list(F.struct((-F.col("place")).alias("at"), F.array(*SIGNALS).alias("x"))))
    return sequences.groupBy("entity_id").agg(F.transform(steps, lambda s: s["x"]).alias("steps"))


class Recurrent:
    """A long short-term memory whose last state is decoded, by one linear map,
    to the whole sequence it has read."""

    def __init__(self, length: int, hidden: int, seed: int, signals: int = len(SIGNALS)):
        rng = np.random.default_rng(seed)
        span = 1 / np.sqrt(hidden)
        draw = lambda *shape: rng.uniform(-span, span, shape)
        self.length, self.hidden = length, hidden
        # Input, state, bias of the gates (in, forget, candidate, out); decoder and its bias.
        self.params = [draw(signals, 4 * hidden), draw(hidden, 4 * hidden), draw(4 * hidden), draw(hidden, length * signals), draw(length * signals)]

    def read(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """The last state of sequences ``x`` (N, T, signals)."""
        wx, wh, b, *_ = self.params
        h = c = np.zeros((len(x), self.hidden))
        k = self.hidden
        for t in range(x.shape[1]):
            z = x[:, t] @ wx + h @ wh + b
            gates = 1 / (1 + np.exp(-np.concatenate([z[:, : 2 * k], z[:, 3 * k :]], axis=1)))
            i, f, o, g = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :], np.tanh(z[:, 2 * k : 3 * k])
            before = (h, c)
            c = f * c + i * g
            h = o * np.tanh(c)
            if keep is not None:
                keep.append((*before, i, f, g, o, c))
        return h

    def decode(self, h: np.ndarray) -> np.ndarray:
        return (h @ self.params[3] + self.params[4]).reshape(len(h), self.length, -1)

    def gradients(self, x: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean squared error and its gradients, back through time."""
        wx, wh, b, wd, bd = self.params
        keep: list = []
        h = self.read(x, keep)
        miss = self.decode(h) - x
        d = (2 * miss / miss.size).reshape(len(x), -1)
        out = [np.zeros_like(wx), np.zeros_like(wh), np.zeros_like(b), h.T @ d, d.sum(axis=0)]
        dh, dc = d @ wd.T, np.zeros_like(h)
        for t in reversed(range(x.shape[1])):
            h0, c0, i, f, g, o, c = keep[t]
            th = np.tanh(c)
            dc = dc + dh * o * (1 - th**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dc * i * (1 - g**2), dh * th * o * (1 - o)], axis=1)
            out[0] += x[:, t].T @ dz
            out[1] += h0.T @ dz
            out[2] += dz.sum(axis=0)
            dh, dc = dz @ wh.T, dc * f
        return float((miss**2).mean()), out

    def fit(self, x: np.ndarray, epochs: int, rate: float) -> None:
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.params]
        for step in range(1, epochs + 1):
            _, grads = self.gradients(x)
            for p, g, (m, v) in zip(self.params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def _blocks(steps, length: int) -> np.ndarray:
    """(N, length, signals): zeros stand before shorter sequences."""
    out = np.zeros((len(steps), length, len(SIGNALS)))
    for row, s in zip(out, steps, strict=True):
        row[length - len(s) :] = np.stack(s)
    return out


def lstm_autoencoder(
    events: DataFrame, length: int = 64, hidden: int = 32, epochs: int = 24, rate: float = 0.01, seed: int = 0, sample: int = 2048
) -> DataFrame:
    """Squared error of sequences rebuilt from the last state of a recurrent
    network, which is fitted on ``sample`` entities (by a hash of their id) and
    applied to all. Without an entity of eight dated events nobody is scored."""
    rows = cut(padded(event_sequences(events, length)))
    known = rows.orderBy(F.xxhash64("entity_id"), "entity_id").limit(sample).toPandas()
    if not len(known):
        return rows.select("entity_id", F.lit(0.0).alias("score"))
    model = Recurrent(length, hidden, seed)
    model.fit(_blocks(known["steps"], length), epochs, rate)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 512):
                part = f.iloc[at : at + 512]
                x = _blocks(part["steps"], length)
                yield pd.DataFrame({"entity_id": part["entity_id"], "raw": ((model.decode(model.read(x)) - x) ** 2).mean(axis=(1, 2))})

    kind = rows.schema["entity_id"].dataType.simpleString()
    return scoremin(rows.mapInPandas(run, f"entity_id {kind}, raw double"), "raw")
