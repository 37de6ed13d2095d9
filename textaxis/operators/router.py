"""Training of a linear head over a log-prior, as a loop of broadcast weights and summed gradients.

The policy of a row is ``softmax(log_prior + W h + b)``. Rows are dealt into batches once, by a seeded order; each epoch
visits the batches in a seeded order of its own and stores them by runs of consecutive steps. Steps follow from one another, so
small batches are taken a run at a time: one task steps through the batches of a run, whose numbers are bounded, and hands on
weights and moments. A batch over that bound is a run of its own, whose tasks hand back sums of gradients. What travels is the
size of the head, never rows, and a job reads its own run only. The optimiser (AdamW: moments, bias correction, decoupled
decay) is a few lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textaxis.functions.vectors import dot
from textaxis.operators.corpus import hash_order
from textaxis.operators.ranking import ordered
from textaxis.session import materialize, release, scratch

#: Rows of a task's block that are turned into arrays at a time.
BLOCK = 4096
#: Numbers of a run of steps: what one task holds at a time.
RUN = 1 << 20
LOSSES = ("total", "supervised", "kl_anchor", "entropy")


@dataclass
class Head:
    """Weights (K x D), bias (K), and the mean losses of each epoch."""

    weights: np.ndarray
    bias: np.ndarray
    history: list[dict[str, float]] = field(default_factory=list)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def loss_sums(hidden: np.ndarray, log_prior: np.ndarray, target: np.ndarray, weights: np.ndarray, bias: np.ndarray, kl: float, entropy: float) -> np.ndarray:
    """Sums over rows: the gradient of the loss by weights and bias, the losses and the number of rows, in one vector.

    The loss is KL(target, policy) + ``kl`` * KL(policy, prior) - ``entropy`` * H(policy).
    """
    log_pi = log_softmax(log_prior + hidden @ weights.T + bias)
    pi = np.exp(log_pi)
    supervised = (target * (np.log(target) - log_pi)).sum(axis=1)
    away = log_pi - log_prior
    anchor, h = (pi * away).sum(axis=1), -(pi * log_pi).sum(axis=1)
    g = pi * target.sum(axis=1, keepdims=True) - target + kl * pi * (away - anchor[:, None]) + entropy * pi * (log_pi + h[:, None])
    losses = np.stack([supervised + kl * anchor - entropy * h, supervised, anchor, h]).sum(axis=1)
    return np.concatenate([(g.T @ hidden).ravel(), g.sum(axis=0), losses, [len(hidden)]])


class AdamW:
    """Adam with decoupled weight decay over one flat vector."""

    def __init__(self, size: int, rate: float, betas: tuple[float, float] = (0.9, 0.999), epsilon: float = 1e-8, decay: float = 0.01):
        self.m, self.v, self.t = np.zeros(size), np.zeros(size), 0
        self.rate, self.betas, self.epsilon, self.decay = rate, betas, epsilon, decay

    def step(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        (b1, b2), self.t = self.betas, self.t + 1
        self.m, self.v = b1 * self.m + (1 - b1) * g, b2 * self.v + (1 - b2) * g * g
        m, v = self.m / (1 - b1**self.t), self.v / (1 - b2**self.t)
        return x - self.rate * self.decay * x - self.rate * m / (np.sqrt(v) + self.epsilon)


def _stacked(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _arrays(rows: pa.RecordBatch) -> list[np.ndarray]:
    return [_stacked(rows.column(c)) for c in ("hidden", "log_prior", "target")]


def _sums(weights, kl: float, entropy: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = weights.value
        total = np.zeros(w.size + b.size + len(LOSSES) + 1)
        for batch in batches:
            for lo in range(0, len(batch), BLOCK):
                total += loss_sums(*_arrays(batch.slice(lo, BLOCK)), w, b, kl, entropy)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["place", "v"])

    return run


def _steps(state, k: int, d: int, kl: float, entropy: float):
    """All steps of one run: weights, then both moments, then the sums of losses and of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, optimiser = state.value
        seen = np.zeros(len(LOSSES) + 1)
        if parts := [b for b in batches if len(b)]:
            table = pa.Table.from_batches(parts).sort_by([("step", "ascending"), ("at", "ascending")]).combine_chunks()
            step, (hidden, log_prior, target) = table.column("step").to_numpy(), _arrays(table.to_batches()[0])
            ends = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(step)]
            for lo, hi in pairwise(ends):
                got = loss_sums(hidden[lo:hi], log_prior[lo:hi], target[lo:hi], x[:k * d].reshape(k, d), x[k * d:], kl, entropy)
                x = optimiser.step(x, got[:len(x)] / got[-1])
                seen += got[len(x):]
            out = np.concatenate([x, optimiser.m, optimiser.v, seen])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], names=["place", "v"])

    return run


def epoch_order(seed: int, epoch: int, batches: int) -> list[int]:
    """The order in which an epoch visits the batches."""
    return np.random.default_rng([seed, epoch]).permutation(batches).tolist()


def dealt_batches(rows: DataFrame, row_key: str, batch_size: int, seed: int) -> DataFrame:
    """``rows`` with ``batch``: consecutive ``batch_size`` rows of a seeded order; the last may be smaller. ``at``: places inside."""
    placed = ordered(rows.withColumn("__h", hash_order(seed, row_key)), [], ["__h", row_key], "__at")
    return placed.withColumn("batch", F.floor(F.col("__at") / batch_size).cast("int")).withColumn("at", F.col("__at") % batch_size).drop("__h", "__at")


def _by_runs(dealt: DataFrame, order: list[int], steps: int, piece: int) -> DataFrame:
    """An epoch's rows, stored by runs of ``steps`` batches in ``order``; a run's rows lie in pieces of at most ``piece`` places of a batch."""
    spark = dealt.sparkSession
    at = spark.createDataFrame(pa.table({"batch": pa.array(order, pa.int32()), "step": pa.array(range(len(order)), pa.int32())}))
    placed = dealt.join(F.broadcast(at), "batch").drop("batch").withColumn("run", F.floor(F.col("step") / steps).cast("int"))
    return materialize(placed.repartition("run", F.floor(F.col("at") / piece)), "runs", by=["run"])


def train_head(rows: DataFrame, hidden: str, log_prior: str, target: str, row_key: str, epochs: int, batch_size: int, rate: float = 1e-3, decay: float = 0.01, kl: float = 0.0, entropy: float = 0.0,
               seed: int = 42, start: tuple[np.ndarray, np.ndarray] | None = None) -> Head:
    """The head after ``epochs`` of AdamW over all rows, from ``start`` or zeros, with each epoch's mean losses.

    ``hidden`` holds D numbers, ``log_prior`` and ``target`` K, targets strictly positive; rows with a null in one of them are left out, no
    row at all is an error. ``row_key`` tells rows apart. An epoch's losses are those before each step, as means over its rows.
    """
    spark = rows.sparkSession
    able = rows.select(F.col(row_key).alias("k"), F.col(hidden).cast("array<double>").alias("hidden"), F.col(log_prior).cast("array<double>").alias("log_prior"), F.col(target).cast("array<double>").alias("target")).dropna()
    with scratch(spark):
        dealt = materialize(dealt_batches(able, "k", batch_size, seed).drop("k"), "batches")
        shape = dealt.agg(F.max("batch").alias("last"), F.max(F.size("hidden")).alias("d"), F.max(F.size("target")).alias("k")).first()
        if shape["last"] is None:
            raise ValueError("there are no rows to train on")
        k, d = shape["k"], shape["d"]
        steps, piece = max(1, RUN // (batch_size * (d + 2 * k))), max(1, RUN // (d + 2 * k))
        w, b = start if start is not None else (np.zeros((k, d)), np.zeros(k))
        x = np.concatenate([np.asarray(w, float).ravel(), np.asarray(b, float)])
        optimiser, out = AdamW(len(x), rate, decay=decay), Head(w, b)
        for epoch in range(epochs):
            seen = np.zeros(len(LOSSES) + 1)
            order = epoch_order(seed, epoch, shape["last"] + 1)
            stored = _by_runs(dealt, order, steps, piece)
            for first in range(0, len(order), steps):
                rows = spark.read.schema(stored.drop("run").schema).parquet(f"{stored._scratch_path}/run={first // steps}")
                if batch_size > piece:
                    sent = spark.sparkContext.broadcast((x[:k * d].reshape(k, d), x[k * d:]))
                    parts = rows.select("hidden", "log_prior", "target").mapInArrow(_sums(sent, kl, entropy), "place int, v double")
                    got = parts.groupBy("place").agg(F.sum("v").alias("v")).orderBy("place").toPandas()["v"].to_numpy()  # the head's size and five numbers
                    x = optimiser.step(x, got[:len(x)] / got[-1])
                    seen += got[len(x):]
                else:
                    sent = spark.sparkContext.broadcast((x, optimiser))
                    got = rows.coalesce(1).mapInArrow(_steps(sent, k, d, kl, entropy), "place int, v double").toPandas().sort_values("place")["v"].to_numpy()  # three times the head's size
                    x, optimiser.m, optimiser.v, losses = np.split(got, [len(x), 2 * len(x), 3 * len(x)])
                    optimiser.t += min(steps, len(order) - first)
                    seen += losses
                sent.destroy()
            release(stored)
            out.history.append(dict(zip(LOSSES, (seen[:-1] / seen[-1]).tolist(), strict=True)))
        out.weights, out.bias = x[:k * d].reshape(k, d), x[k * d:]
        return out


def calibrated(rows: DataFrame, hidden: str, log_prior: str, head: Head, out: str = "policy") -> DataFrame:
    """Add ``out``: softmax of the log-prior plus the head's delta, as one array; null where an input is null.

    The head is one broadcast row.
    """
    one = rows.sparkSession.createDataFrame([(head.weights.tolist(), head.bias.tolist())], "__w array<array<double>>, __b array<double>")
    delta = F.zip_with("__w", "__b", lambda w, b: dot(w, F.col(hidden)) + b)
    got = rows.crossJoin(F.broadcast(one)).withColumn("__z", F.zip_with(F.col(log_prior), delta, lambda p, x: p + x)).withColumn("__m", F.array_max("__z"))
    got = got.withColumn("__e", F.transform("__z", lambda z: F.exp(z - F.col("__m")))).withColumn("__s", F.aggregate("__e", F.lit(0.0), lambda s, e: s + e))
    policy = F.when(F.col(hidden).isNotNull() & F.col(log_prior).isNotNull(), F.transform("__e", lambda e: e / F.col("__s")))
    return got.withColumn(out, policy).drop("__w", "__b", "__z", "__m", "__e", "__s")
