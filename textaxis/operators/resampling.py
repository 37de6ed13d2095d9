"""Permutations and bootstraps over all rows of a table in one scan.

Random numbers are a function of (seed, repetition, row), so a repetition needs no sort, no join and no drawn table: a
task evaluates a block of repetitions on a block of rows and hands on one partial sum for each. A permutation is a
keyed bijection of places: a Feistel network over the next power of four, walked until it falls inside the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textaxis.operators.ranking import average_ranks, numbered, ordered
from textaxis.session import materialize, scratch

#: Numbers that are worked on at a time.
TILE = 1 << 18
#: Runs of tied places that are broadcast at a time; more are taken in blocks, one scan each.
RUNS = 1 << 20
#: floor(2**32 * P(X <= k)) of a Poisson variable with mean 1, k = 0 to 10.
POISSON = tuple(int(2**32 * sum(np.exp(-1.0) / float(np.prod(range(1, j + 1), dtype=float)) for j in range(k + 1))) for k in range(11))
_M = np.uint64(0xFFFFFFFF)


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit values in 64-bit words."""
    x = x ^ (x >> np.uint64(16))
    x = x * np.uint64(0x85EBCA6B) & _M
    x = x ^ (x >> np.uint64(13))
    x = x * np.uint64(0xC2B2AE35) & _M
    return x ^ (x >> np.uint64(16))


def stream_key(seed: int, rep: np.ndarray, stream: int) -> np.ndarray:
    """The 32-bit key of a stream of random numbers of each repetition."""
    return mix32(mix32(np.array([(seed + 0x9E3779B9 * (stream + 1)) & 0xFFFFFFFF], np.uint64)) + rep.astype(np.uint64) & _M)


def uniform32(seed: int, rep: np.ndarray, row: np.ndarray) -> np.ndarray:
    """32 random bits for each (repetition, row); ``row`` are longs."""
    row = row.astype(np.int64).view(np.uint64)
    low = mix32((row & _M)[None, :] + stream_key(seed, rep, 0)[:, None] & _M)
    return mix32(low + (row >> np.uint64(32))[None, :] & _M)


def poisson_counts(seed: int, rep: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How often each row is drawn in each repetition: Poisson with mean 1."""
    return np.searchsorted(np.array(POISSON, np.uint64), uniform32(seed, rep, row), "right")


def permuted(seed: int, rep: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Where each repetition's permutation of 0 to n - 1 puts each place."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [stream_key(seed, rep, r) for r in range(4)]
    out = np.broadcast_to(place.astype(np.uint64), (len(rep), len(place))).ravel()
    row = np.repeat(np.arange(len(rep)), len(place))
    todo = np.arange(out.size)
    out = out.copy()
    while len(todo):
        left, right, own = out[todo] >> half, out[todo] & mask, row[todo]
        for k in keys:
            left, right = right, left ^ (mix32(right + k[own] & _M) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.reshape(len(rep), len(place)).astype(np.int64)


def _tiles(rows: int, reps: int) -> Iterator[np.ndarray]:
    step = max(1, TILE // max(1, rows))
    for lo in range(0, reps, step):
        yield np.arange(lo, min(reps, lo + step))


def _permutation_sums(reps: int, seed: int, n: int, runs, low: int, high: int):
    """Each repetition's sum of products of twice the ranks, over places that it puts at ``low`` to before ``high``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, size = runs.value
        total = np.zeros(reps)
        for batch in batches:
            x, place = batch.column("x2").to_numpy().astype(float), batch.column("place").to_numpy()
            for a in range(0, len(x), TILE):
                for rep in _tiles(min(TILE, len(x) - a), reps):
                    to = permuted(seed, rep, place[a:a + TILE], n)
                    rank = 2.0 * (to + 1)
                    if len(start):
                        j = np.maximum(np.searchsorted(start, to, "right") - 1, 0)
                        tied = (to >= start[j]) & (to < start[j] + size[j])
                        rank = np.where(tied, 2.0 * start[j] + size[j] + 1, rank)
                    if low > 0 or high < n:
                        rank *= (to >= low) & (to < high)
                    total[rep] += rank @ x[a:a + TILE]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(reps)), pa.array(total)], names=["rep", "s"])

    return run


def permutation_test(rows: DataFrame, x: str, y: str, row_key: str, reps: int = 10_000, seed: int = 42) -> DataFrame:
    """``(n, spearman, hits, p)``: the two-sided permutation p-value of a Spearman correlation, (hits + 1) / (reps + 1).

    Rows with a null ``x`` or ``y`` are left out; ties have averaged ranks; ``row_key`` tells rows apart. A repetition pairs
    each row's rank in ``x`` with the rank in ``y`` at the place that the bijection gives: places along ``y`` are ranks
    already but for runs of ties, whose table is broadcast in blocks of ``RUNS``. With fewer than two rows or a constant column the
    correlation and p are null.
    """
    spark = rows.sparkSession
    with scratch(spark) as keep:
        able = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(row_key, x, y)
        ranked = average_ranks(average_ranks(able, x, [], "__rx"), y, [], "__ry", stored=True).select(row_key, y, "__rx", "__ry")
        placed = materialize(ordered(ranked, [], [y, row_key], "place").select((2 * F.col("__rx")).cast("long").alias("x2"), (2 * F.col("__ry")).cast("long").alias("y2"), "place"), "places")
        seen = placed.agg(F.count("*").alias("n"), F.corr("x2", "y2").alias("r"), F.stddev_pop("x2").alias("sx"), F.stddev_pop("y2").alias("sy")).first()
        n = seen["n"]
        if n < 2 or not seen["sx"] or not seen["sy"]:
            return keep(materialize(spark.createDataFrame([(n, None, None, None)], "n long, spearman double, hits long, p double"), "permutations"))
        runs = placed.groupBy("y2").agg(F.min("place").alias("start"), F.count("*").alias("size")).where("size > 1").select("start", "size")
        runs = materialize(numbered(runs, "start", "number"), "runs")
        blocks = 1 + (runs.count() - 1) // RUNS if not runs.isEmpty() else 1
        sums, low = None, 0
        for b in range(blocks):
            block = runs.where(F.floor(F.col("number") / RUNS) == b).orderBy("start").toPandas()  # at most RUNS rows
            high = n if b == blocks - 1 else int(block["start"].iloc[-1] + block["size"].iloc[-1])
            tied = spark.sparkContext.broadcast((block["start"].to_numpy(np.int64), block["size"].to_numpy(np.int64)))
            part = placed.select("x2", "place").mapInArrow(_permutation_sums(reps, seed, n, tied, low, high), "rep long, s double")
            sums, low = part if sums is None else sums.unionByName(part), high
        null = (F.sum("s") / n - (n + 1.0) ** 2) / (seen["sx"] * seen["sy"])
        hits = F.count_if(F.abs("c") >= F.lit(abs(seen["r"]) - 1e-9)).alias("hits")
        got = sums.groupBy("rep").agg(null.alias("c")).agg(hits)
        return keep(materialize(got.select(F.lit(n).cast("long").alias("n"), F.lit(seen["r"]).alias("spearman"), "hits", ((F.col("hits") + 1) / F.lit(reps + 1)).alias("p")), "permutations"))


def _bootstrap_sums(columns: list[str], reps: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = np.zeros((len(columns), reps)), np.zeros((len(columns), reps))
        for batch in batches:
            row = batch.column("__row").to_numpy()
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns])
            able = ~np.isnan(x)
            x = np.where(able, x, 0.0)
            for a in range(0, len(row), TILE):
                for rep in _tiles(min(TILE, len(row) - a), reps):
                    drawn = poisson_counts(seed, rep, row[a:a + TILE]).astype(float)
                    weight[:, rep] += able[:, a:a + TILE].astype(float) @ drawn.T
                    total[:, rep] += x[:, a:a + TILE] @ drawn.T
        for i, c in enumerate(columns):
            yield pa.RecordBatch.from_arrays([pa.array([c] * reps), pa.array(np.arange(reps)), pa.array(weight[i]), pa.array(total[i])], names=["x", "rep", "w", "s"])

    return run


def bootstrap_moments(rows: DataFrame, columns: list[str], row_key: str, reps: int = 1000, seed: int = 42) -> DataFrame:
    """``(x, n, mean, boot_mean, se)`` of each column: its mean, and mean and standard deviation of its resampled means.

    A row is drawn a Poisson(1) number of times in each repetition, as for a resample of random size n; a mean is that of
    the rows drawn. Nulls and NaN are left out; ``row_key`` is a long that tells rows apart, so results don't depend on
    partitions. All columns see the same draws. Repetitions that draw nothing have no mean; an empty table has null means.
    """
    numbers = rows.select(F.col(row_key).cast("long").alias("__row"), *[F.col(c).cast("double").alias(c) for c in columns])
    sums = numbers.mapInArrow(_bootstrap_sums(columns, reps, seed), "x string, rep long, w double, s double")
    means = sums.groupBy("x", "rep").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    spread = means.groupBy("x").agg(F.avg("m").alias("boot_mean"), F.stddev_samp("m").alias("se"))
    real = [F.when(~F.isnan(c), F.col(c)) for c in columns]
    own = numbers.agg(*[f(v).alias(f"__{k}{i}") for i, v in enumerate(real) for k, f in (("n", F.count), ("m", F.avg))])
    own = own.select(F.inline(F.array(*[F.struct(F.lit(c).alias("x"), F.col(f"__n{i}").alias("n"), F.col(f"__m{i}").alias("mean")) for i, c in enumerate(columns)])))
    return own.join(F.broadcast(spread), "x", "left")
