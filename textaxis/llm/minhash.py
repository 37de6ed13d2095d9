"""Near duplicates by b-bit MinHash, confirmed on full sets.

1. Each set of distinct word n-grams gives ``MINIMA`` minima under random maps. ``ROWS`` whole minima at a time make a
   band; of every minimum the low ``BITS`` bits are retained and packed as the set's signature. Equal sets are one class.
2. Classes that agree in a band are candidates. Two sets at the limit miss all bands with a probability of
   ``(1 - s**ROWS) ** (MINIMA / ROWS)``: 6e-11 at 0.85.
3. The bits of two signatures that agree, counted and corrected for those that agree by chance, estimate the similarity.
   Pairs whose estimate is so low that a link has it with a probability under ``LOSS`` go.
4. What is left is confirmed on full sets, best estimates first; pairs that these links already join aren't compared.

A band that more than ``BUCKET`` classes share doesn't give all its pairs. Each of its members meets one hub, the member
that shares the largest buckets. Where that leaves a bucket in more than one part, its members go through the exact
prefix join of ``jaccard``, which needs no bands. So large buckets cost no quadratic work and lose no link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textaxis.llm.jaccard import _compared, _keys, jaccard_components, shingle_sets
from textaxis.llm.words import mix
from textaxis.operators.graph import connected_components
from textaxis.session import materialize, release, scratch

U = np.uint64
MINIMA, ROWS, BITS = 128, 4, 4
#: Classes of a bucket whose pairs are all taken, and the chance of losing a link by its estimate.
BUCKET, LOSS = 16, 1e-10
#: Hashes whose minima are taken at a time.
BLOCK = 1 << 16

_rng = np.random.default_rng(20240817)
_FACTORS = _rng.integers(0, 2**32, MINIMA, dtype=np.uint32) | np.uint32(1)
_BAND = _rng.integers(0, 2**64, (MINIMA // ROWS, ROWS), dtype=U) | U(1)
_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])
_NEAR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("star", pa.bool_()), ("same", pa.int32())])


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """``MINIMA`` 32-bit minima of each set of 64-bit hashes, one row a set."""
    out = np.empty((len(sets), MINIMA), np.uint32)
    lo = 0
    size = np.cumsum([len(s) for s in sets])
    while lo < len(sets):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + BLOCK, "right")))
        x = (np.concatenate(sets[lo:hi]) >> U(32)).astype(np.uint32)
        at = np.r_[0, size[lo:hi - 1] - (size[lo - 1] if lo else 0)]
        for i, f in enumerate(_FACTORS):
            out[lo:hi, i] = np.minimum.reduceat(x * f, at)
        lo = hi
    return out


def signatures(m: np.ndarray) -> np.ndarray:
    """The low bits of the mixed minima, two to a byte."""
    low = (mix(m.astype(U) + U(0x9E3779B97F4A7C15)) & U(2**BITS - 1)).astype(np.uint8)
    return low[:, ::2] | low[:, 1::2] << BITS


def bands(m: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each row, different for different bands."""
    return mix((m.reshape(len(m), -1, ROWS).astype(U) * _BAND).sum(axis=2) + np.arange(MINIMA // ROWS, dtype=U)).view(np.int64)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima whose low bits agree, for rows of packed signatures."""
    x = a ^ b
    x |= x >> 2 & 0x33
    x |= x >> 1
    return MINIMA - np.bitwise_count(x & 0x11).sum(axis=1, dtype=np.int64)


def estimate(same: float) -> float:
    """The similarity that so many agreeing minima tell, corrected for those that agree by chance."""
    chance = 2.0**-BITS
    return (same / MINIMA - chance) / (1 - chance)


def least_agreeing(similarity: float, loss: float = LOSS) -> int:
    """The most agreeing minima that sets of this similarity reach with a probability of at least ``1 - loss``."""
    chance = 2.0**-BITS
    p = chance + (1 - chance) * similarity
    below, same = 0.0, 0
    while same < MINIMA:
        below += math.comb(MINIMA, same) * p**same * (1 - p) ** (MINIMA - same)
        if below > loss:
            break
        same += 1
    return same


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k = np.zeros(len(batch), np.int64), np.zeros((2, len(batch)), np.int64)
            sig = np.zeros((len(batch), MINIMA * BITS // 8), np.uint8)
            keys = np.zeros((len(batch), MINIMA // ROWS), np.int64)
            at: list[int] = []
            sets: list[np.ndarray] = []
            held = 0

            def flush():
                m = minima(sets)
                sig[at], keys[at] = signatures(m), bands(m)
                at.clear()
                sets.clear()

            for i, s in shingle_sets(batch, words):
                n[i], k[:, i] = len(s), _keys(s)
                at.append(i)
                sets.append(s)
                held += len(s)
                if held > 16 * BLOCK:
                    flush()
                    held = 0
            if at:
                flush()
            lists = pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * keys.shape[1], keys.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(k[0]), pa.array(k[1]), pa.array([x.tobytes() for x in sig], pa.binary()), lists], schema=_SETS)

    return run


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), -1) for c in ("sig_a", "sig_b"))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("star"), pa.array(agreeing(x, y).astype(np.int32))], schema=_NEAR)


def _named_parts(links: DataFrame) -> DataFrame:
    """``(node, part)`` of the ends of links: the smallest node within two links, so that equal parts are joined."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    once = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
    return both.join(once, "b").groupBy("a").agg(F.min("m").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("part"))


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85, bucket: int = BUCKET) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row of ``docs`` (doc_id, text; other columns are ignored).

    Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their distinct ``words``-grams of lower-cased
    words; a text with fewer words has its whole sequence as its one shingle. The component is the smallest doc_id
    reachable, ``kept`` tells whether that is the row's own. A text without words, or null, has size 0, links with
    nothing and stays. A row without doc_id has a null component, links to nothing and is kept. Repeated rows each get a
    row; rows of one doc_id with different texts link by their texts only. Texts of any length are taken whole; an empty
    table gives no row. ``bucket`` sets which way members of a band take; it changes no result. Each link is confirmed
    exactly; one is lost with a probability under ``LOSS`` at the limit, less above it. ``percent`` should be 80 at
    least: below it, bands of four miss more.
    """
    t = (percent, 100)
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.where("doc_id is not null")
    with scratch(spark) as keep:
        found = materialize(docs.mapInArrow(_sketches(words), "doc_id long, n long, k1 long, k2 long, sig binary, bands array<long>"), "sketches", "zstd")
        rows = found.select("doc_id", "n", "k1", "k2")
        classes = found.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(
            F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("n", "sig", "bands")])
        classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes", "zstd")
        nodes = classes.select("node", "first", "k1", "k2", "sig")

        banded = classes.select("node", "n", F.explode("bands").alias("band"))
        sizes = banded.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
        members = materialize(banded.join(sizes, "band"), "members", "zstd")
        able = f"100 * least(n, n_b) >= {percent} * greatest(n, n_b)"
        few = members.where(F.col("members") <= bucket).select("band", "node", "n")
        pairs = few.join(few.select("band", F.col("node").alias("b"), F.col("n").alias("n_b")), "band").where("node < b").where(able)
        pairs = pairs.select(F.col("node").alias("a"), "b", F.lit(False).alias("star"))
        crowd = members.where(F.col("members") > bucket).select("band", "node", "members")
        weight = crowd.groupBy("node").agg(F.sum("members").alias("weight"))
        hubs = crowd.join(weight, "node").groupBy("band").agg(F.max(F.struct("weight", "node")).alias("hub"))
        stars = crowd.join(hubs, "band").groupBy("node").agg(F.max("hub").alias("hub")).where("node <> hub.node")
        stars = stars.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"), F.lit(True).alias("star"))
        pairs = pairs.unionByName(stars).groupBy("a", "b").agg(F.max("star").alias("star"))
        near = materialize(_estimated(pairs, nodes, percent), "near")

        # Each class is confirmed with its hub and its best partner first; only pairs that these links leave apart follow.
        both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "star", "same"))
        best = both.groupBy("b").agg(F.max_by("a", F.struct("same", "a")).alias("a")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        best = materialize(best.unionByName(near.where("star").select("a", "b")).distinct(), "best")
        links = _compared(best, known, nodes, words, t).where("linked").select("a", "b")
        part = materialize(_named_parts(links), "parts")
        left = materialize(_apart(near.select("a", "b").join(best, ["a", "b"], "left_anti"), part), "left")
        if not left.isEmpty():
            links = links.unionByName(_compared(left, known, nodes, words, t).where("linked").select("a", "b"))

        # Large buckets in more than one part: the exact join of their members.
        crowd = crowd.join(part, "node", "left").select("band", "node", F.coalesce("part", "node").alias("part"))
        open_ = crowd.groupBy("band").agg(F.min("part").alias("p1"), F.max("part").alias("p2")).where("p1 <> p2").select("band")
        ids = materialize(crowd.join(open_, "band", "left_semi").select("node").distinct(), "crowd")
        release(members)
        if not ids.isEmpty():
            asked = nodes.join(ids, "node").select("first", "node")
            texts = materialize(known.join(asked.select(F.col("first").alias("doc_id")), "doc_id", "left_semi"), "crowdtexts", "zstd")
            more = jaccard_components(texts, words, percent).where("component_id <> doc_id").select("doc_id", "component_id").distinct()
            pair = more.join(asked, F.col("doc_id") == F.col("first")).select(F.col("node").alias("b"), "component_id")
            links = links.unionByName(pair.join(asked, F.col("component_id") == F.col("first")).select(F.col("node").alias("a"), "b"))
        part = connected_components(links)

        named = classes.select("node", "first", "k1", "k2").join(part, F.col("node") == F.col("id"), "left").withColumn("c", F.coalesce("component", "node"))
        least = named.where("component is not null").groupBy("c").agg(F.min("first").alias("least"))
        labels = named.join(least, "c", "left").select("k1", "k2", F.coalesce("least", "first").alias("component_id"))
        real = rows.where("n > 0 and doc_id is not null").join(labels, ["k1", "k2"])
        rest = rows.where("n = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
        columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")]
        return keep(materialize(real.select(*columns).unionByName(rest.select(*columns)), "components"))


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b, star) whose signatures leave a link possible, with the minima that agree."""
    x, y = (nodes.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}")) for c in ("a", "b"))
    near = pairs.join(x, "a").join(y, "b").select("a", "b", "star", "sig_a", "sig_b").mapInArrow(_near, "a long, b long, star boolean, same int")
    return near.where(F.col("same") >= least_agreeing(percent / 100))


def _apart(pairs: DataFrame, part: DataFrame) -> DataFrame:
    """Pairs whose ends are in different parts."""
    named = [part.select(F.col("node").alias(c), F.col("part").alias(f"part_{c}")) for c in ("a", "b")]
    placed = pairs.join(named[0], "a", "left").join(named[1], "b", "left")
    return placed.where("coalesce(part_a, a) <> coalesce(part_b, b)").select("a", "b")
