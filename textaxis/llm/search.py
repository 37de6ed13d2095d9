"""Ranked lexical search with a two-level quantised index.

The index is made of segments of a few thousand documents. Its first level holds, for each term of a segment, the
documents and their *impacts*: the term's saturated frequency, divided by a step and rounded up to a byte. Its second
level holds exact frequencies and lengths. A query set is searched in blocks:

1. impacts alone give every document an upper bound, and a lower bound one step below for each of its terms;
2. the kth largest lower bound of each item, over all segments, is its threshold;
3. every document whose upper bound reaches the threshold is scored exactly in 64-bit integers on the second level.

So no document of the answer is lost, and only a few are scored exactly. What travels is a few bounds per segment and
item; the k best of a task leave it, not all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textaxis.llm.terms import coded_terms, counted
from textaxis.llm.words import NOT_ALNUM
from textaxis.operators.ranking import keyed_offsets
from textaxis.session import materialize, release, scratch

#: The saturated frequency is below this; impacts are its parts of one step each, rounded up.
WHOLE = 1_000_000
STEP = -(-WHOLE // 255)
#: Items of one block hold at most about so many characters; a longer one is a block of its own.
BLOCK_CHARS = 1 << 22

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SEGMENT = "segment long, ids binary, sizes binary, terms array<int>, counts array<int>, docs binary, tfs binary"
_SEGMENT_ARROW = pa.schema([("segment", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("terms", pa.list_(pa.int32())),
                            ("counts", pa.list_(pa.int32())), ("docs", pa.binary()), ("tfs", pa.binary())])
_BOUNDS = pa.schema([("segment", pa.int64()), ("item", pa.int32()), ("place", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])
_SCORES = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(text: str | None) -> list[str]:
    """The terms of one text, with repeats; a null text has none."""
    return _TERM.findall((text or "").translate(_UPPER))


def _segments(vocabulary):
    """Segments with the postings of the asked terms, by term; the sizes count all terms of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(vocabulary.value, pa.large_string())
        for batch in batches:
            for lo, hi, row, code, dictionary in coded_terms(batch, NOT_ALNUM):
                n = hi - lo
                number = pc.index_in(dictionary, asked).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                number = number[code]
                hit = number >= 0
                key, tf = counted(number[hit] * n + row[hit])
                terms, counts = counted(key // n)
                ids = batch.column("doc_id").slice(lo, n)
                known = np.asarray(ids.is_valid())
                sizes = np.bincount(row, minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column("segment").slice(lo, 1),
                    pa.array([ids.fill_null(0).to_numpy().tobytes() + np.packbits(known).tobytes()], pa.binary()), pa.array([sizes.tobytes()], pa.binary()),
                    pa.array([terms.astype(np.int32)], pa.list_(pa.int32())), pa.array([counts.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([(key % n).astype(np.int32).tobytes()], pa.binary()), pa.array([tf.astype(np.int32).tobytes()], pa.binary())], schema=_SEGMENT_ARROW)

    return run


def saturated(tf: np.ndarray, size: np.ndarray, documents: int, tokens: int) -> np.ndarray:
    """``(10**9 * tf) div (1000 * tf + 8 * m)``, m the length in percent of the mean, damped by three quarters."""
    m = 25 + (75 * size * documents) // tokens
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _impacts(documents: int, tokens: int):
    """The first level of each segment: a byte for each posting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for docs, tfs, sizes in zip(*(batch.column(c) for c in ("docs", "tfs", "sizes")), strict=True):
                tf, size = np.frombuffer(tfs.as_buffer(), np.int32).astype(np.int64), np.frombuffer(sizes.as_buffer(), np.int64)
                x = saturated(tf, size[np.frombuffer(docs.as_buffer(), np.int32)], documents, max(1, tokens))
                out.append((-(-x // STEP)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("segment", "sizes", "terms", "counts", "docs")), pa.array(out, pa.binary())],
                                             names=["segment", "sizes", "terms", "counts", "docs", "impacts"])

    return run


def _postings(terms, counts) -> tuple[dict[int, int], np.ndarray]:
    """Where each term's postings begin in a segment: the term's place, and the bounds of all places."""
    t, c = terms.values.to_numpy(), counts.values.to_numpy()
    return dict(zip(t.tolist(), range(len(t)), strict=True)), np.r_[0, np.cumsum(c, dtype=np.int64)]


def _bounds(items, k: int):
    """Documents that may be among an item's k best, with both bounds.

    An item's threshold in a task is the kth lower bound of its segments so far, so a task sends little more than k
    documents of an item however many segments it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, sizes, terms, counts, docs, impacts in zip(*(batch.column(c) for c in ("segment", "sizes", "terms", "counts", "docs", "impacts")), strict=True):
                n = len(sizes.as_buffer()) // 8
                at, cuts = _postings(terms, counts)
                doc, impact = np.frombuffer(docs.as_buffer(), np.int32), np.frombuffer(impacts.as_buffer(), np.uint8).astype(np.int64)
                found: list[list[np.ndarray]] = [[], [], [], []]
                for item, weights in items.value:
                    high, taken = np.zeros(n, np.int64), np.zeros(n, np.int64)
                    for term, w in weights:
                        if (i := at.get(term)) is not None:
                            d = doc[cuts[i]:cuts[i + 1]]
                            high[d] += w * impact[cuts[i]:cuts[i + 1]]
                            taken[d] += w
                    some = np.flatnonzero(high)
                    if not len(some):
                        continue
                    low = STEP * (high[some] - taken[some])
                    mine = best.get(item)
                    mine = low if mine is None else np.concatenate([mine, low])
                    if len(mine) > k:
                        mine = np.partition(mine, len(mine) - k)[-k:]
                    best[item] = mine
                    reach = STEP * high[some] >= (mine.min() if len(mine) == k else 0)
                    some, low = some[reach], low[reach]
                    for column, x in zip(found, (np.full(len(some), item), some, low, STEP * high[some]), strict=True):
                        column.append(x)
                cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), segment.as_py(), np.int64)), pa.array(cols[0].astype(np.int32)), pa.array(cols[1].astype(np.int32)),
                                                  pa.array(cols[2].astype(np.int64)), pa.array(cols[3].astype(np.int64))], schema=_BOUNDS)

    return run


def _rescored(items, documents: int, tokens: int):
    """Exact scores of the asked places of each segment; rows without doc_id aren't returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = dict(items.value)
        for batch in batches:
            for row in batch.to_pylist():
                at, cuts = _postings(pa.scalar(row["terms"], pa.list_(pa.int32())), pa.scalar(row["counts"], pa.list_(pa.int32())))
                doc, tf, size = (np.frombuffer(row[c], kind) for c, kind in (("docs", np.int32), ("tfs", np.int32), ("sizes", np.int64)))
                n = len(size)
                ids, known = np.frombuffer(row["ids"], np.int64, n), np.unpackbits(np.frombuffer(row["ids"], np.uint8, offset=8 * n), count=n).astype(bool)
                asked: dict[int, list[int]] = {}
                for x in row["asked"]:
                    asked.setdefault(x["item"], []).append(x["place"])
                out: list[list[np.ndarray]] = [[], [], []]
                for item, places in asked.items():
                    places = np.unique(np.array(places, np.int64))
                    score = np.zeros(len(places), np.int64)
                    for term, w in weights[item]:
                        if (i := at.get(term)) is not None:
                            d = doc[cuts[i]:cuts[i + 1]]  # ascending
                            j = np.minimum(np.searchsorted(d, places), len(d) - 1)
                            hit = d[j] == places
                            score[hit] += w * saturated(tf[cuts[i] + j[hit]].astype(np.int64), size[places[hit]], documents, tokens)
                    real = known[places] & (score > 0)
                    for column, x in zip(out, (np.full(int(real.sum()), item), ids[places[real]], score[real]), strict=True):
                        column.append(x)
                arrays = [pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(out, _SCORES, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=_SCORES)

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``k`` best documents with a score above 0, ties by doc_id.

    A term's weight is ``floor(1000 * ln((2N + 2) / (2 df + 1)))``, its part of a score the weight times the saturated
    frequency; a term that an item repeats counts as often. ``docs`` has (doc_id, text), ``items`` (item_id, text); other
    columns are ignored. Null and empty texts have no terms: such documents don't count in N, such items have no rows. Each row
    is a document, or an item, of its own, also repeated ones and those of one id; documents without doc_id count in all
    statistics, but aren't returned; items without item_id are ranked under null. Texts of any length are taken whole. An
    empty table gives no rows. Items are taken in blocks of about ``BLOCK_CHARS`` characters, which bounds what is
    broadcast; each block searches all documents, whose postings of the block's terms are its index.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("segment"))
    asked = items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("__w", F.length("text") + 1)
    with scratch(spark) as keep:
        # Numbers are gapped by the length before them, so they also tell the block.
        asked = materialize(keyed_offsets(asked.withColumn("__i", F.col("item_id").cast("string")), [], ["__i", "text"], weight="__w", out="number"), "items")
        asked = asked.withColumn("block", F.floor(F.col("number") / BLOCK_CHARS))
        parts = []
        for block in [r["block"] for r in asked.select("block").distinct().orderBy("block").toLocalIterator()]:
            mine = asked.where(F.col("block") == block)
            texts = mine.select("number", "text").orderBy("number").collect()  # at most a block
            parts.append(keep(_search_block(docs, mine, [(r["number"], terms_of(r["text"])) for r in texts], k)))
    if not parts:
        return items.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _search_block(docs: DataFrame, asked: DataFrame, texts: list[tuple[int, list[str]]], k: int) -> DataFrame:
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    vocabulary = sorted({t for _, terms in texts for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    with scratch(spark) as keep:
        exact = materialize(docs.mapInArrow(_segments(sc.broadcast(vocabulary)), _SEGMENT), "index", "zstd")
        sums = exact.select("sizes").mapInArrow(_totals, "documents long, tokens long").agg(F.sum("documents").alias("n"), F.sum("tokens").alias("l")).first()
        documents, tokens = sums["n"] or 0, sums["l"] or 0
        df = exact.select(F.inline(F.arrays_zip("terms", "counts"))).groupBy("terms").agg(F.sum("counts").alias("df"))
        log = F.log((2 * F.lit(float(documents)) + 2) / (2 * F.col("df").cast("double") + 1))
        weight = {r["terms"]: r["w"] for r in df.select("terms", F.floor(1000 * log).alias("w")).collect()}  # one row for each of the block's terms
        queries = []
        for i, (_, terms) in enumerate(texts):
            n, times = counted(np.array([number[t] for t in terms], np.int64))
            queries.append((i, [(t, c * weight[t]) for t, c in zip(n.tolist(), times.tolist(), strict=True) if weight.get(t)]))
        queries = sc.broadcast(queries)

        quick = materialize(exact.drop("ids").mapInArrow(_impacts(documents, tokens), "segment long, sizes binary, terms array<int>, counts array<int>, docs binary, impacts binary"),
                            "impacts", "zstd")
        bounds = materialize(quick.mapInArrow(_bounds(queries, k), "segment long, item int, place int, low long, high long"), "bounds")
        release(quick)
        ranked = bounds.select("item", "low", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low"))).alias("rn")).where(F.col("rn") <= k)
        least = ranked.groupBy("item").agg(F.when(F.count("*") == k, F.min("low")).otherwise(0).alias("least"))
        left = bounds.join(least, "item").where("high >= least").groupBy("segment").agg(F.collect_list(F.struct("item", "place")).alias("asked"))
        left = materialize(left, "asked")
        scores = exact.join(left, "segment").mapInArrow(_rescored(queries, documents, tokens), "item int, doc_id long, score long")
        best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        top = scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(texts)], "item int, number long")
        named = names.join(asked.select("number", "item_id"), "number")
        return keep(materialize(top.join(named, "item").select("item_id", "rank", "doc_id", "score"), "ranked"))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term, and terms, of each batch of segments."""
    for batch in batches:
        sizes = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("sizes")]
        yield pa.RecordBatch.from_arrays([pa.array([sum(int((s > 0).sum()) for s in sizes)]), pa.array([sum(int(s.sum()) for s in sizes)])], names=["documents", "tokens"])
