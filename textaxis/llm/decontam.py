"""Benchmark decontamination: rare word seeds find passages, Smith-Waterman alignment decides.

The test items' seeds are spaced triples of words: six shapes of three words within five places, so that copies with
every third or fourth word changed still hold some. One scan of the training texts finds the places whose triples might
be seeds (a bitmap of fixed size, broadcast, stands for the seed table, so the scan needs no shuffle and its broadcast
does not grow). Where the seed table itself is small (``INDEX_SEEDS``, as benchmarks are), it goes along and the scan
leaves out hits that cannot reach the limit, as too few of the item's words stand around them at all. Spark then joins
the seeds of the passages to the seed table. Every pair of passage and item that shares a seed goes on, however common
the seed is; the same bound by words is taken before each alignment, so both ways give the same pairs. The alignment
is local, over words, and scores edited copies: a word more, less or changed costs half of what an equal one earns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textaxis.llm.words import NOT_ALNUM, lean, mix, word_slices
from textaxis.session import materialize, scratch

BITMAP = 1 << 25
#: Places of a seed's words, from its first one.
SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
#: Most seeds whose table (28 bytes a seed, and the items' words) goes along with the scan.
INDEX_SEEDS = 1 << 20
MATCH, MISMATCH, GAP = 2, -1, -1

_SEEDS = pa.schema([("item_id", pa.int64()), ("seed", pa.int64()), ("item_pos", pa.int32()), ("words", pa.binary())])
_PASSAGES = pa.schema([("doc_id", pa.int64()), ("base", pa.int32()), ("words", pa.binary()), ("pos", pa.list_(pa.int32())), ("seed", pa.list_(pa.int64()))])


def seeds_of(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All seeds of texts, whose words have the hashes ``h``, and the place of each one's first word."""
    seed, place = [], []
    for number, shape in enumerate(SHAPES):
        n = len(h) - shape[-1]
        if n > 0:
            x = np.full(n, number + 1, np.uint64)
            for at in shape:
                x = mix(x * np.uint64(3) + h[at:at + n])
            inside = np.flatnonzero(row[:n] == row[shape[-1]:])
            seed.append(x[inside])
            place.append(inside)
    return (np.concatenate(seed), np.concatenate(place)) if seed else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(39)).astype(np.int64)  # 25 bits: BITMAP


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        item = batch.column("item_id").to_pylist()
        for lo, hi, row, h in word_slices(batch, "text", NOT_ALNUM, lower=True):
            cut = np.searchsorted(row, np.arange(hi - lo + 1))
            for i in range(hi - lo):
                words = h[cut[i]:cut[i + 1]]
                seed, place = seeds_of(words, np.zeros(len(words), np.int8))
                if k := len(seed):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([item[lo + i]] * k, pa.int64()), pa.array(seed.view(np.int64)), pa.array(place.astype(np.int32)),
                        pa.array([words.tobytes()] + [None] * (k - 1), pa.binary())], schema=_SEEDS)


class SeedIndex:
    """The seed table in arrays, for hits that can be judged in the scan."""

    def __init__(self, seeds):
        """``seeds`` is the whole table as pandas: item_id, seed, item_pos, words (on one row of each text)."""
        text = seeds["words"].notna().to_numpy().cumsum() - 1  # rows of a text follow one another, the one with words first
        self.words = [np.frombuffer(w, np.uint64) for w in seeds["words"].dropna()]
        self.vocabulary = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, np.uint64)
        self.words = [np.searchsorted(self.vocabulary, w) for w in self.words]
        seed = seeds["seed"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(seed, kind="stable")
        self.seed, self.text, self.place = seed[order], text[order], seeds["item_pos"].to_numpy(np.int64)[order]

    def able(self, h: np.ndarray, row: np.ndarray, seed: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
        """Which hits of a slice of texts have enough words of some item around them."""
        low, high = np.searchsorted(self.seed, seed, "left"), np.searchsorted(self.seed, seed, "right")
        many = high - low
        hit = np.repeat(np.arange(len(seed)), many)
        entry = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        start = at[hit] - self.place[entry]
        first, last = np.searchsorted(row, row[at[hit]], "left"), np.searchsorted(row, row[at[hit]], "right")
        known = np.searchsorted(self.vocabulary, h)
        known[known == len(self.vocabulary)] = 0
        known[self.vocabulary[known] != h] = len(self.vocabulary)
        here = np.zeros(len(self.vocabulary) + 1, bool)
        keep, judged = np.zeros(len(seed), bool), {}
        for i, t, s, a, b in zip(hit.tolist(), self.text[entry].tolist(), start.tolist(), first.tolist(), last.tolist(), strict=True):
            if keep[i]:
                continue
            words = self.words[t]
            m = len(words)
            if (got := judged.get((t, s))) is None:
                near = known[max(a, s - m // 2):min(b, s + m + m // 2)]
                here[near] = True
                got = judged[t, s] = 100 * np.count_nonzero(here[words]) >= percent * m
                here[near] = False
            keep[i] = got
        return keep


def _passages(reach: int, percent: int, bitmap, index):
    """Hits closer than ``reach`` share a passage, which has ``reach`` words more on both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        might, table = bitmap.value, index.value
        for batch in batches:
            doc = batch.column("doc_id").to_pylist()
            for lo, _, row, h in word_slices(batch, "text", NOT_ALNUM, lower=True):
                seed, at = seeds_of(h, row)
                slot = _slot(seed)
                hit = np.flatnonzero((might[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
                seed, at = seed[hit], at[hit]
                if table is not None and len(at):
                    keep = table.able(h, row, seed, at, percent)
                    seed, at = seed[keep], at[keep]
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                seed, at = seed[order], at[order]
                cuts = np.flatnonzero(np.r_[True, (np.diff(at) > reach) | (row[at[1:]] != row[at[:-1]]), True])
                out: list[list] = [[], [], [], [], []]
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    r = row[at[a]]
                    first, last = np.searchsorted(row, [r, r + 1])
                    x, y = max(first, at[a] - reach), min(last, at[b - 1] + reach)
                    for c, v in zip(out, (doc[lo + r], x - first, h[x:y].tobytes(), (at[a:b] - x).astype(np.int32), seed[a:b].view(np.int64)), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PASSAGES, strict=True)], schema=_PASSAGES)

    return run


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair and the number of text words up to its end.

    Rows of the matrices are item words; all pairs advance together, and a row's horizontal gaps are one running
    maximum.
    """
    m, w = max(map(len, items)), max(map(len, texts))
    a, b = np.zeros((len(items), m), np.uint64), np.zeros((len(items), w), np.uint64)
    ok_a, ok_b = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    for i, (x, y) in enumerate(zip(items, texts, strict=True)):
        a[i, :len(x)], b[i, :len(y)], ok_a[i, :len(x)], ok_b[i, :len(y)] = x, y, True, True
    ramp = np.arange(w, dtype=np.int32) * -GAP
    above = np.zeros((len(items), w + 1), np.int32)
    best, end = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    for i in range(m):
        step = np.where((a[:, i, None] == b) & ok_b & ok_a[:, i, None], MATCH, MISMATCH).astype(np.int32)
        here = np.maximum(np.maximum(above[:, :-1] + step, above[:, 1:] + GAP), 0)
        here = np.maximum.accumulate(here + ramp, axis=1) - ramp
        above[:, 1:] = np.where(ok_a[:, i, None], here, 0)
        top = here.argmax(axis=1)
        value = here[np.arange(len(items)), top]
        more = (value > best) & ok_a[:, i]
        best[more], end[more] = value[more], top[more] + 1
    return best, end


def _aligned(percent: int):
    names = ["doc_id", "item_id", "start_word", "end_word", "item_words", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            jobs: list[tuple] = []

            def done(jobs: list[tuple]) -> pa.RecordBatch:
                items, texts = [j[2] for j in jobs], [j[3] for j in jobs]
                score, end = align(items, texts)
                part = [np.ascontiguousarray(t[:e][::-1]) if e else t[:1] for t, e in zip(texts, end, strict=True)]
                _, length = align([np.ascontiguousarray(x[::-1]) for x in items], part)
                size = np.array([len(x) for x in items])
                base = np.array([j[4] for j in jobs])
                rows = pa.RecordBatch.from_arrays([
                    pa.array([j[0] for j in jobs], pa.int64()), pa.array([j[1] for j in jobs], pa.int64()),
                    pa.array(base + end - length), pa.array(base + end), pa.array(size.astype(np.int64)),
                    pa.array(score / (MATCH * size))], names=names)
                return rows.filter(pa.array(100 * score >= percent * MATCH * size))

            cells = 0
            for doc, item, base, words, item_words, hits in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "item_id", "base", "words", "item_words", "hits")), strict=True):
                x, y = np.frombuffer(item_words, np.uint64), np.frombuffer(words, np.uint64)
                begin = sorted({p - q for h in hits for p in h["pos"] for q in h["item_pos"]})
                lo = begin[0]
                spans = []
                for p, q in zip(begin, [*begin[1:], None], strict=True):
                    if q is None or q - p > len(x):
                        spans.append((max(0, lo - len(x) // 2), min(len(y), p + len(x) + len(x) // 2)))
                        lo = q
                for s, e in spans:
                    if 100 * int(np.isin(x, y[s:e]).sum()) < percent * len(x):  # an item word earns MATCH at most once
                        continue
                    jobs.append((doc, item, x, y[s:e], base + s))
                    cells = max(cells, (e - s))
                    if len(jobs) * cells > 200_000:
                        yield done(jobs)
                        jobs, cells = [], 0
            if jobs:
                yield done(jobs)

    return run


def contaminated_pairs(docs: DataFrame, items: DataFrame, percent: int = 50, index_seeds: int = INDEX_SEEDS) -> DataFrame:
    """``(doc_id, item_id, start_word, end_word, item_words, score, n_places)``, one row per document and leaked item.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored. Words are runs of letters and
    digits, A-Z in lower case. A document holds an item if the best alignment reaches ``percent`` of the score of a
    whole exact copy and holds a seed (three equal words within five places, in any of ``SHAPES``); ``score`` is that
    share, the places are those of the best alignment, of equal ones the first; ``n_places`` counts the places that
    reach the limit. Items of fewer than three words and null texts match nothing; rows without doc_id or item_id are
    left out; repeated rows count once per pair. Texts of any length are read whole; an empty table gives no row.
    """
    spark = docs.sparkSession
    items = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch(spark) as keep:
        seeds = materialize(items.mapInArrow(lean(_item_seeds), "item_id long, seed long, item_pos int, words binary"), "seeds")
        places = seeds.select(F.shiftrightunsigned("seed", 39).alias("s")).distinct().toPandas()["s"].to_numpy(np.int64)  # at most BITMAP
        bits = np.zeros(BITMAP, np.uint8)
        bits[places] = 1
        few = seeds.count() <= index_seeds
        index = spark.sparkContext.broadcast(SeedIndex(seeds.toPandas()) if few else None)
        reach = max(1, seeds.agg(F.max(F.octet_length("words"))).first()[0] or 0) // 8 * 3 // 2 + SHAPES[-1][-1]
        shape = "doc_id long, base int, words binary, pos array<int>, seed array<long>"
        found = texts.mapInArrow(lean(_passages(reach, percent, spark.sparkContext.broadcast(np.packbits(bits, bitorder="little")), index)), shape)
        found = materialize(found.withColumn("passage", F.monotonically_increasing_id()), "passages")

        # Places are brought together by seed on both sides first, so a seed and an item meet once per passage.
        hits = found.select("passage", F.explode(F.arrays_zip("pos", "seed")).alias("h")).groupBy("passage", "h.seed").agg(F.collect_list("h.pos").alias("pos"))
        of = seeds.groupBy("seed", "item_id").agg(F.collect_set("item_pos").alias("item_pos"))
        pairs = hits.join(of, "seed").groupBy("passage", "item_id").agg(F.collect_list(F.struct("pos", "item_pos")).alias("hits"))
        whole = seeds.where("words is not null").select("item_id", F.col("words").alias("item_words"))
        jobs = pairs.join(found.select("passage", "doc_id", "base", "words"), "passage").join(whole, "item_id")
        shape = "doc_id long, item_id long, start_word long, end_word long, item_words long, score double"
        scored = jobs.select("doc_id", "item_id", "base", "words", "item_words", "hits").mapInArrow(lean(_aligned(percent)), shape)
        best = scored.groupBy("doc_id", "item_id").agg(
            F.max(F.struct("score", -F.col("start_word"), "end_word", "item_words")).alias("b"),
            F.count_distinct("start_word", "end_word").alias("n_places"))
        return keep(materialize(best.select(
            "doc_id", "item_id", (-F.col("b.col2")).alias("start_word"), "b.end_word", "b.item_words", F.round("b.score", 6).alias("score"), "n_places"), "leaks"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that hold no item; all columns. Rows without doc_id or text stay."""
    bad = contaminated_pairs(docs, items, **how).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
