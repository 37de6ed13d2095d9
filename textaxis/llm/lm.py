"""Language-model scoring with a causal self-attention model in numpy.

The model reads subword ids. One attention head, causal and over a bounded context, weighs the earlier places of a
text: queries and keys are the ids themselves, on scales that are learned (how much an equal id counts, by the class
of the id, more if the ids before are equal, too; how much a key of each class counts; how much each distance counts).
What it attends to are the tokens that followed there, so its output is a distribution over ids. A learned gate, by
the last token and by whether the head found an equal place, mixes it with a bigram and a unigram distribution, so
every score is a true log probability.

Counts cover all training texts. The weights are trained by expectation maximisation over all ids of all training
texts, in the windows in which they are scored: a pass adds up what each weight was expected to give and what it gave
(sums of fixed size, so they don't depend on how the texts are dealt), and each weight grows by the ratio of the two.
A training token's own pair is taken out of the bigram counts while it trains the gates.

Scoring cuts a text into blocks; a window is a block and the one before it, so windows overlap, every token is scored
once, in the later half of a window, and a batch of windows is a few masked array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textaxis.llm.frequent import most_frequent
from textaxis.llm.packing import _encoder
from textaxis.llm.terms import SLICE_BYTES, coded_terms
from textaxis.llm.words import LOWER, SPACES, slices, text_buffer
from textaxis.session import materialize, release, scratch

BLOCK = 32
#: Ids with a bigram row, a key and a gate of their own; all others share the last. Sets the size of the model.
CLASSES = 2048
#: Words whose counts every task gets; all other words meet their counts in a join.
HEAD = 1 << 16
#: Passes of training over all training texts.
PASSES = 1
#: Weights before training of an equal id, and of an equal id after an equal one.
EQUAL, EQUAL_PAIR = 25.0, 170.0
#: What a class needs to be seen of before its own figures outweigh those of all classes.
PRIOR = 20.0
_SMOOTH = 8.0
#: Windows that are worked on at a time.
WINDOWS = 256

#: Cells of a window: lines (places that ask) and the columns (places before) that each sees; each line's first cell, and the
#: cell one and two places back on both.
_LINE = np.repeat(np.arange(BLOCK + 2, dtype=np.int32), np.arange(BLOCK - 1, 2 * BLOCK + 1))
_FIRST = np.searchsorted(_LINE, np.arange(BLOCK + 2))
_COLUMN = (np.arange(len(_LINE)) - _FIRST[_LINE]).astype(np.int32)
_BACK = [np.where((_LINE >= k) & (_COLUMN >= k), _FIRST[_LINE - k] + _COLUMN - k, 0).astype(np.int32) for k in (1, 2)]

_COUNTS = pa.schema([("kind", pa.int8()), ("word", pa.binary()), ("id", pa.int64()), ("n", pa.int64())])


def _lower(texts: pa.Array) -> pa.Array:
    """A-Z as a-z; null counts as empty."""
    buf, offsets = text_buffer(texts)
    part = LOWER[buf[offsets[0]:offsets[-1]]]
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(part)])


def _counted(kind: int, words: pa.Array | None, ids, n) -> pa.RecordBatch:
    size = len(n)
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int8)), pa.nulls(size, pa.binary()) if words is None else _binary(words),
                                       pa.nulls(size, pa.int64()) if ids is None else pa.array(ids, pa.int64()), pa.array(n, pa.int64())], schema=_COUNTS)


def _binary(words: pa.Array) -> pa.Array:
    return words.cast(pa.large_binary()).cast(pa.binary())


def _parts(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes of ids."""
    lo, sizes = 0, pc.binary_length(batch.column("ids")).to_pylist()
    while lo < len(batch):
        hi, size = lo, 0
        while hi < len(batch) and size < most:
            size += sizes[hi]
            hi += 1
        yield lo, hi
        lo = hi


def _code(path: str):
    """Each text with its subword ids; the end is an id after the vocabulary's, left to the readers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for lo, hi in slices(text_buffer(batch.column("text"))[1], SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                ids = encoder.encode_column(_lower(part.column("text")))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "held_out", "text")), pa.array(ids, pa.binary())], names=["doc_id", "held_out", "text", "ids"])

    return run


def _ids(column: pa.Array, kind: str, end: int) -> list[np.ndarray]:
    """Subword ids of texts, each with the end."""
    return [np.append(np.frombuffer(x.as_buffer(), kind).astype(np.int32), np.int32(end)) for x in column]


def _count(kind: str, end: int):
    """Counts of words (kind 0), of subword ids (kind 1), and of texts (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = np.zeros(end + 1, np.int64)
        texts = 0
        for batch in batches:
            texts += len(batch)
            for _, _, _, code, dictionary in coded_terms(batch, SPACES):
                yield _counted(0, dictionary, None, np.bincount(code, minlength=len(dictionary)))
            for lo, hi in _parts(batch):
                units += np.bincount(np.concatenate(_ids(batch.column("ids").slice(lo, hi - lo), kind, end)), minlength=end + 1)
        at = np.flatnonzero(units)
        yield _counted(1, None, at, units[at])
        yield _counted(2, None, [0], [texts])

    return run


def _pairs(kind: str, end: int, classes: np.ndarray):
    """Counts of class pairs, id = left * CLASSES + right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for lo, hi in _parts(batch, 1 << 22):
                codes = []
                for x in _ids(batch.column("ids").slice(lo, hi - lo), kind, end):
                    c = classes[x].astype(np.int64)
                    codes.append(np.append(c[-1], c[:-1]) * CLASSES + c)
                pairs += np.bincount(np.concatenate(codes), minlength=len(pairs))
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(pairs[at])], names=["id", "n"])

    return run


class Model:
    """Counts and weights. ``classes`` maps ids to rows of the bigram table, to keys and to gates.

    Weights are factors: ``distance`` by distance, ``key`` by class, ``match`` by level (0: another id, 1: the same
    id, 2: the same after the same) and class of the last id, ``gate`` by class of the last id and best level found.
    """

    def __init__(self, units: np.ndarray, pairs: np.ndarray, classes: np.ndarray):
        n, v = units.sum(), len(units)
        self.end = v - 1
        unigram = (units + 0.5) / (n + 0.5 * v)
        share = np.bincount(classes, unigram, CLASSES)
        rows = pairs.sum(axis=1, keepdims=True)
        self.unigram, self.inside = unigram.astype(np.float32), (unigram / share[classes]).astype(np.float32)
        self.share, self.rows = share.astype(np.float32), (rows[:, 0] + _SMOOTH).astype(np.float32)
        self.bigram = ((pairs + _SMOOTH * share[None, :]) / (rows + _SMOOTH)).astype(np.float32)
        self.classes = np.append(classes, 0).astype(np.int32)  # no id: -1
        gate = np.empty((CLASSES, 3, 3), np.float32)
        gate[:] = [[0.1, 0.85, 0.05], [0.1, 0.8, 0.1], [0.05, 0.45, 0.5]]
        self.weights = {
            "distance": np.ones(2 * BLOCK, np.float32), "key": np.ones(CLASSES, np.float32),
            "match": np.repeat(np.float32([[1.0], [EQUAL], [EQUAL_PAIR]]), CLASSES, axis=1), "gate": gate.reshape(-1, 3),
        }

    def forward(self, x: np.ndarray, grown: dict[str, np.ndarray] | None = None) -> np.ndarray:
        """Log10 probability of each target of windows ``x``, 2 * BLOCK + 1 ids each (-1: none), 0 where there is none.

        The last BLOCK ids are targets; place j has the key x[j] and the value x[j + 1], and the target at x[p + 1] is
        asked for by x[p] and sees the places before p. With ``grown`` the sums of a training pass are added to it.
        """
        w, size = self.weights, len(x)
        none, i32, f32 = x < 0, np.int32, np.float32
        small = np.uint16 if self.end < (1 << 16) - 2 else np.uint32
        keys = x.T.astype(small, order="C")  # -1 becomes the largest value; a query without id gets the next one
        asks = np.where(none.T[BLOCK - 1:], small(np.iinfo(small).max - 1), keys[BLOCK - 1:])
        flat = np.empty((len(_LINE), size), bool)  # by cell (a line and a column that it sees) and window
        for ask, lo in zip(asks, _FIRST.tolist(), strict=True):
            seen = BLOCK - 1 + int(_LINE[lo])
            np.equal(keys[:seen], ask, out=flat[lo:lo + seen])
        flat = flat.ravel()
        f = np.flatnonzero(flat).astype(i32)  # pairs of equal ids, few of all
        cell = f // i32(size)
        window, line, column = f - cell * i32(size), _LINE.take(cell), _COLUMN.take(cell)
        before = flat.take(_BACK[0].take(cell) * i32(size) + window) & (column > 0) & (line > 0)

        cls = self.classes[x[:, :-1]]
        held = w["key"][cls] * ~(none[:, :-1] | none[:, 1:])
        held_flat, cls_flat = held.ravel(), cls.ravel()
        apart = np.arange(BLOCK, 2 * BLOCK)[None, :] - np.arange(2 * BLOCK)[:, None]
        causal = apart > 0
        apart = np.where(causal, apart, 0)
        near = np.where(causal, w["distance"][apart], f32(0))
        last, target = cls[:, BLOCK:].ravel(), x[:, BLOCK + 1:].ravel()
        real = target >= 0
        target = np.where(real, target, 0)
        match, distance = w["match"].ravel(), w["distance"]

        # Places whose key is the asking id.
        at = np.flatnonzero((line >= 1) & (line <= BLOCK) & (column < 2 * BLOCK))
        q, j = (window * i32(BLOCK) + line - i32(1)).take(at), (window * i32(2 * BLOCK) + column).take(at)
        pair, d = before.take(at), (line + i32(BLOCK - 1) - column).take(at)
        plain = held_flat.take(j) * distance.take(d)
        q_class = last.take(q) + np.where(pair, i32(2 * CLASSES), i32(CLASSES))
        more = plain * (match.take(q_class) - f32(1))
        total = (held @ near).ravel() + np.bincount(q, more, size * BLOCK).astype(f32)
        level = np.zeros(size * BLOCK, i32)
        level[q] = 1
        level[q[pair]] = 2
        # Places whose value is the target.
        at = np.flatnonzero((line >= 2) & (column >= 1))
        t, k = (window * i32(BLOCK) + line - i32(2)).take(at), (window * i32(2 * BLOCK) + column - i32(1)).take(at)
        one = before.take(at)
        two = one & flat.take(_BACK[1].take(cell.take(at)) * i32(size) + window.take(at)) & (column.take(at) > 1)
        e = (line + i32(BLOCK - 1) - column).take(at)
        t_class = last.take(t) + (one.astype(i32) + two) * i32(CLASSES)
        given = held_flat.take(k) * distance.take(e) * match.take(t_class)
        copied = np.bincount(t, given, size * BLOCK).astype(f32)

        uni, to = self.unigram.take(target), self.classes.take(target)
        bi = self.bigram.ravel().take(last * i32(CLASSES) + to)
        if grown is not None:
            rows = self.rows.take(last)
            bi = np.maximum(bi * rows - f32(1), f32(_SMOOTH) * self.share.take(to)) / np.maximum(rows - f32(1), f32(_SMOOTH))
        bi = bi * self.inside.take(target)
        seen = total > 1e-20
        att = np.where(seen, copied / np.maximum(total, f32(1e-20)), bi)
        gated = last * i32(3) + level
        mixed = [g.take(gated) * v for g, v in zip(w["gate"].T.copy(), (uni, bi, att), strict=True)]
        p = np.maximum(mixed[0] + mixed[1] + mixed[2], f32(1e-30))
        if grown is not None:
            for c, m in enumerate(mixed):
                m *= real / p
                grown["gate"][:, c] += np.bincount(gated, m, 3 * CLASSES)
            rate = np.where(seen, mixed[2] / np.maximum(total, f32(1e-20)), f32(0))
            rates = rate.reshape(size, BLOCK)
            extra, got = rate.take(q) * more, (mixed[2] / np.maximum(copied, f32(1e-30))).take(t) * given
            grown["distance"] += np.bincount(d, extra, 2 * BLOCK)
            grown["distance"] += np.bincount(apart.ravel(), np.where(causal, (held.T @ rates) * near, 0).ravel(), 2 * BLOCK)
            grown["key"] += np.bincount(cls_flat, (held * (rates @ near.T)).ravel(), CLASSES) + np.bincount(cls_flat.take(j), extra, CLASSES)
            grown["match"] += np.bincount(q_class, extra + rate.take(q) * plain, 3 * CLASSES)
            grown["distance_got"] += np.bincount(e, got, 2 * BLOCK)
            grown["key_got"] += np.bincount(cls_flat.take(k), got, CLASSES)
            grown["match_got"] += np.bincount(t_class, got, 3 * CLASSES)
        return np.where(real, np.log10(p), f32(0)).reshape(size, BLOCK)

    @staticmethod
    def sums() -> dict[str, np.ndarray]:
        """The sums of a training pass before it: what the weights were expected to give, and what they gave."""
        sizes = {"distance": 2 * BLOCK, "key": CLASSES, "match": 3 * CLASSES}
        return {"gate": np.zeros((3 * CLASSES, 3))} | {n + tail: np.zeros(k) for n, k in sizes.items() for tail in ("", "_got")}

    def learn(self, grown: dict[str, np.ndarray]) -> None:
        """The weights after a training pass over all texts."""
        w = self.weights
        gate = grown["gate"].reshape(CLASSES, 3, 3)
        whole = gate.sum(axis=0) + 1e-6
        whole /= whole.sum(axis=1, keepdims=True)
        w["gate"] = ((gate + PRIOR * whole) / (gate.sum(axis=2, keepdims=True) + PRIOR)).reshape(-1, 3).astype(np.float32)
        for n in ("distance", "key"):
            w[n] = (w[n] * ((grown[n + "_got"] + 5) / (grown[n] + 5)) ** 0.7).astype(np.float32)
        had, got = grown["match"].reshape(3, -1), grown["match_got"].reshape(3, -1)
        ratio = (got.sum(axis=1) + 5) / (had.sum(axis=1) + 5)
        w["match"][1:] *= ((got + PRIOR * ratio[:, None]) / (had + PRIOR))[1:].astype(np.float32)

    def windows(self, texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Batches of windows over texts (ids with an end), with the number of each one's text.

        A block of nothing is before each text, and the end as the id before its first.
        """
        blocks = np.array([-(-len(x) // BLOCK) for x in texts])
        begin = np.cumsum(blocks + 1) * BLOCK - blocks * BLOCK + 1
        flat = np.full(int((blocks.sum() + len(texts)) * BLOCK) + 1, -1, np.int32)
        for x, b in zip(texts, begin.tolist(), strict=True):
            flat[b:b + len(x)] = x
        flat[begin - 1] = self.end
        text = np.repeat(np.arange(len(texts)), blocks)
        start = np.repeat(begin, blocks) + BLOCK * (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks) - 1) - 1
        for at in range(0, len(start), WINDOWS):
            yield flat[start[at:at + WINDOWS, None] + np.arange(2 * BLOCK + 1)], text[at:at + WINDOWS]

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Log10 probability of each text, given as ids with an end."""
        out = np.zeros(len(texts))
        for x, text in self.windows(texts):
            out += np.bincount(text, self.forward(x).sum(axis=1, dtype=np.float64), len(texts))
        return out

    def train(self, texts: list[np.ndarray], grown: dict[str, np.ndarray]) -> None:
        """Add the sums of these texts to those of a training pass."""
        for x, _ in self.windows(texts):
            self.forward(x, grown)


def _expected(kind: str, shared):
    """The sums of a training pass over a task's texts, as (place, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        grown = model.sums()
        for batch in batches:
            for lo, hi in _parts(batch):
                model.train(_ids(batch.column("ids").slice(lo, hi - lo), kind, model.end), grown)
        flat = np.concatenate([g.ravel() for g in grown.values()])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["id", "v"])

    return run


def _scores(kind: str, shared, head):
    names = ["doc_id", "held_out", "n_tokens", "n_head", "head_score", "score", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (often, logs, end) = shared.value, head.value
        often, logs = pa.array(often, pa.large_binary()), np.append(logs, 1.0)  # logarithms are below 0
        for batch in batches:
            for lo, hi, row, code, dictionary in coded_terms(batch, SPACES):
                part, size = batch.slice(lo, hi - lo), hi - lo
                place = pc.index_in(dictionary.cast(pa.large_binary()), value_set=often).fill_null(len(often)).to_numpy(zero_copy_only=False)
                got = logs[place][code]
                other = np.flatnonzero(got > 0)
                got[other] = 0
                n, rest = np.bincount(row, minlength=size), np.bincount(row[other], minlength=size)
                starts = pa.array(np.append(0, np.cumsum(rest)), pa.int32())
                score = np.concatenate([model.score(_ids(part.column("ids").slice(a, b - a), kind, model.end)) for a, b in _parts(part)])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("held_out"), pa.array(n + 1), pa.array(n - rest + (end[1] > 0)),
                    pa.array(np.bincount(row, got, size) + end[0]), pa.array(score), pa.ListArray.from_arrays(starts, _binary(dictionary.take(pa.array(code[other]))))], names=names)

    return run


def score_texts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts whose ``crc32(doc_id as text) mod 5`` is 1 are held out; all others train. ``base_score`` is the add-half
    unigram score over words and one end, with counts of all training texts; ``score`` is the model's log10
    probability of the whole text's subword ids and end. ``vocabulary`` is the path of a byte-level ``tokenizers``
    file, the same on every executor. A null text counts as empty; a row without doc_id trains; repeated rows train
    and are scored as often as they stand there. Without training texts both models are flat; an empty table gives no
    row; texts of any length are trained on and scored whole. Other columns are ignored. Broadcast: at most ``HEAD``
    words with their counts (other words meet theirs in a join), and the model, whose size is set by the vocabulary
    and ``CLASSES``.
    """
    spark = docs.sparkSession
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), out.alias("held_out"))
    encoder = _encoder(vocabulary)
    kind, end = encoder.kind.str, encoder.tokenizer.get_vocab_size()
    with scratch(spark) as keep:
        coded = materialize(docs.mapInArrow(_code(vocabulary), "doc_id long, held_out boolean, text string, ids binary"), "coded", "zstd")
        train = coded.where("not held_out")
        found = materialize(
            train.select("text", "ids").mapInArrow(_count(kind, end), "kind byte, word binary, id long, n long")
            .groupBy("kind", "word", "id").agg(F.sum("n").alias("n")), "counts")
        units = np.zeros(end + 1, np.int64)
        for r in found.where("kind = 1").select("id", "n").collect():  # at most the vocabulary
            units[r["id"]] = r["n"]
        words = found.where("kind = 0")
        texts = found.where("kind = 2").agg(F.sum("n")).first()[0] or 0
        seen = words.agg(F.sum("n"), F.count("*")).first()
        tokens, distinct = (seen[0] or 0) + texts, seen[1] + (texts > 0)
        scale = tokens + 0.5 * (distinct + 1)
        often = most_frequent(words, "word", "n", HEAD)
        log = np.log10((often["n"].to_numpy(np.float64) + 0.5) / scale)
        head = (list(map(bytes, often["word"])), log, (float(np.log10((texts + 0.5) / scale)), texts))

        model = trained(train.select("ids"), units, kind, PASSES if texts else 0)
        shape = "doc_id long, held_out boolean, n_tokens long, n_head long, head_score double, score double, rest array<binary>"
        scored = coded.mapInArrow(_scores(kind, spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(head)), shape)
        scored = materialize(scored.withColumn("rid", F.monotonically_increasing_id()), "scores", "zstd")
        release(coded)
        tail = scored.select("rid", F.explode("rest").alias("word"))
        logs = F.log10((F.coalesce("n", F.lit(0)) + F.lit(0.5)) / F.lit(float(scale)))
        tail = (
            tail.join(words.select("word", "n"), "word", "left").groupBy("rid")
            .agg(F.sum(logs).alias("tail_score"), F.count_if(F.col("n") > 0).alias("n_tail"))
        )
        return keep(materialize(scored.join(tail, "rid", "left").select(
            "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
            (F.col("head_score") + F.coalesce("tail_score", F.lit(0.0))).alias("base_score"), "score"), "scored"))


def trained(train: DataFrame, units: np.ndarray, kind: str, passes: int = PASSES) -> Model:
    """A model of the texts of ``train`` (ids), whose ids have the counts ``units``.

    Each pass reads all texts and sends sums of fixed size: at most CLASSES squared pairs, then the weights' sums.
    """
    spark = train.sparkSession
    end = len(units) - 1
    classes = np.full(len(units), CLASSES - 1, np.int32)
    top = np.argsort(-units, kind="stable")[:CLASSES - 1]
    classes[top] = np.arange(len(top))
    pairs = np.zeros(CLASSES * CLASSES, np.int64)
    counted = train.mapInArrow(_pairs(kind, end, classes), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    pairs[counted["id"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    model = Model(units, pairs.reshape(CLASSES, CLASSES), classes)
    for _ in range(passes):
        sums = train.mapInArrow(_expected(kind, spark.sparkContext.broadcast(model)), "id long, v double").groupBy("id").agg(F.sum("v").alias("v")).toPandas()
        grown = model.sums()
        flat = np.zeros(sum(g.size for g in grown.values()))
        flat[sums["id"].to_numpy(np.int64)] = sums["v"].to_numpy(np.float64)
        cuts = np.cumsum([g.size for g in grown.values()])[:-1]
        model.learn({n: part.reshape(g.shape) for (n, g), part in zip(grown.items(), np.split(flat, cuts), strict=True)})
    return model
