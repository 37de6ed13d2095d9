"""Substring deduplication by relative Lempel-Ziv parsing against content-defined reference blocks.

A text is cut into overlapping blocks that depend on content alone: of each window of ``window`` words the anchor is
the word run of ``anchor`` words with the least hash, and the windows with one anchor make a block (at most
``2 * window - anchor`` words). The index has every distinct block with its reference, the first place in the smallest
document that holds it. A document's blocks that stand in the index under an earlier document are copies of their
references; copies that go on in the reference as they do in the document are one factor, without looking at any word
again. The document is then parsed greedily: from each place on, the factor that reaches furthest is taken.

At factor boundaries, blocks whose anchor is shared while the block is not, the single windows are compared, and only
for one document per distinct block, at every place where that document holds it. As equal windows have equal anchors
at equal places, factors and boundaries together cover exactly the windows that also start in an earlier document.

All matching is aggregation by hash (128 bits together), partial before each shuffle: a passage in a third of all
documents is one reference with many copies, never a list of pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textaxis.llm.words import Ranges, give_back, lean, mix, sliding_min, word_slices
from textaxis.session import materialize, release, scratch

U = np.uint64
#: Words of a single text whose anchors are chosen at a time; bounds the bits for a place.
STRIDE = 1 << 22
#: Most ids of documents that are broadcast, so that only those documents' texts are shuffled; with more, all are.
BROADCAST_IDS = 1 << 20
_PLACE_BITS = U(24)

_BLOCKS = pa.schema([("anchor", pa.int64()), ("block", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()),
                     ("start", pa.int32()), ("stop", pa.int32())])
_WINDOWS = pa.schema([("anchor", pa.int64()), ("win", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("start", pa.int32())])


def _chosen(grams: np.ndarray, row: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows inside one text, and the first word of each one's anchor."""
    starts, picks = [], []
    width = window - anchor + 1
    for lo in range(0, max(1, len(row) - window + 1), STRIDE):
        part = grams[lo:lo + STRIDE + width - 1]
        key = (part >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(part), dtype=U)
        best = sliding_min(key, width)
        best = (best & ((U(1) << _PLACE_BITS) - U(1))).astype(np.int64) + lo
        s = np.arange(lo, lo + len(best))
        s = s[s + window <= len(row)]
        whole = row[s] == row[s + window - 1]
        starts.append(s[whole])
        picks.append(best[:len(s)][whole])
    return np.concatenate(starts), np.concatenate(picks)


def _hashed(h: np.ndarray, row: np.ndarray, s: np.ndarray, pick: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The first window of each block, as a place in ``s``, and the block's hash."""
    at = np.flatnonzero(np.r_[True, (pick[1:] != pick[:-1]) | (row[s[1:]] != row[s[:-1]])])
    a, b = s[at], s[np.r_[at[1:], len(s)] - 1] + window
    return at, Ranges(h, 1).of(a, b) + (pick[at] - a).astype(U)


def _blocks(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()
            for lo, hi, row, h in word_slices(batch, "text"):
                if len(h) < window:
                    continue
                grams = Ranges(h, 0).rolling(anchor)
                s, pick = _chosen(grams, row, window, anchor)
                if not len(s):
                    continue
                at, block = _hashed(h, row, s, pick, window)
                a, p = s[at], pick[at]
                b = s[np.r_[at[1:], len(s)] - 1] + window
                r = row[a]
                first = np.searchsorted(row, r, "left")
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                    grams[p].view(np.int64), block.view(np.int64), doc[lo:hi][r], tag[lo:hi][r],
                    (a - first).astype(np.int32), (b - first).astype(np.int32))], schema=_BLOCKS)

    return run


def _windows(window: int, anchor: int):
    """The windows of the asked blocks, at each of their places; ``asked`` has the hashes of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag, asked = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy(), batch.column("asked")
            for lo, hi, row, h in word_slices(batch, "text"):
                if len(h) < window:
                    continue
                grams = Ranges(h, 0).rolling(anchor)
                s, pick = _chosen(grams, row, window, anchor)
                if not len(s):
                    continue
                first = np.searchsorted(row, np.arange(hi - lo), "left")
                salt = mix(np.arange(hi - lo, dtype=U))
                wanted = np.concatenate([np.asarray(asked[lo + i].as_py(), np.int64).view(U) ^ salt[i] for i in range(hi - lo)])
                begin, block = _hashed(h, row, s, pick, window)
                take = np.repeat(np.isin(block ^ salt[row[s[begin]]], wanted), np.diff(np.r_[begin, len(s)]))
                s, pick = s[take], pick[take]
                wins = Ranges(h, 2).rolling(window)[s] + (pick - s).astype(U)
                r = row[s]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                    grams[pick].view(np.int64), wins.view(np.int64), doc[lo:hi][r], tag[lo:hi][r], (s - first[r]).astype(np.int32))], schema=_WINDOWS)

    return run


def parse(copies: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The greedy factors (start, length, ref_doc_id, ref_start) of a document from its copies (start, stop, ref_doc_id, ref_start).

    Copies that go on in their reference are one factor. Of the factors that begin at or before the next place, the
    one that reaches furthest is taken, of equal ones that with the smaller reference; it may overlap the one before.
    """
    whole: list[list[int]] = []
    for start, stop, ref, at in sorted(copies, key=lambda c: (c[2], c[3] - c[0], c[0])):
        last = whole[-1] if whole else None
        if last and last[2] == ref and last[3] - last[0] == at - start and start <= last[1]:
            last[1] = max(last[1], stop)
        else:
            whole.append([start, stop, ref, at])
    whole.sort(key=lambda f: (f[0], -f[1], f[2], f[3]))
    out: list[tuple[int, int, int, int]] = []
    place, i = 0, 0
    while i < len(whole):
        best = None
        while i < len(whole) and whole[i][0] <= place:
            if best is None or whole[i][1] > best[1]:
                best = whole[i]
            i += 1
        if best is not None and best[1] > place:
            out.append((best[0], best[1] - best[0], best[2], best[3]))
            place = best[1]
        elif i < len(whole):
            place = max(place, whole[i][0])
    return out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_doc_id", pa.int64()), ("ref_start", pa.int32())]))
    for batch in batches:
        copies = batch.column("copies")
        flat = copies.flatten()
        rows = list(zip(*(flat.field(c).to_pylist() for c in ("start", "stop", "ref", "ref_start")), strict=True))
        ends = np.cumsum(copies.value_lengths().to_numpy())
        factors = [[dict(zip(("start", "length", "ref_doc_id", "ref_start"), f, strict=True)) for f in parse(rows[a:b])]
                   for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(factors, kind)], names=["doc_id", "tag", "factors"])


def _merged(factors) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted((x["start"], x["start"] + x["length"]) for x in (() if factors is None else factors)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def parsed(docs: DataFrame, window: int = 50, anchor: int = 16) -> DataFrame:
    """``(doc_id, tag, factors)``: the factors of each text of ``docs`` (doc_id, text, tag) that repeats an earlier one.

    Factors are ``(start, length, ref_doc_id, ref_start)`` in words, in order, each at least ``window`` long; they
    cover each window of ``window`` words whose word sequence also starts in a document with a smaller doc_id, and
    nothing else. ``tag`` tells rows of one doc_id apart; of a repeated doc_id ``ref_start`` is in any of its texts
    that holds the words there.
    """
    with scratch(docs.sparkSession) as keep:
        shape = "anchor long, block long, doc_id long, tag long, start int, stop int"
        blocks = materialize(docs.select("doc_id", "tag", "text").mapInArrow(lean(_blocks(window, anchor)), shape), "blocks")
        first = F.min(F.struct("doc_id", "start"))
        index = blocks.groupBy("anchor", "block").agg(first.alias("f"), F.max("doc_id").alias("last"))
        index = materialize(index.select("anchor", "block", F.col("f.doc_id").alias("ref"), F.col("f.start").alias("ref_start"), "last"), "index")
        copied = index.where("last > ref").drop("last")
        whole = materialize(blocks.join(copied, ["anchor", "block"]).where("doc_id > ref").select("doc_id", "tag", "start", "stop", "ref", "ref_start"), "copies")
        release(blocks)

        shared = index.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
        asked = (
            index.join(shared, "anchor", "left_semi").select(F.col("ref").alias("doc_id"), "block")
            .groupBy("doc_id").agg(F.collect_set("block").alias("asked"))
        )
        asked = materialize(asked, "asked")
        release(index)
        texts = docs.select("doc_id", "tag", "text")
        if asked.count() <= BROADCAST_IDS:
            texts = texts.join(F.broadcast(asked.select("doc_id")), "doc_id", "left_semi")
        single = materialize(
            texts.join(asked, "doc_id").mapInArrow(lean(_windows(window, anchor)), "anchor long, win long, doc_id long, tag long, start int"), "windows")
        seen = single.groupBy("anchor", "win").agg(first.alias("f"), F.max("doc_id").alias("last")).where("last > f.doc_id")
        edge = (
            single.join(seen, ["anchor", "win"]).where("doc_id > f.doc_id")
            .select("doc_id", "tag", "start", (F.col("start") + window).alias("stop"), F.col("f.doc_id").alias("ref"), F.col("f.start").alias("ref_start"))
        )
        copies = whole.unionByName(edge).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "stop", "ref", "ref_start")).alias("copies"))
        shape = "doc_id long, tag long, factors array<struct<start int, length int, ref_doc_id long, ref_start int>>"
        return keep(materialize(copies.mapInArrow(lean(_parsed), shape), "factors"))


def factors(docs: DataFrame, window: int = 50, anchor: int = 16) -> DataFrame:
    """One row per factor of ``docs`` (doc_id, text): doc_id, start, length, ref_doc_id, ref_start, in words.

    Null texts and rows without doc_id have none; an empty table gives no row.
    """
    return parsed(_tagged(docs).where("doc_id is not null"), window, anchor).select("doc_id", F.inline("factors"))


def _cut(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, sha, texts = [], [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("factors").to_pylist(), strict=True):
                words = (text or "").encode().split()  # of bytes: white space is exactly 0x20 and 0x09 to 0x0D
                n.append(len(words))
                kept, at = [], 0
                for a, b in _merged(found):
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                gone.append(len(words) - len(kept))
                joined = b" ".join(kept)
                sha.append(hashlib.sha256(joined).hexdigest())
                texts.append((joined.decode() if gone[-1] else text) if keep_text else None)
            keys = [batch.column(c) for c in ("doc_id", "tag")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string())],
                                             names=["doc_id", "tag", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def _tagged(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(F.coalesce(text, F.lit(""))).alias("tag"), text.alias("text"))


def _placed(rows: DataFrame, found: DataFrame, tag: str) -> DataFrame:
    """``rows`` (doc_id, ``tag``, any other columns) with their ``__factors`` of ``found``, null without any.

    Texts of documents without factors, most of them as a rule, stay where they are.
    """
    found = found.select(F.col("doc_id").alias("__doc"), F.col("tag").alias("__t"), F.col("factors").alias("__factors"))
    ids, same = found.select("__doc").distinct(), F.col("doc_id") == F.col("__doc")
    few = ids.count() <= BROADCAST_IDS
    some = rows.join(F.broadcast(ids), same, "left_semi") if few else rows
    some = some.join(found, same & (F.col(tag) == F.col("__t")), "left").drop("__doc", "__t")
    if not few:
        return some
    rest = rows.join(F.broadcast(ids), same, "left_anti")
    return some.unionByName(rest.withColumn("__factors", F.lit(None).cast(found.schema["__factors"].dataType)))


def dedup_substrings(docs: DataFrame, window: int = 50, anchor: int = 16, keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_words, n_removed, kept_sha256, and ``kept`` if ``keep_text``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Each word covered by a window of ``window`` words that also starts in
    a document with a smaller doc_id goes; windows are judged on the input. ``kept`` is the kept words joined by one
    space, or the text itself where nothing goes. A null text has no words; a row without doc_id keeps all words and
    is no reference. Repeats inside one document stay, also over several rows of one doc_id; each repeated row gets a
    row. Texts of any length are read whole, in slices; an empty table gives no row; other columns are ignored.
    """
    tagged = _tagged(docs)
    found = parsed(tagged.where("doc_id is not null"), window, anchor)
    joined = _placed(tagged, found, "tag").select("doc_id", "tag", "text", F.col("__factors").alias("factors"))
    out = joined.mapInArrow(lean(_cut(keep_text)), "doc_id long, tag long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out if keep_text else out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def rewrite(docs: DataFrame, window: int = 50, anchor: int = 16) -> DataFrame:
    """``docs`` with each text's repeated spans removed, all columns kept (n_chars, where there is one, is renewed).

    A text of which nothing is left becomes empty; no row goes.
    """
    found = parsed(_tagged(docs).where("doc_id is not null"), window, anchor)
    names = docs.columns
    tagged = docs.withColumn("__tag", F.crc32(F.coalesce(F.col("text"), F.lit(""))))
    joined = _placed(tagged, found, "__tag")

    @F.pandas_udf("string")
    def cut(text, factors):
        out = []
        for t, s in zip(text, factors, strict=True):
            if s is None or t is None:
                out.append(t)
                continue
            words, kept, at = t.encode().split(), [], 0
            for a, b in _merged(s):
                kept += words[at:a]
                at = b
            out.append(b" ".join(kept + words[at:]).decode())
        give_back()
        return type(text)(out, dtype=object)

    cut_text = F.when(F.col("__factors").isNull(), F.col("text")).otherwise(cut("text", "__factors"))
    out = joined.withColumn("text", cut_text)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("__factors").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*names)
