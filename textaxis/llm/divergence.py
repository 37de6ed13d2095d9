"""Divergence of sources within a language: each source's term shares against every other source's and the whole.

Terms of a language are numbered within slabs, and sources are dealt over ``SEATS`` seats. A cell holds one seat's
sources on one slab, as sorted sparse vectors. Cells stay where they are (one partitioning for all rounds), while
compressed cells of the peers circulate as in a round-robin tournament: in each round every seat meets one other, and
after ``SEATS - 1`` rounds all have met. A meeting is evaluated once and gives both directions. Only partial sums of a
meeting leave it. What a round sends is half of all vectors, whatever the number of sources.

Shares are whole numbers, from exact division in 64 bits (in three digits of a thousand, so that counts aren't limited
to what a product with 10**9 leaves).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textaxis.llm.terms import NOT_ALPHA, coded_terms, counted
from textaxis.session import materialize, release, scratch

SEATS = 8
#: Slabs of a language at least, and the entries that a cell should hold.
SLABS, CELL_ENTRIES = 16, 1 << 16
#: Counts that a task gathers before it adds them up, and after that sends; text bytes that it works on at a time.
GATHERED, SLICE_BYTES = 1 << 18, 2 << 20
TOP = 50

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_CELLS = pa.schema([("lang", pa.string()), ("seat", pa.int32()), ("slab", pa.int64()), ("cell", pa.binary()),
                    ("source", pa.string()), ("term", pa.string()), ("value", pa.int64())])
_SUMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def shares(count: np.ndarray, total: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """``1 + floor(10**9 * (count + 5) / (total + 5 * kept))``; totals stay under 9 * 10**15."""
    whole = total + 5 * kept
    out, rest = np.divmod(count + 5, whole)
    for _ in range(3):
        digit, rest = np.divmod(1000 * rest, whole)
        out = 1000 * out + digit
    return 1 + out


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term) of a stretch of rows; a null term counts none and keeps the group."""
    held: list[pa.Table] = []
    rows = 0

    def added() -> pa.Table:
        got = pa.concat_tables(held).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return got.rename_columns(_COUNTS.names).cast(_COUNTS)

    for batch in batches:
        names = [batch.column(c).fill_null("").cast(pa.string()).dictionary_encode() for c in ("lang", "source")]
        lang, source = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in names)
        group = lang * len(names[1].dictionary) + source
        for lo, hi, row, code, dictionary in coded_terms(batch, NOT_ALPHA, most=SLICE_BYTES):
            wide = max(1, len(dictionary))
            in_doc, times = counted(row * wide + code)
            key = group[lo + in_doc // wide] * wide + in_doc % wide
            order = np.argsort(key, kind="stable")
            key, times = key[order], times[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
            n = np.add.reduceat(times, first) if len(first) else times
            documents = np.diff(np.r_[first, len(key)])
            seen = np.unique(group[lo:hi])
            g = np.r_[key[first] // wide, seen]
            terms = pa.concat_arrays([dictionary.take(pa.array(key[first] % wide)).cast(pa.string()), pa.nulls(len(seen), pa.string())])
            zero = np.zeros(len(seen), np.int64)
            held.append(pa.Table.from_arrays([
                names[0].dictionary.take(pa.array(g // len(names[1].dictionary))), names[1].dictionary.take(pa.array(g % len(names[1].dictionary))), terms,
                pa.array(np.r_[n, zero]), pa.array(np.r_[documents, zero])], schema=_COUNTS))
            rows += len(g)
            if rows > GATHERED:
                held[:] = [added()]
                rows = len(held[0])
                if rows > GATHERED // 2:
                    yield from held.pop().to_batches(max_chunksize=50_000)
                    rows = 0
    if held:
        yield from added().to_batches(max_chunksize=50_000)


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``; each group also has a row of a null term."""
    text = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = text.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class Cell:
    """A seat's sources on one slab: names, totals, the numbers of terms, and sparse shares sorted by (source, term)."""

    def __init__(self, names: list[str], totals: np.ndarray, kept: int, width: int, source: np.ndarray, term: np.ndarray, n: np.ndarray):
        self.names, self.width = names, width
        self.source, self.term = source, term
        self.p = shares(n, totals[source], kept)
        self.zero = shares(np.zeros(len(names), np.int64), totals, kept) if kept else np.zeros(len(names), np.int64)
        self.cuts = np.searchsorted(source, np.arange(len(names) + 1))

    def apart(self, peer: Cell, j: int) -> np.ndarray:
        """The sum of absolute differences of each source here from source ``j`` of ``peer``, over all terms of the slab."""
        a, b = peer.cuts[j], peer.cuts[j + 1]
        other = np.full(self.width, peer.zero[j])
        other[peer.term[a:b]] = peer.p[a:b]
        # First as if no source here had a term: the differences of its share of absent terms from all of the peer's.
        s = np.sort(peer.p[a:b])
        sums = np.r_[0, np.cumsum(s)]
        k = np.searchsorted(s, self.zero)
        out = self.zero * k - sums[k] + (sums[-1] - sums[k]) - self.zero * (len(s) - k) + (self.width - len(s)) * np.abs(self.zero - peer.zero[j])
        # Then the terms that it has.
        met = other[self.term]
        change = np.r_[0, np.cumsum(np.abs(self.p - met) - np.abs(self.zero[self.source] - met))]
        return out + change[self.cuts[1:]] - change[self.cuts[:-1]]


def _packed(names: list[str], totals: np.ndarray, kept: int, width: int, source: np.ndarray, term: np.ndarray, n: np.ndarray) -> bytes:
    """Compressed: term numbers as steps within a source, counts in the fewest bytes that hold them all."""
    step = np.diff(term, prepend=0)
    step[np.r_[True, source[1:] != source[:-1]][:len(term)]] = term[np.r_[True, source[1:] != source[:-1]][:len(term)]]
    kinds = [np.min_scalar_type(int(x.max()) if len(x) else 0) for x in (source, step, n)]
    body = b"".join(x.astype(k).tobytes() for x, k in zip((source, step, n), kinds, strict=True))
    texts = [x.encode() for x in names]
    head = np.array([len(names), kept, width, len(term), len(body), *[k.itemsize for k in kinds]], np.int64).tobytes()
    head += totals.astype(np.int64).tobytes() + np.array([len(t) for t in texts], np.int64).tobytes() + b"".join(texts)
    return len(head).to_bytes(8, "little") + head + pa.compress(body, "zstd", asbytes=True) if body else len(head).to_bytes(8, "little") + head


def _unpacked(raw: bytes) -> Cell:
    end = 8 + int.from_bytes(raw[:8], "little")
    many, kept, width, entries, size, *kinds = np.frombuffer(raw, np.int64, 8, 8).tolist()
    totals, lens = np.frombuffer(raw, np.int64, many, 72), np.frombuffer(raw, np.int64, many, 72 + 8 * many)
    at = np.r_[0, np.cumsum(lens)] + 72 + 16 * many
    names = [raw[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    body = pa.decompress(raw[end:], size, "zstd", asbytes=True) if size else b""
    cols, place = [], 0
    for k in kinds:
        cols.append(np.frombuffer(body, f"u{k}", entries, place).astype(np.int64))
        place += entries * k
    source, step, n = cols
    run = np.cumsum(step)
    first = np.flatnonzero(np.r_[True, source[1:] != source[:-1]][:entries])
    before = run[first] - step[first]
    term = run - np.repeat(before, np.diff(np.r_[first, entries])) if entries else run
    return Cell(names, totals, kept, width, source, term, n)


def _cells(key, table):
    """One seat's sources on one slab: the cell, and each source's ``TOP`` terms over the language, by a heap of its own.

    Rows without a term name a source and its total; the others are its terms, with the language's counts of them.
    """
    lang, seat, slab = (x.as_py() for x in key)
    place = np.asarray(table.column("place").combine_chunks().is_null())
    heads, rows = table.filter(pa.array(place)), table.filter(pa.array(~place)).sort_by([("source", "ascending"), ("place", "ascending")])
    heads = heads.sort_by("source")
    names = heads.column("source").to_pylist()
    at = {s: i for i, s in enumerate(names)}
    totals = heads.column("total").to_numpy()
    kept, width, whole = (heads.column(c)[0].as_py() for c in ("kept", "width", "lang_total"))
    source = np.array([at[s] for s in rows.column("source").to_pylist()], np.int64)
    order = np.argsort(source, kind="stable")
    source, term, n, of_all = source[order], *(rows.column(c).to_numpy()[order] for c in ("place", "n", "lang_n"))
    out: list[list] = [[_packed(names, totals, kept, width, source, term, n)], [None], [None], [None]]
    if len(term):
        above = shares(n, totals[source], kept) - shares(of_all, np.full(len(of_all), whole), kept)
        words = rows.column("term").combine_chunks()
        for i, (a, b) in enumerate(zip(*(lambda c: (c[:-1], c[1:]))(np.searchsorted(source, np.arange(len(names) + 1)).tolist()), strict=True)):
            best = a + np.lexsort((term[a:b], -above[a:b]))[:TOP]
            best = best[above[best] > 0]
            out[0] += [None] * len(best)
            out[1] += [names[i]] * len(best)
            out[2] += words.take(pa.array(order[best])).to_pylist()
            out[3] += above[best].tolist()
    n = len(out[0])
    return pa.Table.from_arrays([pa.array([lang] * n, pa.string()), pa.array([seat] * n, pa.int32()), pa.array([slab] * n, pa.int64()),
                                 *[pa.array(c, f.type) for c, f in zip(out, list(_CELLS)[3:], strict=True)]], schema=_CELLS)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of both directions of each meeting; a cell that meets itself gives each pair of its sources."""
    for batch in batches:
        for lang, here, there in zip(*(batch.column(c) for c in ("lang", "cell", "peer")), strict=True):
            a, home = _unpacked(here.as_py()), there.as_py() is None
            b = a if home else _unpacked(there.as_py())
            rows: list[tuple[str, str, int]] = []
            for j, name in enumerate(b.names):
                first = j + 1 if home else 0
                for mine, value in zip(a.names[first:], a.apart(b, j)[first:].tolist(), strict=True):
                    rows += ((mine, name, value), (name, mine, value))
            x, y, v = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(v), pa.string()), pa.array(x, pa.string()), pa.array(y, pa.string()), pa.array(v, pa.int64())], schema=_SUMS)


def opponents(turn: int, seats: int = SEATS) -> list[tuple[int, int]]:
    """The meetings of one round as (guest, host): seats on a circle that turns by one, around the last."""
    circle = seats - 1
    pairs = [(turn % circle, circle)] + [((turn + k) % circle, (turn - k) % circle) for k in range(1, seats // 2)]
    return [(min(p), max(p)) for p in pairs]


def source_divergence(docs: DataFrame, least_docs: int = 30) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of each (lang, source) group of ``docs`` (text, lang, source; others are ignored).

    Terms are runs of letters and non-ASCII characters, A-Z as a-z. A language keeps the terms of at least ``least_docs`` of
    its rows; p is a kept term's smoothed share (``shares``) in a group or in the language. Part ``pair``: each other source of the
    language with the sum of ``abs(p - q)`` over all kept terms. Part ``term``: the group's terms with p over the
    language's q, by ``p - q``, ranks 1 to 50. Ties go by item, as UTF-8 bytes. Nulls count as empty strings; a group
    without text or kept terms has count 0 throughout; repeated rows count as often as they occur; texts of any length are taken whole. A
    language with one source has no pairs. An empty table gives no rows.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        counts = materialize(term_counts(docs), "termcounts")
        terms = counts.where("term is not null")
        whole = terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.count("*").alias("sources")).where(F.col("docs") >= least_docs)
        whole = materialize(whole.drop("docs"), "keptterms")
        groups = counts.where("term is null").select("lang", "source")
        langs = groups.select("lang").distinct().join(
            whole.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"), F.sum("sources").alias("entries")), "lang", "left"
        ).select("lang", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("kept", "lang_total")], (SLABS + F.floor(F.coalesce("entries", F.lit(0)) / (SEATS * CELL_ENTRIES))).alias("slabs"))
        langs = materialize(langs, "langs")
        placed = whole.join(langs.select("lang", "slabs"), "lang").select("lang", "term", "lang_n", F.pmod(F.xxhash64("term"), "slabs").alias("slab"))
        number = F.row_number().over(Window.partitionBy("lang", "slab").orderBy("term")) - 1  # a slab is of bounded size
        placed = materialize(placed.withColumn("place", number.cast("long")), "slabs")
        entries = materialize(terms.select("lang", "source", "term", "n").join(placed, ["lang", "term"]), "entries")
        totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        seat = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) % SEATS  # one row for each source
        groups = groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), seat.cast("int").alias("seat"))
        groups = materialize(groups, "groups")
        widths = placed.groupBy("lang", "slab").agg(F.count("*").alias("width"))
        heads = groups.join(langs, "lang").withColumn("slab", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slabs") - 1)))
        heads = heads.join(widths, ["lang", "slab"], "left").select(
            "lang", "seat", "slab", "source", "total", "kept", F.coalesce("width", F.lit(0)).alias("width"), "lang_total",
            F.lit(None).cast("string").alias("term"), *[F.lit(None).cast("long").alias(c) for c in ("place", "n", "lang_n")])
        rows = entries.join(groups.select("lang", "source", "seat"), ["lang", "source"]).select(
            "lang", "seat", "slab", "source", *[F.lit(None).cast("long").alias(c) for c in ("total", "kept", "width", "lang_total")], "term", "place", "n", "lang_n")
        shape = "lang string, seat int, slab long, cell binary, source string, term string, value long"
        cells = materialize(heads.unionByName(rows).groupBy("lang", "seat", "slab").applyInArrow(_cells, shape), "cells")
        release(entries, placed, whole)

        found = cells.where("cell is null").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
        by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        found = found.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= TOP)
        return keep(materialize(_tournament(cells).withColumn("rank", F.row_number().over(by_value)).unionByName(found), "divergence"))


def _tournament(cells: DataFrame) -> DataFrame:
    """``(lang, source, part, item, value)`` of all pairs of sources of a language."""
    spark = cells.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vectors = cells.where("cell is not null").select("lang", "seat", "slab", "cell")
    home = vectors.repartition(partitions, "lang", "seat", "slab").persist(StorageLevel.MEMORY_AND_DISK)
    shape = "lang string, source string, item string, value long"
    rounds = [materialize(home.select("lang", "cell", F.lit(None).cast("binary").alias("peer")).mapInArrow(_meet, shape), "round")]
    for turn in range(SEATS - 1):
        host = reduce(lambda c, p: c.when(F.col("seat") == p[0], F.lit(p[1])), opponents(turn), F.when(F.lit(False), F.lit(0)))
        guests = vectors.select("lang", host.alias("seat"), "slab", F.col("cell").alias("peer")).where("seat is not null")
        met = home.join(guests.repartition(partitions, "lang", "seat", "slab"), ["lang", "seat", "slab"])
        rounds.append(materialize(met.select("lang", "cell", "peer").mapInArrow(_meet, shape), "round"))
    home.unpersist()
    sums = reduce(DataFrame.unionByName, rounds).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
