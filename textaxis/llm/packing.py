"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens. A window of ``length`` tokens takes from each queue what its target share says,
plus the deficit carried over from earlier windows; shares default to what the corpus holds, so all queues end
together. A queue waits until it has earned a run of a sixteenth of a window (the quantum), so however many sources there
are, texts aren't shredded: a window has at most sixteen whole runs beside the ends of texts, and each queue stays within
about a quantum of its target. Windows are dealt in two levels: the driver runs the round-robin once over whole blocks (at most
``BOUNDS`` starts of blocks in queues, so its work has a fixed bound), which gives every block its exact start in every
queue; each block then runs the same round-robin over its own windows, in parallel, a part of them at a time. Deficits so carry across windows and
blocks alike, and every window but the very last is full.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textaxis.llm.words import lean, slices, text_buffer
from textaxis.operators.ranking import keyed_offsets
from textaxis.session import materialize, scratch

QUEUES, BLOCK_WINDOWS = 1024, 256
#: Runs of a quantum in a window.
RUNS = 16
#: Most blocks, and most entries of the table that says where each block starts in each queue.
BLOCKS, BOUNDS = 1 << 16, 1 << 22
#: Windows that a block deals at a time.
DEALT = 4096
#: Chunks that a worker keeps from one slice to the next, and the most bytes of one.
CACHE, CACHED_BYTES = 200_000, 256
#: Bytes of text that are encoded at a time; one longer text is taken alone.
SLICE_BYTES = 2 << 20
#: A text is cut where the pattern of the vocabulary always cuts, too: before white space that follows something else, after a
#: line break or tab alone, and between letters and symbols.
_BLANKS = " \n\t\r"
_BLANK = np.isin(np.arange(256), [ord(c) for c in _BLANKS])
#: White space that a text is not cut at, though the pattern knows it.
_ODD_SPACE = [0x0B, 0x0C, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]

#: Bytes of ASCII letters and of symbols; the pattern cuts between the two. An apostrophe may begin a contraction, so it is neither.
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_SYMBOL = np.isin(np.arange(256), [b for b in range(33, 127) if not chr(b).isalnum() and b != 39])
#: Pairs of bytes that are a Latin letter (up to U+024F).
_LATIN = np.zeros(1 << 16, bool)
_LATIN[[c[0] << 8 | c[1] for c in (chr(i).encode() for i in range(0xC0, 0x250) if i not in (0xD7, 0xF7))]] = True
#: Bytes of a chunk, and chunks, that are merged as arrays at a time.
PLAIN_BYTES, PLAIN_CHUNKS = 64, 1 << 14
_NONE = np.iinfo(np.int32).max


class ByteMerges:
    """The merges of a byte-level BPE as arrays, for many short words at once.

    In each round every word merges all places of its pair of lowest rank. That equals merging them one by one, as a pair
    with a merged token always ranks after the merges that made the token; ``read`` gives None for a vocabulary where it
    doesn't, or that has other rules.
    """

    def __init__(self, base: np.ndarray, keys: np.ndarray, made: np.ndarray, size: int):
        order = np.argsort(keys)
        self.base, self.made, self.size = base.astype(np.int32), made.astype(np.int32), size
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._slot(keys)] = True
        both = np.arange(1 << 16)
        self.first = self._found(base[both >> 8] * size + base[both & 255])

    @classmethod
    def read(cls, path: str) -> ByteMerges | None:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, cut = held["model"], held.get("pre_tokenizer") or {}
        if held.get("normalizer") or held.get("post_processor") or model["type"] != "BPE" or any(model.get(k) for k in (
                "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from U+0100 on
        char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        vocabulary = model["vocab"]
        if any(c not in vocabulary for c in char.values()):
            return None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        at = dict.fromkeys(char.values(), -1)
        for rank, (a, b) in enumerate(merges):
            at[a + b] = max(rank, at.get(a + b, -1))
        if any(at.get(x, rank) >= rank for rank, m in enumerate(merges) for x in m):
            return None
        ids = np.array([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        size = max(vocabulary.values()) + 1
        return cls(np.array([vocabulary[char[b]] for b in range(256)], np.int64), ids[:, 0] * size + ids[:, 1], ids[:, 2], size)

    def _found(self, key: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``_NONE`` if it has none."""
        out = np.full(len(key), _NONE, np.int32)
        at = np.flatnonzero(self.maybe[self._slot(key)])
        if len(at):
            key = key[at]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[at] = np.where(self.keys[k] == key, self.ranks[k], _NONE)
        return out

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key * 0x9E3779B1 >> 11) & ((1 << 20) - 1)

    def merged(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, which are not empty and lie end to end in ``raw``, in order, and where each word's end."""
        row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        sym, rank = self.base[raw], np.full(len(raw), _NONE, np.int32)
        rank[:-1] = self.first[raw[:-1].astype(np.uint16) << 8 | raw[1:]]
        rank[:-1][row[1:] != row[:-1]] = _NONE
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(row))))
            done = low == _NONE
            if done.any():
                ended.append((row[done], sym[done]))
                live = np.flatnonzero(~done)
                sym, row, rank, low = sym[live], row[live], rank[live], low[live]
            at = np.flatnonzero(rank == low)
            # Of places in a row, which hold one symbol over and over, every second one.
            close = np.diff(at) == 1
            if close.any():
                run = np.append(True, ~close)
                at = at[(np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            keep = np.flatnonzero(keep)
            sym, row, rank = sym[keep], row[keep], rank[keep]
            at = at - np.arange(len(at))
            near = np.zeros(len(sym), bool)
            near[at] = near[at[at > 0] - 1] = True
            again = np.flatnonzero(near)
            rank[again] = _NONE
            again = again[again < len(sym) - 1]
            again = again[row[again] == row[again + 1]]
            rank[again] = self._found(sym[again].astype(np.int64) * self.size + sym[again + 1])
        rows, ids = (np.concatenate(x) for x in zip(*ended, strict=True)) if ended else (row, sym)
        order = np.argsort(rows, kind="stable")
        return ids[order], np.cumsum(np.bincount(rows, minlength=len(sizes)))


class ByteEncoder:
    """A byte-level BPE from a ``tokenizers`` file, with a bounded cache of the chunks between white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([f"[{''.join(map(chr, _ODD_SPACE))}]", *special])
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.merges = ByteMerges.read(path)
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # a character of a token stands for a byte

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _coded(self, raw: list[bytes]) -> list[bytes]:
        """The ids of new chunks: plain ones, of Latin letters or of symbols after a blank or none, by arrays of merges, the
        others by the library."""
        out: list[bytes | None] = [None] * len(raw)
        plain = self._plain(raw) if self.merges is not None and raw else np.zeros(len(raw), bool)
        others = np.flatnonzero(~plain).tolist()
        for i, ids in zip(others, self._by_library([raw[i].decode() for i in others]), strict=True):
            out[i] = ids
        words = np.flatnonzero(plain).tolist()
        for lo in range(0, len(words), PLAIN_CHUNKS):
            some = words[lo:lo + PLAIN_CHUNKS]
            chunks = [raw[i] for i in some]
            ids, ends = self.merges.merged(np.frombuffer(b"".join(chunks), np.uint8), np.fromiter(map(len, chunks), np.int64, len(chunks)))
            flat, at = ids.astype(self.kind).tobytes(), 0
            for i, b in zip(some, (ends * self.kind.itemsize).tolist(), strict=True):
                out[i] = flat[at:b]
                at = b
        return out

    @staticmethod
    def _plain(chunks: list[bytes]) -> np.ndarray:
        """Whether each chunk is one match of the pattern that is known without it."""
        part, sizes = np.frombuffer(b"".join(chunks), np.uint8), np.fromiter(map(len, chunks), np.int64, len(chunks))
        starts = np.cumsum(sizes) - sizes
        letter = _LETTER[part]
        latin = _LATIN[part[:-1].astype(np.uint16) << 8 | part[1:]]
        letter[:-1] |= latin
        letter[1:] |= latin
        inner = sizes - (part[starts] == 32)
        of_one = [np.add.reduceat(x, starts, dtype=np.int64) == inner for x in (letter, _SYMBOL[part])]
        return (inner > 0) & (sizes <= PLAIN_BYTES) & (of_one[0] | of_one[1])

    def _by_library(self, chunks: list[str]) -> list[bytes]:
        """The library's ids of chunks. Those that begin with white space and end without are put end to end, as the pattern
        cuts between them, too; the ids are told apart by their bytes."""
        out: list[bytes | None] = [None] * len(chunks)
        alone = [i for i, c in enumerate(chunks) if c[0] not in _BLANKS or c[-1] in _BLANKS]
        for i, ids in zip(alone, self._ids([chunks[i] for i in alone]), strict=True):
            out[i] = ids
        rest = [i for i, c in enumerate(chunks) if c[0] in _BLANKS and c[-1] not in _BLANKS]
        rows = [rest[i:i + 512] for i in range(0, len(rest), 512)]
        found = self.tokenizer.encode_batch_fast(["".join([chunks[i] for i in r]) for r in rows], add_special_tokens=False)
        for row, e in zip(rows, found, strict=True):
            ids = np.array(e.ids, self.kind)
            done = np.cumsum(self.bytes_of[ids])
            ends = np.cumsum([len(chunks[i].encode()) for i in row])
            cut = np.searchsorted(done, ends) + 1
            if (done[cut - 1] != ends).any():
                raise ValueError("an id spans two chunks: this vocabulary can't be read by chunks")
            raw, at = ids.tobytes(), 0
            for i, b in zip(row, (cut * self.kind.itemsize).tolist(), strict=True):
                out[i] = raw[at:b]
                at = b
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as bytes; equal to the library's over the whole text."""
        return self.encode_column(pa.array(texts, pa.large_string()))

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """As ``encode``, for a column: equal chunks meet in Arrow, only the distinct ones are looked up."""
        odd = pc.match_substring_regex(texts, self.odd).fill_null(False).to_numpy(zero_copy_only=False)
        out: list[bytes | None] = [None] * len(texts)
        if not odd.all():
            held = np.flatnonzero(~odd)
            for i, ids in zip(held.tolist(), self._by_chunks(texts.take(pa.array(held)) if odd.any() else texts), strict=True):
                out[i] = ids
        if odd.any():
            whole = np.flatnonzero(odd)
            for i, ids in zip(whole.tolist(), self._ids(texts.take(pa.array(whole)).to_pylist()), strict=True):
                out[i] = ids
        return out

    def _by_chunks(self, texts: pa.Array) -> list[bytes]:
        buf, offsets = text_buffer(texts)
        part, at = buf[offsets[0]:offsets[-1]], offsets - offsets[0]
        if not len(part):
            return [b""] * len(texts)
        blank = _BLANK[part]
        begin = blank.copy()
        begin[1:] &= ~blank[:-1]
        begin[at[:-1][at[1:] > at[:-1]]] = True
        alone = np.flatnonzero(begin[:-1] & ~blank[1:] & blank[:-1] & (part[:-1] != 32))
        begin[alone[~blank[alone - 1] | (alone == 0)] + 1] = True
        symbol = _SYMBOL[part]
        turn = np.flatnonzero(symbol[1:] & ~symbol[:-1])  # the last byte of a letter or of anything else
        before = part[turn]
        begin[turn[_LETTER[before] | (_LATIN[part[turn - 1].astype(np.uint16) << 8 | before] & (turn > 0))] + 1] = True
        turn = np.flatnonzero(symbol[:-1] & ~symbol[1:])
        begin[turn[_LETTER[part[turn + 1]]] + 1] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts, len(part))
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(part)]).dictionary_encode()
        if len(self.known) > CACHE:  # what came up first is mostly what comes up often
            self.known = dict(islice(self.known.items(), CACHE // 2))
        names, cuts = text_buffer(chunks.dictionary)
        names, cuts = names.tobytes(), cuts.tolist()
        named = [names[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        distinct = list(map(self.known.get, named))
        new = [i for i, ids in enumerate(distinct) if ids is None]
        for i, ids in zip(new, self._coded([named[i] for i in new]), strict=True):
            distinct[i] = ids
            if len(named[i]) <= CACHED_BYTES:
                self.known[named[i]] = ids
        del names, named
        ids = np.frombuffer(b"".join(distinct), self.kind)
        size = np.fromiter(map(len, distinct), np.int64, len(distinct)) // self.kind.itemsize
        code = chunks.indices.to_numpy(zero_copy_only=False)
        many = size[code]
        done = np.append(0, np.cumsum(many))
        place = np.arange(done[-1]) + np.repeat((np.cumsum(size) - size)[code] - done[:-1], many)
        raw = ids[place].tobytes()
        edges = (done[np.searchsorted(starts, at)] * self.kind.itemsize).tolist()
        return [raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


_encoders: dict[str, ByteEncoder] = {}


def _encoder(path: str) -> ByteEncoder:
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        end = np.zeros(1, encoder.kind).tobytes()
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices(text_buffer(texts)[1], SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                ids = [x + end for x in encoder.encode_column(part.column("text"))]
                n = [len(x) // encoder.kind.itemsize for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                                                 names=["doc_id", "source", "n", "ids"])

    return run


def deal(credit: np.ndarray, left: np.ndarray, size: int, quantum: int = 1) -> np.ndarray:
    """Whole numbers that sum up to ``size``, near ``credit`` and at most ``left``.

    A queue whose credit is under the quantum (or under what it has left) waits. What then is missing comes in runs of a
    quantum from those with the most credit left; what is too much goes from those with the least. Ties go to the first
    queue.
    """
    give = np.where(credit >= np.minimum(quantum, left), np.minimum(np.floor(np.maximum(credit, 0)).astype(np.int64), left), 0)
    while short := size - int(give.sum()):
        sign = 1 if short > 0 else -1
        able = np.flatnonzero(left > give) if short > 0 else np.flatnonzero(give)
        step = max(quantum, abs(short) // len(able))
        most = np.minimum(step, left - give) if short > 0 else np.where(give < 2 * step, give, step)
        first = able[np.argsort(-sign * (credit - give)[able], kind="stable")]
        before = np.cumsum(most[first]) - most[first]
        give[first] += sign * np.clip(abs(short) - before, 0, most[first])
    return give


def rounds(start_left: np.ndarray, share: np.ndarray, sizes: list[int], deficit: np.ndarray | None = None, quantum: int = 1) -> np.ndarray:
    """What each round takes from each queue; deficits carry from round to round, and on in ``deficit`` if given. A queue
    that ended ahead of its target goes on earning what it took too early; the rest of its share goes to the others."""
    left, carried = start_left.copy(), deficit
    deficit = np.zeros(len(share)) if carried is None else carried.copy()
    out = np.zeros((len(sizes), len(share)), np.int64)
    for k, size in enumerate(sizes):
        earning, live = np.where((left > 0) | (deficit < 0), share, 0), np.where(left > 0, share, 0)
        credit = deficit + size * (earning / earning.sum() if earning.sum() else earning)
        over = np.where(left > 0, 0, np.maximum(credit, 0))
        credit += over.sum() * (live / live.sum() if live.sum() else live) - over
        out[k] = give = deal(credit, left, size, quantum)
        left -= give
        deficit = np.where(left > 0, credit - give, np.minimum(credit - give, 0))
    if carried is not None:
        carried[:] = deficit
    return out


def _to_blocks(shared):
    """``shared`` has bounds[b, q]: where block b starts in queue q."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shared.value
        for batch in batches:
            q, start, n, rid = (batch.column(c).to_numpy() for c in ("queue", "start", "n", "rid"))
            first, last = np.empty(len(q), np.int64), np.empty(len(q), np.int64)
            for k in np.unique(q):
                at = q == k
                first[at] = np.searchsorted(bounds[:, k], start[at], "right") - 1
                last[at] = np.searchsorted(bounds[:, k], start[at] + n[at] - 1, "right") - 1
            times = last - first + 1
            block = np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block, *(np.repeat(c, times) for c in (q, start, n, rid)))],
                                             names=["block", "queue", "start", "n", "rid"])

    return run


def _fill(shared, sizes: np.ndarray, per: int, length: int, quantum: int):
    schema = pa.schema([(c, pa.int64()) for c in ("rid", "start", "length", "sequence_id", "offset")])

    def run(key, table):
        b, bounds = key[0].as_py(), shared.value
        size, begin, end = int(sizes[b]), bounds[b], bounds[b + 1]
        share = np.where(end > begin, (end - begin) / max(1, size), 0)
        windows = [length] * (size // length) + ([size % length] if size % length else [])
        q, start, n, rid = (table.column(c).to_numpy() for c in ("queue", "start", "n", "rid"))
        queues = [(k, at[np.argsort(start[at], kind="stable")]) for k in np.unique(q) for at in (np.flatnonzero(q == k),)]
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        deficit = np.zeros(len(share))
        for w in range(0, len(windows), DEALT):
            give = rounds(end - begin, share, windows[w:w + DEALT], deficit, quantum)
            edges = begin + np.vstack([np.zeros((1, len(share)), np.int64), np.cumsum(give, axis=0)])
            before = np.cumsum(give, axis=1) - give
            begin = edges[-1]
            for k, at in queues:
                s, e = start[at], start[at] + n[at]
                low, high = np.searchsorted(e, edges[0, k], "right"), np.searchsorted(s, edges[-1, k], "left")
                s, e, ids = s[low:high], e[low:high], rid[at][low:high]
                cuts = np.unique(np.concatenate([s, e, edges[:, k]]))
                cuts = cuts[(cuts >= edges[0, k]) & (cuts <= edges[-1, k])]
                p, size_of = cuts[:-1], np.diff(cuts)
                doc = np.searchsorted(s, p, "right") - 1
                window = np.searchsorted(edges[:, k], p, "right") - 1
                for c, v in zip(out, (ids[doc], p - s[doc], size_of, b * per + w + window, before[window, k] + p - edges[window, k]), strict=True):
                    c.append(v)
        return pa.Table.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], schema=schema)

    return run


def _checked(kind: str):
    """Pieces with the checksums of their ids; only the checksums are taken one by one."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = batch.column("pieces")
            flat = pieces.flatten()
            start, length = flat.field("start").to_pylist(), flat.field("length").to_pylist()
            many = pieces.value_lengths().to_numpy()
            sums, at = [], 0
            for ids, k in zip(batch.column("ids"), many.tolist(), strict=True):
                wide = memoryview(np.frombuffer(ids.as_buffer(), kind).astype("<u4").view(np.uint8))
                sums += [zlib.crc32(wide[4 * a:4 * (a + n)]) for a, n in zip(start[at:at + k], length[at:at + k], strict=True)]
                at += k
            row = pa.array(np.repeat(np.arange(len(many)), many))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(row), flat.field("start"), flat.field("length"), pa.array(sums, pa.int64()), batch.column("n").take(row),
                flat.field("sequence_id"), flat.field("offset")], names=names)

    return run


def pack(docs: DataFrame, vocabulary: str, length: int = 1024, shares: dict[str, float] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``docs`` has doc_id, text and source; other columns are ignored. ``vocabulary`` is the path of a byte-level
    ``tokenizers`` file, the same on every executor. A document is its ids and then id 0 (a null or empty text: id 0
    alone). ``shares`` are target proportions by source (default: the corpus's own); a queue that ends leaves its share
    to the others. Sources beyond the ``QUEUES - 1`` largest share one queue, whose target is the sum of theirs; nulls
    are a source like any other. Each id is in exactly one piece; all sequences hold ``length`` ids but the last.
    Repeated rows, and rows without doc_id, are documents of their own; texts of any length are packed whole; an empty
    table gives no row.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    with scratch(spark) as keep:
        coded = docs.mapInArrow(lean(_encode(vocabulary)), "doc_id long, source string, n long, ids binary")
        coded = keep(materialize(coded.withColumn("rid", F.monotonically_increasing_id()), "ids", "zstd"))
        kind = _encoder(vocabulary).kind.str
        by_source = coded.groupBy("source").agg(F.sum("n").alias("n"))
        sizes = by_source.orderBy(F.desc("n"), "source").limit(QUEUES - 1).collect()
        total = coded.agg(F.sum("n"), F.count("*")).first()
        tokens, rows = total[0] or 0, total[1]
        names = [r["source"] for r in sizes]
        held = np.array([r["n"] for r in sizes] + [tokens - sum(r["n"] for r in sizes)], np.int64)
        if shares is None:
            share = held / max(1, tokens)
        else:
            given = set(names)
            share = np.array([shares.get(x, 0.0) for x in names] + [sum(v for x, v in shares.items() if x not in given)], float)
        share = np.where(held > 0, np.maximum(share, 0), 0)

        quantum = max(1, length // RUNS)
        windows = -(-tokens // length)
        per = max(BLOCK_WINDOWS, -(-windows // min(BLOCKS, BOUNDS // len(held))))
        blocks = -(-windows // per)
        amounts = [min(per * length, tokens - b * per * length) for b in range(blocks)]
        taken = rounds(held, share, amounts, quantum=quantum)
        bounds = spark.sparkContext.broadcast(np.vstack([np.zeros((1, len(held)), np.int64), np.cumsum(taken, axis=0)]))  # at most BOUNDS

        number = spark.createDataFrame(pa.table(  # of Arrow: no Python worker of its own
            [pa.array([x is None for x in names], pa.bool_()), pa.array([x or "" for x in names], pa.string()), pa.array(range(len(names)), pa.int32())],
            ["__null", "__source", "queue"]))
        light = coded.select("source", "n", "rid").join(
            F.broadcast(number), F.col("source").isNull().eqNullSafe(F.col("__null")) & (F.coalesce("source", F.lit("")) == F.col("__source")), "left")
        light = light.select(F.coalesce("queue", F.lit(len(names))).alias("queue"), "n", "rid")
        placed = keyed_offsets(light, ["queue"], ["rid"], "n", out="start", salts=max(1024, rows // 50_000))
        shape = "block long, queue int, start long, n long, rid long"
        pieces = (
            placed.select("queue", "start", "n", "rid").mapInArrow(lean(_to_blocks(bounds)), shape).groupBy("block")
            .applyInArrow(_fill(bounds, np.array(amounts, np.int64), per, length, quantum), "rid long, start long, length long, sequence_id long, offset long")
            .groupBy("rid").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
        )
        pieces = keep(materialize(pieces, "pieces"))
    shape = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return coded.join(pieces, "rid").select("doc_id", "n", "ids", "pieces").mapInArrow(lean(_checked(kind)), shape)
