"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens at places no vocabulary piece spans. A batch of distinct pre-tokens is one ragged numpy
array of symbols; in each round every pre-token applies its lowest-rank pair, all pre-tokens at once, and what survives
is counted. Pre-tokens seen before come from a bounded cache, so a round only holds new ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CACHE = 1 << 20
#: Symbols of new pre-tokens that are merged at a time.
ROUND_SYMBOLS = 1 << 20
_NONE = np.iinfo(np.int32).max


class PieceMerges:
    """The merges of a sentencepiece BPE model with byte fallback, as arrays."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = [model.id_to_piece(i) for i in normal]
        # Equal scores would be told apart by place only, so ranks must keep them equal.
        scores = np.array([model.get_score(i) for i in normal])
        self.rank_of_piece = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        number = {p: k for k, p in enumerate(pieces)}
        inner = sorted({c for p in pieces for c in p} - set(number))
        self.known = len(pieces)
        for c in inner:  # characters that only stand inside pieces
            number[c] = len(number)
        self.bytes_of = np.array([len(c.encode()) for c in inner], np.int64)
        self.symbol = {c: k for c, k in number.items() if len(c) == 1}
        left, right, made = [], [], []
        least: dict[str, int] = {}
        for p, k in zip(pieces, range(len(pieces)), strict=True):
            for i in range(1, len(p)):
                a, b = p[:i], p[i:]
                if a in number and b in number:
                    left.append(number[a])
                    right.append(number[b])
                    made.append(k)
                for part in (a, b):
                    least[part] = min(least.get(part, _NONE), int(self.rank_of_piece[k]))
        self.size = len(number) + 1
        key = np.array(left, np.int64) * self.size + np.array(right, np.int64)
        order = np.argsort(key)
        self.keys, self.made = key[order], np.array(made, np.int32)[order]
        self.maybe = np.zeros(1 << 21, bool)
        self.maybe[self._slot(self.keys)] = True
        #: Whether all places of a pair may be merged at once: nothing that its piece could join has a better rank.
        self.at_once = np.array([least.get(p, _NONE) > self.rank_of_piece[k] for k, p in enumerate(pieces)])
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("pieces hold a space after a character: words of this model can't be counted apart")
        joined = {c for p in pieces if len(p) > 1 for c in p}
        self.cut = re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if "\n" not in joined else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key * 0x9E3779B1 >> 11) & ((1 << 21) - 1)

    def pretokens(self, text: str) -> list[str]:
        """The text's pre-tokens with the model's leading space; none for an empty text."""
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair, -1 if it makes none."""
        key = left.astype(np.int64) * self.size + right
        out = np.full(len(key), -1, np.int32)
        at = np.flatnonzero(self.maybe[self._slot(key)] & (left >= 0) & (right >= 0))
        if len(at):
            j = np.minimum(np.searchsorted(self.keys, key[at]), len(self.keys) - 1)
            hit = self.keys[j] == key[at]
            out[at[hit]] = self.made[j[hit]]
        return out

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        total = np.zeros(len(words), np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        symbol = self.symbol
        sym = np.fromiter((symbol.get(c, -1) for w in words for c in w), np.int32, int(sizes.sum()))
        row = np.repeat(np.arange(len(words)), sizes)
        # A character without a piece of its own stays and becomes its bytes.
        odd = np.flatnonzero(sym < 0)
        extra = np.zeros(len(words), np.int64)
        if len(odd):
            text = "".join(words)
            for i in odd.tolist():
                extra[row[i]] += len(text[i].encode("utf-8", "surrogatepass")) - 1
        while len(sym):
            made = np.full(len(sym), -1, np.int32)
            made[:-1] = self._pairs(sym[:-1], sym[1:])
            made[:-1][row[:-1] != row[1:]] = -1
            rank = np.where(made >= 0, self.rank_of_piece[made], _NONE)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            length = np.diff(np.r_[first, len(row)])
            low = np.minimum.reduceat(rank, first)
            spread = np.repeat(low, length)
            chosen = (rank == spread) & (rank < _NONE)
            at = np.flatnonzero(chosen)
            # Of places in a row, every second one; of a pair that isn't safe, the first of its pre-token.
            run = np.r_[True, np.diff(at) != 1]
            offset = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1] if len(at) else at
            lead = np.r_[True, row[at[1:]] != row[at[:-1]]] if len(at) else run[:0]
            at = at[lead | (self.at_once[made[at]] & (offset % 2 == 0))]
            done = low == _NONE
            if done.any():
                ended = row[first[done]]
                # Characters that only stand inside pieces, and were not joined into one, become their bytes, too.
                inner = np.flatnonzero(np.repeat(done, length) & (sym >= self.known))
                np.add.at(extra, row[inner], self.bytes_of[sym[inner] - self.known] - 1)
                kept = np.zeros(len(words), np.int64)
                kept[ended] = length[done]
                total += kept
            sym[at] = made[at]
            keep = ~np.repeat(done, length)
            keep[at + 1] = False
            sym, row = sym[keep], row[keep]
        return total + extra


_models: dict[str, tuple[PieceMerges, dict[str, int]]] = {}


def _loaded(path: str) -> tuple[PieceMerges, dict[str, int]]:
    if path not in _models:
        _models[path] = (PieceMerges(path), {})
    return _models[path]


def count_tokens(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each text; null counts as empty."""
    merges, known = _loaded(path)
    out: list[int] = []
    lo = 0
    while lo < len(texts):
        parts, size, hi = [], 0, lo
        while hi < len(texts) and size < ROUND_SYMBOLS:
            parts.append(merges.pretokens(texts[hi] or ""))
            size += len(texts[hi] or "")
            hi += 1
        if len(known) > CACHE:
            known.clear()
        new = list({w for p in parts for w in p if w not in known})
        if new:
            known.update(zip(new, merges.counts(new).tolist(), strict=True))
        get = known.__getitem__
        out += [sum(map(get, p)) for p in parts]
        lo = hi
    return out


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row of ``docs`` (doc_id, text), in one scan.

    ``model`` is the path of a sentencepiece BPE model file, the same on every executor. Counts equal the library's
    without begin, end or added special tokens; a null text counts as empty (0 bytes, 0 tokens). Repeated rows and rows
    without doc_id are counted like any other; an empty table gives no row; texts of any length are counted whole;
    other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = count_tokens(batch.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")).alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
