"""Greedy selection along a key's order, for keys of any length.

A key's rows lie in ranges (``ranking.ordered_parts``). What a range does to a greedy scan that enters it is a function of
where the scan may take its next row, and only rows within one gap of the range's start can be first: so each range sends
that short table, the tables of a key are composed in order, and every range then selects its rows on its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textaxis.operators.ranking import ordered_parts


def _next(at: np.ndarray, gap: int) -> np.ndarray:
    """For each of ascending distinct places the first one that is at least ``gap`` on, its number."""
    return np.searchsorted(at, at + max(gap, 1), "left")


def entry_table(at: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a scan can enter a range of ascending distinct places, and from where it may take a row after it, for each."""
    after = _next(at, gap).tolist()
    leaves = (at + gap).tolist()
    for i in range(len(at) - 1, -1, -1):
        if after[i] < len(at):
            leaves[i] = leaves[after[i]]
    n = min(len(at), int(np.searchsorted(at, at[0] + gap, "left")) + 1)
    return at[:n], np.array(leaves[:n], np.int64)


def chosen(at: np.ndarray, gap: int, since: int | None) -> np.ndarray:
    """Numbers of the places that a greedy scan takes which may take none before ``since``."""
    after = _next(at, gap).tolist()
    i, out = 0 if since is None else int(np.searchsorted(at, since, "left")), []
    while i < len(at):
        out.append(i)
        i = after[i]
    return np.array(out, np.int64)


def min_gap_rows(rows: DataFrame, key: str, index: str, gap: int) -> DataFrame:
    """``(key, index)`` of a greedy selection: from each key's first index on, each that is at least ``gap`` after the last one taken.

    Indexes are longs; equal ones count once; rows with a null in either column are left out. A key may lie in any
    number of ranges; what one task holds is a range, and for the composition the rows of a key within one gap of
    each range's start.
    """
    kind = rows.schema[key].dataType
    able = rows.select(F.col(key).alias("k"), F.col(index).cast("long").alias("i")).where("k is not null and i is not null")
    parts = ordered_parts(able, ["k"], ["i"])
    spread = parts.groupBy("k").agg(F.min("__part").alias("__a"), F.max("__part").alias("__b")).where("__a < __b").select("k")  # at most one for each range's end

    def enter(by, table):
        at = np.unique(table.column("i").to_numpy())
        entry, leave = entry_table(at, gap)
        n = len(entry)
        return pa.Table.from_arrays([pa.array([by[0].as_py()] * n, table.schema.field("k").type), pa.array([by[1].as_py()] * n, pa.int32()), pa.array(entry), pa.array(leave)], names=["k", "part", "entry", "leave"])

    def compose(by, table):
        part, entry, leave = (table.column(c).to_numpy() for c in ("part", "entry", "leave"))
        order = np.lexsort((entry, part))
        part, entry, leave = part[order], entry[order], leave[order]
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        since, out = None, []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            out.append(since)
            i = a if since is None else a + int(np.searchsorted(entry[a:b], since, "left"))
            if i < b:
                since = int(leave[i])
        return pa.Table.from_arrays([pa.array([by[0].as_py()] * len(out), table.schema.field("k").type), pa.array(part[cuts[:-1]]), pa.array(out, pa.int64())], names=["k", "part", "since"])

    def select(by, table):
        keys = table.column("k").combine_chunks().dictionary_encode()
        code, at = keys.indices.to_numpy(zero_copy_only=False), table.column("i").to_numpy()
        order = np.lexsort((at, code))
        code, at, since = code[order], at[order], table.column("since").combine_chunks().take(pa.array(order))
        cuts = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True])
        kept = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = at[a:b]
            fresh = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            kept.append(a + fresh[chosen(own[fresh], gap, since[a].as_py())])
        kept = np.concatenate(kept)
        return pa.Table.from_arrays([keys.dictionary.take(pa.array(code[kept])), pa.array(at[kept])], names=["k", "i"])

    name = kind.simpleString()
    tables = parts.join(F.broadcast(spread), "k").groupBy("k", "__part").applyInArrow(enter, f"k {name}, part int, entry long, leave long")
    starts = tables.groupBy("k").applyInArrow(compose, f"k {name}, part int, since long").where("since is not null")
    placed = parts.join(F.broadcast(starts.withColumnRenamed("part", "__part")), ["k", "__part"], "left")
    kept = placed.groupBy("__part").applyInArrow(select, f"k {name}, i long")
    return kept.select(F.col("k").alias(key), F.col("i").alias(index))
