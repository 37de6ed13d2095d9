"""Sharding by balanced label propagation.

Documents with equal texts are neighbours. Labels (shards) start even; in each round every linked document asks for
the shard where most of its neighbours are, unless its own shard is already full of them. Moves are granted under
quotas: what leaves a shard for another comes back as documents that want the opposite way, along a cycle of demands,
or else as documents that want nothing, so sizes never change. A shard that couldn't grant all its demands is passed
over in the next round only. Groups larger than an eighth of a shard settle first, while all other documents may pay
for their moves; then the small groups do, paid for by documents without neighbours.

Neighbourhoods are counts by (group, shard), never pairs. Movers are taken by rank within (from, to) along a prefix of
their group's hash, so a group moves whole where its demand isn't granted in full; the running counts are salted, so a
group with a third of all rows is dealt like any other. Only the shards-by-shards matrix of demands reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textaxis.operators.ranking import keyed_offsets
from textaxis.session import materialize, release, scratch


def _way_back(rest: np.ndarray, spare: np.ndarray, start: int, end: int) -> list[int] | None:
    """The shortest chain of demands from ``start`` to ``end``, or to a shard with spare documents; None without one."""
    came, queue = {start: start}, [start]
    for at in queue:
        if at == end or spare[at]:
            chain = [at]
            while chain[-1] != start:
                chain.append(came[chain[-1]])
            return chain[::-1]
        for to in np.flatnonzero(rest[at]).tolist():
            if to not in came:
                came[to] = at
                queue.append(to)
    return None


def _quotas(demand: np.ndarray, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Granted moves by (from, to), and moves of spare documents by (from, to) that pay for them."""
    grant = np.minimum(demand, demand.T)
    rest, spare = demand - grant, spare.copy()
    wanted = rest.sum(axis=0)
    share = rest * np.minimum(1.0, spare / np.maximum(wanted, 1))[None, :]
    paid = np.floor(share).astype(np.int64)
    for j in range(len(spare)):  # what rounding left over, one each by largest remainder
        most = np.argsort(paid[:, j] - share[:, j], kind="stable")[: int(min(spare[j], wanted[j]) - paid[:, j].sum())]
        paid[most, j] += rest[most, j] > paid[most, j]
    grant, back, rest, spare = grant + paid, paid.T.copy(), rest - paid, spare - paid.sum(axis=0)
    for i, j in np.argwhere(rest).tolist():
        while rest[i, j] and (chain := _way_back(rest, spare, j, i)):
            steps = [(i, j), *zip(chain, chain[1:], strict=False)]
            n = min(rest[a, b] for a, b in steps)
            if chain[-1] != i:
                n = min(n, spare[chain[-1]])
                spare[chain[-1]] -= n
                back[chain[-1], i] += n
            for a, b in steps:
                rest[a, b] -= n
                grant[a, b] += n
    return grant, back


def _moved(rows: DataFrame, keys: list[str], order: list[str], quota: list[tuple], salts: int, salt: Column | None = None) -> DataFrame:
    """Rows by rank: ``quota`` lists (*keys, from rank, to rank, new shard)."""
    shape = ", ".join(f"__q{i} int" for i in range(len(keys))) + ", __a long, __b long, __to int"
    table = rows.sparkSession.createDataFrame(quota, shape)  # at most shards * shards rows
    on = (F.col("__rank") >= F.col("__a")) & (F.col("__rank") < F.col("__b"))
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"__q{i}"))
    ranked = keyed_offsets(rows, keys, order, out="__rank", salts=salts, salt=salt)
    return ranked.join(F.broadcast(table), on, "left").withColumn("shard", F.coalesce("__to", "shard")).select(*rows.columns)


def _settle(linked: DataFrame, spare_rows: DataFrame, shards: int, full: int, rounds: int, salts: int) -> tuple[DataFrame, DataFrame]:
    """Rounds of propagation of ``linked`` (rid, shard, grp), paid for by ``spare_rows`` (rid, shard, grp), until no
    pair of neighbours is cut, or three rounds in a row cut no fewer of them. Gives the state with the fewest."""
    shut: list[int] = []
    best, kept, stale = None, (linked, spare_rows), 0
    prefix = F.conv(F.hex(F.substring("grp", 1, 2)), 16, 10).cast("long").bitwiseAND(4095)
    inner = max(16, salts // 4096)
    for _ in range(rounds):
        near = materialize(linked.groupBy("grp", "shard").agg(F.count("*").alias("c")), "near")
        n, c = F.sum("c").cast("decimal(18,0)"), F.col("c").cast("decimal(18,0)")
        cut = near.groupBy("grp").agg((n * n - F.sum(c * c)).alias("cut")).agg(F.coalesce(F.sum("cut"), F.lit(0))).first()[0]
        if best is None or cut < best:
            gone = [] if best is None else [t for t, now in zip(kept, (linked, spare_rows), strict=True) if t is not now]
            best, kept, stale = cut, (linked, spare_rows), 0
            release(*gone)
        else:
            stale += 1
        if not cut or stale == 3:
            release(near)
            break
        able = F.col("c") < full
        if shut:
            able = able & ~F.col("shard").isin(*shut)
        first = F.struct("c", F.xxhash64("grp", "shard").alias("tie"), "shard")
        goal = near.groupBy("grp").agg(F.max(F.when(able, first)).alias("g"), F.sum("c").alias("n")).where("g is not null")
        goal = goal.select("grp", F.col("g.shard").alias("goal"), F.col("g.c").alias("there"), "n")
        # A small group goes where there is room, even if more of it is elsewhere.
        ask = near.join(goal, "grp").where(f"shard <> goal and c < {full} and (c <= there or n <= {full // 8})").select("grp", "shard", "goal")
        asks = materialize(linked.join(ask, ["grp", "shard"], "left").select("rid", "grp", "shard", "goal"), "asks")
        demand, spare = np.zeros((shards, shards), np.int64), np.zeros(shards, np.int64)
        for r in asks.where("goal is not null").groupBy("shard", "goal").agg(F.count("*").alias("n")).collect():
            demand[r["shard"], r["goal"]] += r["n"]
        for r in spare_rows.groupBy("shard").agg(F.count("*").alias("n")).collect():
            spare[r["shard"]] += r["n"]
        grant, back = _quotas(demand, spare)
        passed_over, shut = bool(shut), np.flatnonzero((demand - grant).sum(axis=0)).tolist()
        if grant.any():
            won = [(i, j, 0, int(grant[i, j]), j) for i in range(shards) for j in range(shards) if grant[i, j]]
            paying = []
            for j in range(shards):
                a = 0
                for i in range(shards):
                    if back[j, i]:
                        paying.append((j, a, a + int(back[j, i]), i))
                        a += int(back[j, i])
            wish = asks.where("goal is not null").withColumn("__g", prefix)
            salt = F.col("__g") * inner + F.pmod(F.xxhash64("rid"), F.lit(inner))
            moved = _moved(wish, ["shard", "goal"], ["__g", "rid"], won, salts, salt)
            before = linked, spare_rows
            linked = materialize(moved.select("rid", "shard", "grp").unionByName(asks.where("goal is null").select("rid", "shard", "grp")), "linked")
            if paying:
                spare_rows = materialize(_moved(spare_rows, ["shard"], ["rid"], paying, salts), "spare")
            release(*[t for t, now in zip(before, (linked, spare_rows), strict=True) if t is not now and t not in kept])
        elif not passed_over and not shut:
            release(near, asks)
            break
        release(near, asks)
    return kept


def shard_by_propagation(docs: DataFrame, shards: int = 16, rounds: int = 40) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``rows``: shards differ by at most one row. ``slot`` numbers a shard's rows from 0 without gaps;
    ``grown_shard`` is null, as adding a shard deals anew. A null text has no bytes (size 1, crc32 0) and no
    neighbours; rows without doc_id and repeated rows are rows like any other; an empty table gives no row; of very
    long texts only size and hashes travel; other columns are ignored. Propagation ends when no group is cut, when
    three rounds bring no gain, or after ``rounds``; what it couldn't bring together then stays apart, see
    ``cut_share``.
    """
    text = F.col("text").cast("string")
    with scratch(docs.sparkSession) as keep:
        base = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.unhex(F.md5(text)).alias("grp"))
        base = keep(materialize(base.withColumn("rid", F.monotonically_increasing_id()), "docs"))
        rows = base.count()
        salts, full = max(256, rows // 50_000), rows // shards
        groups = materialize(base.where("grp is not null").groupBy("grp").agg(F.count("*").alias("n")).where("n > 1"), "groups")
        start = keyed_offsets(base.select("rid", "grp"), [], ["rid"], out="at", salts=salts)
        start = materialize(start.withColumn("shard", (F.col("at") % shards).cast("int")).drop("at"), "start")
        # Rows without neighbours never meet the joins by group; they only pay for moves.
        alone = start.where("grp is null").select("rid", "shard", "grp").unionByName(
            start.where("grp is not null").join(groups, "grp", "left_anti").select("rid", "shard", F.lit(None).cast("binary").alias("grp")))
        large = groups.where(F.col("n") > max(full // 8, 1))  # at most 8 * shards groups, or a small table
        small = start.where("grp is not null").join(groups.where(F.col("n") <= max(full // 8, 1)), "grp", "left_semi").select("rid", "shard", "grp")
        settled = None
        if large.limit(1).count():
            hot = materialize(start.where("grp is not null").join(large, "grp", "left_semi").select("rid", "shard", "grp"), "linked")
            others = materialize(small.unionByName(alone), "spare")
            settled, others = _settle(hot, others, shards, full, rounds, salts)
            small, alone = others.where("grp is not null"), others.where("grp is null")
        small, alone = materialize(small, "linked"), materialize(alone, "spare")
        small, alone = _settle(small, alone, shards, full, rounds, salts)
        placed = small.unionByName(alone)
        placed = (placed if settled is None else placed.unionByName(settled)).select("rid", "shard")
        placed = keep(materialize(keyed_offsets(placed, ["shard"], ["rid"], out="slot", salts=salts), "placed"))
    return base.join(placed, "rid").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def cut_share(placed: DataFrame) -> float:
    """Share of documents with an equal text that aren't in their group's largest shard (0: no edge is cut); texts of size 1 count as equal."""
    near = placed.groupBy("text_crc32", "size", "shard").agg(F.count("*").alias("c"))
    by = near.groupBy("text_crc32", "size").agg(F.sum("c").alias("n"), F.max("c").alias("m")).where("n > 1")
    got = by.agg(F.sum("n").alias("n"), F.sum("m").alias("m")).first()
    return 1 - got["m"] / got["n"] if got["n"] else 0.0
