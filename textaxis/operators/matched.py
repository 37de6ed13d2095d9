"""A sample matched across quadrants: shared budgets of source groups and topics, top-ups, and three caps at once.

Whether a row is taken depends on all earlier choices, but only through counts. So the table is first cut to the rows that
any course of choices could look at, by ranks of ranges and limits that Spark applies before its shuffles; what is left
of a quadrant is a small multiple of the target, whatever the table's size or its number of sources, and the stages run
over that.

Why these rows suffice: rows alike to all caps (one source, topic and group) are taken as a prefix of the seeded order. In a topic's
stage only sources can be short, and a source that is short by r rows has r rows taken elsewhere, so the first
``budget + target`` rows of those within their source's first ``budget`` decide. In a top-up, of a (source, topic) pair at most
``need`` rows are taken and ``target`` were taken before; of a topic, rows of full sources are passed over, of which there are at
most ``target / source cap``. Confidence ranks shift by at most the rows taken before, so the rows around a pool's edge are all kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textaxis.operators.corpus import hash_order
from textaxis.operators.ranking import ordered
from textaxis.session import materialize, scratch


def budgets_by_share(total: int, shares: dict[str, float]) -> dict[str, int]:
    """Largest-remainder whole numbers that sum up to ``total``; equal remainders go to the earlier label."""
    exact = {g: total * s for g, s in shares.items()}
    out = {g: math.floor(x) for g, x in exact.items()}
    for g in sorted(exact, key=lambda g: out[g] - exact[g])[:max(0, total - sum(out.values()))]:
        out[g] += 1
    return out


def even_budgets(total: int, labels: list[str]) -> dict[str, int]:
    """Nearly equal whole numbers; what is left goes to the first labels."""
    return {x: total // len(labels) + (i < total % len(labels)) for i, x in enumerate(labels)}


def pool_size(n, need: int, share: float):
    """How many of ``n`` candidates, best first, are eligible for ``need`` places: all if they don't exceed these."""
    return n if n <= need else max(need, math.ceil(n * share))


class _Choices:
    """What a quadrant has taken so far, against its caps."""

    def __init__(self, caps: dict[str, int]):
        self.caps, self.used, self.taken = caps, {c: {} for c in caps}, []

    def count(self, column: str, value) -> int:
        return self.used[column].get(value, 0)

    def scan(self, rows, most: int, enforced: tuple[str, ...], stage: str) -> None:
        """Take rows in their order while caps allow, at most ``most``."""
        added = 0
        for at, *values in rows:
            if added >= most:
                break
            row = dict(zip(self.caps, values, strict=True))
            if all(self.count(c, row[c]) < self.caps[c] for c in enforced):
                for c, v in row.items():
                    self.used[c][v] = self.count(c, v) + 1
                self.taken.append((at, stage))
                added += 1


def _stages(columns: tuple[str, str, str], budgets: dict[str, int], topics: list[str], target: int, caps: tuple[int, int, int], share: float, least_cell: int):
    def run(pdf):
        pdf = pdf.reset_index(drop=True)
        source, group, topic = columns
        state = _Choices(dict(zip(columns, caps, strict=True)))
        taken = pdf["__e1"] < 0

        def rows(mask, order):
            part = pdf[mask].sort_values([order, "__tie"])
            return part[list(columns)].itertuples(name=None)

        def eligible(mask, rank: str, total: int, need: int):
            """Rows not yet taken whose rank among such is in the pool."""
            before = pdf.loc[mask & taken, rank].sort_values().to_numpy()
            left = mask & ~taken
            shifted = pdf[rank] - before.searchsorted(pdf[rank].to_numpy())
            return left & (shifted < pool_size(total - len(before), need, share))

        def note():
            taken.loc[[i for i, _ in state.taken]] = True

        for g, budget in budgets.items():
            in_group = pdf[group] == g
            for t, want in even_budgets(budget, topics).items():
                cell = in_group & (pdf[topic] == t) & pdf["__e1"].ge(1) & (pdf["__n_cell"] >= least_cell)
                state.scan(rows(cell, "__h0"), min(want, budget - state.count(group, g)), columns, "topic")
                note()
            short = budget - state.count(group, g)
            if short > 0 and in_group.any():
                total = int(pdf.loc[in_group, "__n_group"].iloc[0])
                state.scan(rows(eligible(in_group & pdf["__in"], "__r_group", total, short), "__h1"), short, columns, "group")
                note()
        short = target - len(state.taken)
        if short > 0 and len(pdf):
            everything = pdf["__e1"] >= 0
            total = int(pdf["__n_quadrant"].iloc[0])
            state.scan(rows(eligible(everything, "__r_quadrant", total, short), "__h2"), short, (source, topic), "final")
        out = pdf.loc[[i for i, _ in state.taken], ["__q", "__tie"]].copy()
        out["stage"] = [s for _, s in state.taken]
        out["place"] = range(len(out))
        return out

    return run


def matched_sample(rows: DataFrame, quadrant: str, source: str, group: str, topic: str, score: str, row_key: str, target: int, shares: dict[str, float], topics: list[str], seed: int,
                   source_cap: float = 0.7, group_cap: float = 0.65, topic_cap: float = 0.5, confident: float = 0.4, least_cell: int = 1) -> DataFrame:
    """At most ``target`` rows of each quadrant with the same shares of source groups: ``rows`` with ``stage`` and ``place``.

    In each quadrant, group by group in the order of ``shares``: each of ``topics`` gets an even part of the group's budget, from the
    eligible rows of its cell (the best ``max(budget, ceil(n * confident))``, in seeded order; cells of fewer than ``least_cell`` rows are
    passed over); what the group still lacks comes from the eligible of its rows that are left, of any topic. At last what
    the quadrant lacks comes from all its rows, of any group. At no time has a source, group or topic more than its cap (a share of
    ``target``, one row at least), but the last step looks away from the group's. Groups outside ``shares`` only take part in the
    last step; rows of other topics, without quadrant or without ``row_key`` never do. Rows without a score rank last;
    equal scores by ``row_key``, which tells rows apart. An empty table gives no rows.
    """
    caps = tuple(max(1, math.floor(target * c)) for c in (source_cap, group_cap, topic_cap))
    budgets = budgets_by_share(target, shares)
    most_cell = max((n for b in budgets.values() for n in even_budgets(b, topics).values()), default=0)
    with scratch(rows.sparkSession) as keep:
        able = rows.where(F.col(topic).isin(topics) & F.col(quadrant).isNotNull() & F.col(row_key).isNotNull()).select(
            F.col(quadrant).alias("__q"), F.col(source).alias("__s"), F.col(group).alias("__g"), F.col(topic).alias("__t"), F.col(row_key).alias("__tie"),
            F.coalesce(-F.col(score).cast("double"), F.lit(float("inf"))).alias("__conf"), *[hash_order(seed + i, row_key).alias(f"__h{i}") for i in range(3)])
        for name, keys in (("cell", ["__q", "__g", "__t"]), ("group", ["__q", "__g"]), ("quadrant", ["__q"])):
            counts = able.groupBy(*keys).agg(F.count("*").alias(f"__n_{name}")).select(*[F.col(k).alias(f"__c{i}") for i, k in enumerate(keys)], f"__n_{name}")
            on = F.lit(True)
            for i, k in enumerate(keys):
                on = on & F.col(k).eqNullSafe(F.col(f"__c{i}"))
            able = ordered(able.join(counts, on).drop(*[f"__c{i}" for i in range(len(keys))]), keys, ["__conf", "__tie"], f"__r_{name}")
        want = F.lit(0)
        for g, b in budgets.items():
            for t, n in even_budgets(b, topics).items():
                want = F.when((F.col("__g") == g) & (F.col("__t") == t), n).otherwise(want)
        edge = lambda n, need: F.when(n <= need, n).otherwise(F.greatest(need, F.ceil(n * confident)))
        budget = F.lit(0)
        for g, b in budgets.items():
            budget = F.when(F.col("__g") == g, b).otherwise(budget)
        able = able.withColumn("__e1", (F.coalesce(F.col("__r_cell") < edge(F.col("__n_cell"), want), F.lit(False)) & (want > 0)).cast("int"))
        able = able.withColumn("__in", F.coalesce(F.col("__g").isin(list(budgets)), F.lit(False)))
        able = materialize(able, "ranked")

        first = _first(able.where("__e1 = 1"), ["__q", "__g", "__t", "__s"], "__h0", min(most_cell, caps[0]))
        parts = [_first(first, ["__q", "__g", "__t"], "__h0", most_cell + target)]
        full = target // caps[0]
        for inside, rank, n, by, order, need, most in (
                (F.col("__in"), F.col("__r_group"), F.col("__n_group"), ["__q", "__g"], "__h1", budget, max(budgets.values(), default=0)),
                (F.lit(True), F.col("__r_quadrant"), F.col("__n_quadrant"), ["__q"], "__h2", F.lit(target), target)):
            low = F.ceil(F.greatest(n - F.lit(target), F.lit(0)) * confident)  # ranks below are eligible whatever was taken
            high = F.greatest(need, F.ceil(n * confident)) + target
            pair = most + target
            sure = _first(able.where(inside & (rank < low)), [*by, "__t", "__s"], order, pair)
            parts += [_first(sure, [*by, "__t"], order, pair + full * pair), able.where(inside & (rank >= low) & (rank < high))]
        pool = parts[0]
        for part in parts[1:]:
            pool = pool.unionByName(part)
        pool = materialize(pool.dropDuplicates(["__tie"]), "pool")
        shape = f"__q {rows.schema[quadrant].dataType.simpleString()}, __tie {rows.schema[row_key].dataType.simpleString()}, stage string, place int"
        taken = pool.groupBy("__q").applyInPandas(_stages(("__s", "__g", "__t"), budgets, topics, target, caps, confident, least_cell), shape)
        taken = keep(materialize(taken.select(F.col("__tie").alias(row_key), "stage", "place"), "matched"))
    return rows.join(taken, row_key)


def _first(rows: DataFrame, by: list[str], order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each group; Spark keeps no more of a task's rows before it shuffles them."""
    rank: Column = F.row_number().over(Window.partitionBy(*by).orderBy(order, "__tie"))
    return rows.withColumn("__rn", rank).where(F.col("__rn") <= most).drop("__rn")
