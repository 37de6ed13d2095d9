"""Dense positions and running sums per key without gathering a key's rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textaxis.session import materialize

SALTS = 1024


def keyed_offsets(df: DataFrame, keys: list[str], order: list[str], weight: str | None = None, out: str = "slot",
                  salts: int = SALTS, salt: Column | None = None) -> DataFrame:
    """Add ``out``: the sum of ``weight`` (1 if none) over the key's earlier rows, gapless from 0.

    Rows are dealt by (keys, salt), the salt a hash of ``order``; a salt's rows follow those of all smaller salts, so
    only one small total per (key, salt) has to be summed up per key. ``order`` must identify a row for a
    repeatable result; rows equal in it are in an arbitrary but gapless order. Null keys form a key of their own.
    ``salt`` (a long that never falls along ``order``) makes the offsets those of the one order over all rows.
    """
    w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    dealt = F.pmod(F.xxhash64(*order), F.lit(salts)) if salt is None else salt
    salted = df.withColumn("__salt", dealt.cast("long")).withColumn("__w", w)
    totals = salted.groupBy(*keys, "__salt").agg(F.sum("__w").alias("__t"))
    before = Window.partitionBy(*keys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__salt").alias("__s"),
        F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__base"),
    )
    on = F.col("__salt") == F.col("__s")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy(*keys, "__salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = salted.withColumn("__in", F.coalesce(F.sum("__w").over(inside), F.lit(0)))
    return (
        placed.join(totals, on).withColumn(out, (F.col("__base") + F.col("__in")).cast("long"))
        .drop("__salt", "__s", "__base", "__in", "__w", *[f"__k{i}" for i in range(len(keys))])
    )


def hash_salt(hashed: str, digits: int = 3) -> Column:
    """A salt along the order of a column of hexadecimal hashes."""
    return F.conv(F.substring(hashed, 1, digits), 16, 10).cast("long")


def ordered_parts(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``__part``, written once: ranges along (keys, order) of about equal numbers of rows, cut where a sample
    says, so a key with a third of all rows lies in many parts. Parts rise along the order; null keys and values come
    first. Rows equal in all of ``order`` share a part, so the last of ``order`` should tell rows apart where ties are many. The
    table belongs to the caller's scope (``session.scratch``).
    """
    return materialize(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "ranges")


def ordered(df: DataFrame, keys: list[str], order: list[str], out: str = "slot", weight: str | None = None) -> DataFrame:
    """Add ``out``: the sum of ``weight`` (1 if none) over the key's earlier rows along ``order``.

    A range shuffle puts the rows in order; sums are carried from part to part, one number for each part in which a key
    goes on, so no task holds a key. Null weights count 0. Null keys form a key of their own. ``order`` must tell a
    key's rows apart for a repeatable result.
    """
    w = F.lit(1).cast("long") if weight is None else F.coalesce(F.col(weight), F.lit(0))
    parts = ordered_parts(df.withColumn("__ord_weight", w), keys, order)
    totals = parts.groupBy(*keys, "__part").agg(F.sum("__ord_weight").alias("__ord_total"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__ord_at"), F.sum("__ord_total").over(before).alias("__ord_base"))
    carried = carried.where("__ord_base is not null")  # at most one key of a part goes on from another
    on = F.col("__part") == F.col("__ord_at")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.join(F.broadcast(carried), on, "left").withColumn("__ord_inside", F.coalesce(F.sum("__ord_weight").over(inside), F.lit(0)))
    total = F.coalesce("__ord_base", F.lit(0)) + F.col("__ord_inside")
    return placed.withColumn(out, total.cast("long") if weight is None else total).drop("__ord_weight", "__part", "__ord_at", "__ord_base", "__ord_inside", *[f"__k{i}" for i in range(len(keys))])


def numbered(df: DataFrame, order: str, out: str = "slot") -> DataFrame:
    """``df`` with each row's number from 0 along a column of distinct values."""
    return ordered(df, [], [order], out)


def average_ranks(rows: DataFrame, x: str, by: list[str], out: str, stored: bool = False) -> DataFrame:
    """Add ``out``: each row's rank from 1 inside its group, ties averaged; nulls come first, as ties of one another.

    Only the counts of distinct values are put in order, so however many rows share a value, they are one row there. Ranks meet
    the rows by value, so ``rows`` are written once first: sums of doubles can differ in their last bits when they are computed
    again. ``stored``: they come from written tables already.
    """
    rows = rows if stored else materialize(rows, "ranked")
    values = rows.groupBy(*by, x).agg(F.count("*").alias("__n"))
    placed = ordered(values, by, [x], "__before", "__n")
    names = [*by, x]
    ranks = placed.select(*[F.col(c).alias(f"__v{i}") for i, c in enumerate(names)], (F.col("__before") + (F.col("__n") + 1) / 2).alias(out))
    on = F.lit(True)
    for i, c in enumerate(names):
        on = on & F.col(c).eqNullSafe(F.col(f"__v{i}"))
    return rows.join(ranks, on).drop(*[f"__v{i}" for i in range(len(names))])
