"""Statistics: ranks, correlation, AUC, separation, permutation and bootstrap nulls, centre validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textaxis.operators.corpus import hash_order
from textaxis.operators.ranking import average_ranks, numbered, ordered
from textaxis.operators.resampling import bootstrap_moments


def mean_or_zero(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def population_std(x: Column) -> Column:
    """0 below two values."""
    return F.coalesce(F.stddev_pop(x), F.lit(0.0))


def sample_std(x: Column) -> Column:
    """0 below two values."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def percentile_pack(x: Column) -> list[Column]:
    """mean, min, p10, p25, median, p75, p90, max with linear interpolation. Exact percentiles hold a group's distinct
    values in one task; ``quantiles`` doesn't."""
    q = lambda p, name: F.percentile(x, p).alias(name)
    return [F.avg(x).alias("mean"), F.min(x).alias("min"), q(0.1, "p10"), q(0.25, "p25"), q(0.5, "median"), q(0.75, "p75"), q(0.9, "p90"), F.max(x).alias("max")]


def quantiles(rows: DataFrame, x: str, by: list[str], at: dict[str, float]) -> DataFrame:
    """``(by, n, mean, min, max)`` and a column for each named quantile, exact with linear interpolation; nulls of ``x`` are left out.

    Distinct values are counted and put in order with carried counts; a quantile lies where the running count passes its
    place. No task holds a group. Groups without values have no row.
    """
    values = rows.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("__c"))
    sums = values.groupBy(*by).agg(F.sum("__c").alias("n"), F.sum(F.col(x).cast("double") * F.col("__c")).alias("__s"), F.min(x).alias("min"), F.max(x).alias("max"))
    placed = _joined(ordered(values, by, [x], "__b", "__c"), sums.select(*by, F.col("n").alias("__n")), by)
    ends = []
    for i, p in enumerate(at.values()):
        place = (F.col("__n") - 1) * F.lit(float(p))
        for end, f in (("lo", F.floor), ("hi", F.ceil)):
            inside = (f(place) >= F.col("__b")) & (f(place) < F.col("__b") + F.col("__c"))
            ends.append(F.max(F.when(inside, F.col(x).cast("double"))).alias(f"__{end}{i}"))
    got = _joined(placed.groupBy(*by).agg(*ends), sums, by)
    between = lambda i, p: F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * ((F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p))))
    return got.select(*by, "n", (F.col("__s") / F.col("n")).alias("mean"), "min", *[between(i, p).alias(c) for i, (c, p) in enumerate(at.items())], "max")


def _joined(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Each row with its group's columns; null keys equal one another; without keys, ``groups`` has one row."""
    if not by:
        return rows.crossJoin(F.broadcast(groups))
    named = groups.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], *[c for c in groups.columns if c not in by])
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    return rows.join(named, on).drop(*[f"__g{i}" for i in range(len(by))])


def correlations(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Pearson and Spearman by group; rows with a null on either side are left out."""
    able = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranked = average_ranks(average_ranks(able, x, by, "__rx"), y, by, "__ry", stored=True)
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.corr("__rx", "__ry").alias("spearman"))


def correlation_matrix(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """``(by, x, y, n, pearson, spearman)`` of every two of ``columns``, in the given order, a column with itself included.

    Rows with a null in any of them are left out. Each column is ranked once; all pairs come from one aggregate.
    """
    able = rows.dropna(subset=columns).select(*by, *columns)
    for i, c in enumerate(columns):
        able = average_ranks(able, c, by, f"__r{i}", stored=i > 0)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = [f(a, b).alias(f"__{n}{i}_{j}") for i, j in pairs for n, f, a, b in (("p", F.corr, columns[i], columns[j]), ("s", F.corr, f"__r{i}", f"__r{j}"))]
    got = able.groupBy(*by).agg(F.count("*").alias("n"), *sums)
    cells = F.array(*[F.struct(F.lit(columns[i]).alias("x"), F.lit(columns[j]).alias("y"), F.col("n"), F.col(f"__p{i}_{j}").alias("pearson"), F.col(f"__s{i}_{j}").alias("spearman")) for i, j in pairs])
    return got.select(*by, F.inline(cells))


def auc(rows: DataFrame, score: str, positive: str, by: list[str]) -> DataFrame:
    """Area under the ROC curve, ties one half; null where a class is missing. Rows of no class don't count.

    Counts of distinct scores are put in order; each positive beats the negatives before it.
    """
    p = F.col(positive)
    values = rows.groupBy(*by, score).agg(F.count_if(p).alias("__p"), F.count_if(~p).alias("__n"))
    placed = ordered(values, by, [score], "__before", "__n")
    got = placed.groupBy(*by).agg(F.sum(F.col("__p") * (F.col("__before") + F.col("__n") / 2)).alias("__s"), F.sum("__p").alias("n_pos"), F.sum("__n").alias("n_neg"))
    area = F.col("__s") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))
    return got.select(*by, "n_pos", "n_neg", area.alias("auc"))


def separation(x: Column, positive: Column) -> list[Column]:
    """Population separation |mean difference| / sqrt(max(mean variance, 1e-12)), and signed Cohen's d (sample)."""
    p, n = F.when(positive, x), F.when(~positive, x)
    pooled = F.sqrt(F.greatest((F.var_pop(p) + F.var_pop(n)) / 2, F.lit(1e-12)))
    d = (F.avg(p) - F.avg(n)) / (F.sqrt((F.var_samp(p) + F.var_samp(n)) / 2) + 1e-12)
    return [(F.abs(F.avg(p) - F.avg(n)) / pooled).alias("separation"), d.alias("cohens_d")]


def z_scores(rows: DataFrame, x: str, by: list[str], population: bool, out: str = "z") -> DataFrame:
    """Population z-scores (zeros under 1e-8) or sample z-scores (zeros at 0); moments come from one aggregate."""
    moments = rows.groupBy(*by).agg(F.avg(x).alias("__m"), (F.stddev_pop if population else F.stddev_samp)(x).alias("__sd"))
    flat = F.coalesce("__sd", F.lit(0.0)) < 1e-8 if population else F.coalesce("__sd", F.lit(0.0)) == 0
    return _joined(rows, moments, by).withColumn(out, F.when(flat, 0.0).otherwise((F.col(x) - F.col("__m")) / F.col("__sd"))).drop("__m", "__sd")


def split_half(rows: DataFrame, entity: str, row_key: str, x: str, seed: int) -> DataFrame:
    """Correlation of the entities' half means and its Spearman-Brown correction; entities with one row are left out."""
    w = Window.partitionBy(entity)
    halved = rows.withColumn("__rn", F.row_number().over(w.orderBy(hash_order(seed, row_key), row_key))).withColumn("__n", F.count("*").over(w))
    first = F.col("__rn") <= F.floor(F.col("__n") / 2)
    means = halved.where("__n > 1").groupBy(entity).agg(F.avg(F.when(first, F.col(x))).alias("a"), F.avg(F.when(~first, F.col(x))).alias("b"))
    r = F.corr("a", "b")
    return means.agg(F.count("*").alias("n"), r.alias("half"), (2 * r / (1 + r)).alias("reliability"))


def permutation_p(rows: DataFrame, x: str, y: str, row_key: str, reps: int, seed: int) -> DataFrame:
    """Two-sided permutation p-value of a Spearman correlation, (hits + 1) / (reps + 1), of a short table of entities.

    Each repetition re-pairs the rows by a seeded order of hashes, as one equi-join on (repetition, place): reps * n
    rows, n of them in a task. Tables of items go through ``resampling.permutation_test``.
    """
    ranked = average_ranks(average_ranks(rows.select(row_key, x, y), x, [], "__rx"), y, [], "__ry", stored=True).select(row_key, "__rx", "__ry")
    seen = ranked.agg(F.corr("__rx", "__ry").alias("r"), F.count("*").alias("n"))
    rep = rows.sparkSession.range(reps).select(F.col("id").alias("rep"))
    placed = numbered(ranked, row_key, "place").withColumn("place", F.col("place") + 1)
    mixed = placed.select("__ry", row_key).join(F.broadcast(rep))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col(row_key).cast("string")))
    mixed = mixed.withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy(order, row_key)))
    null = placed.select("place", "__rx").join(mixed, "place").groupBy("rep").agg(F.corr("__rx", "__ry").alias("null_r"))
    return null.join(F.broadcast(seen)).agg(
        F.first("n").alias("n"), F.first("r").alias("spearman"), ((F.count_if(F.abs("null_r") >= F.abs("r") - 1e-12) + 1) / (F.lit(reps) + 1)).alias("p"))


def bootstrap_se(rows: DataFrame, x: str, row_key: str, reps: int, seed: int) -> DataFrame:
    """Mean and bootstrap standard error of the mean, of a short table of entities: each repetition draws n places by
    hash, reps * n rows in all. Tables of items go through ``resampling.bootstrap_moments``."""
    placed = numbered(rows.select(row_key, x), row_key, "place").select("place", x)
    n = rows.agg(F.count("*").alias("n"))
    draws = rows.sparkSession.range(reps).select(F.col("id").alias("rep")).join(placed.select("place").join(F.broadcast(n)))
    pick = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("place").cast("string"))), 1, 12), 16, 10).cast("long"), F.col("n"))
    means = draws.select("rep", pick.alias("place")).join(placed, "place").groupBy("rep").agg(F.avg(x).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("se"))


def validate_center(rows: DataFrame, polarity: DataFrame, category: str, axes: tuple[str, str], limit: float = 2.5, tolerance: tuple[float, float] = (0.5, 0.15)) -> DataFrame:
    """Centre of neutral items by axis after removing outliers on either axis, with its checks, one row per axis.

    ``polarity`` holds charged items: ``axis``, ``positive`` (boolean) and ``x``. Outlier: a sample z-score over
    ``limit``. Checks: the first two categories' centres differ by at most ``tolerance[0]`` standard deviations; the
    centre is off the midpoint of the two polarity groups' means by at most ``tolerance[1]`` of their spread.
    ``passed``: both of these checks on both axes; ``center_verdict`` has all four. A polarity group without items has mean 0. Means and deviations come from one
    aggregate that is broadcast as its one row.
    """
    moments = rows.agg(*[f(a).alias(f"__{n}_{a}") for a in axes for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    out = F.lit(False)
    for a in axes:
        sd = F.coalesce(F.col(f"__s_{a}"), F.lit(0.0))
        out = out | ((sd != 0) & F.coalesce(F.abs(F.col(a) - F.col(f"__m_{a}")) > limit * sd, F.lit(False)))
    placed = rows.crossJoin(F.broadcast(moments)).withColumn("__out", out)
    long = placed.select(category, "__out", F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("x")) for a in axes])))
    kept = F.when(~F.col("__out"), F.col("x"))
    by_category = long.where("not __out").groupBy("axis", category).agg(F.avg("x").alias("m"))
    first_two = by_category.groupBy("axis").agg(F.slice(F.array_sort(F.collect_list(F.struct(category, "m"))), 1, 2).alias("two"))  # one entry per category
    by = long.groupBy("axis").agg(F.count("*").alias("n_raw"), F.count_if("__out").alias("n_outliers"), F.avg(kept).alias("center"), sample_std(kept).alias("sd"))
    groups = polarity.groupBy("axis").agg(mean_or_zero(F.when(F.col("positive"), F.col("x"))).alias("__p"), mean_or_zero(F.when(~F.col("positive"), F.col("x"))).alias("__n"))
    off = F.abs(F.col("center") - (F.col("__p") + F.col("__n")) / 2) / (F.abs(F.col("__p") - F.col("__n")) + 1e-12)
    agree = F.coalesce(F.abs(F.col("two")[0]["m"] - F.get("two", F.lit(1))["m"]) <= tolerance[0] * F.col("sd"), F.lit(True))
    checked = by.join(first_two, "axis").join(groups, "axis", "left").select(
        "axis", "n_raw", "n_outliers", "center", "sd", (F.col("__p") - F.col("__n")).alias("charged_spread"), off.alias("midpoint_ratio"), agree.alias("categories_agree"),
        F.coalesce(off <= tolerance[1], F.lit(False)).alias("midpoint_ok"))
    whole = checked.agg(F.every(F.col("categories_agree") & F.col("midpoint_ok")).alias("passed"))
    return checked.crossJoin(F.broadcast(whole))


def center_verdict(rows: DataFrame, polarity: DataFrame, category: str, axes: tuple[str, str], row_key: str, reps: int = 1000, seed: int = 42,
                   limit: float = 2.5, tolerance: tuple[float, float, float] = (0.5, 0.15, 0.05)) -> DataFrame:
    """All four checks of a centre of neutral items in one verdict, one row per axis.

    To ``validate_center``'s columns come ``no_outliers`` (none on either axis), ``bootstrap_se`` of the centre over ``reps``
    resamples of the items that are left, its ``se_ratio`` to the charged spread, ``stable`` (at most ``tolerance[2]``), and
    ``all_passed``: no outlier, categories agree, centre near the midpoint, stable, on both axes. ``row_key`` is a long
    that tells items apart.
    """
    checked = validate_center(rows, polarity, category, axes, limit, tolerance[:2])
    kept = rows.select(row_key, *axes)
    for i, a in enumerate(axes):
        kept = z_scores(kept, a, [], False, f"__z{i}")
    kept = kept.where(" and ".join(f"coalesce(abs(__z{i}) <= {limit}, true)" for i in range(len(axes))))
    se = bootstrap_moments(kept, list(axes), row_key, reps, seed).select(F.col("x").alias("axis"), F.col("se").alias("bootstrap_se"))
    ratio = F.coalesce("bootstrap_se", F.lit(0.0)) / (F.abs("charged_spread") + 1e-12)
    got = checked.drop("passed").join(F.broadcast(se), "axis", "left").withColumn("se_ratio", ratio).withColumn("stable", F.col("se_ratio") <= tolerance[2]).withColumn("no_outliers", F.col("n_outliers") == 0)
    whole = got.agg(F.every(F.col("no_outliers") & F.col("categories_agree") & F.col("midpoint_ok") & F.col("stable")).alias("all_passed"))
    return got.crossJoin(F.broadcast(whole))
