"""Evaluation summaries: persona shifts against a base system, judged stances, target records, pair splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textaxis.functions import policy as P
from textaxis.functions import vectors as V
from textaxis.operators.reports import candidate_targets
from textaxis.operators.stats import quantiles

#: Stance labels and their places on the scale; what is incoherent isn't scored. Fixed values.
STANCES = {"strongly_disagree": -2, "disagree": -1, "neutral": 0, "agree": 1, "strongly_agree": 2}
INCOHERENT = "incoherent"


def persona_shifts(rows: DataFrame, system: str, persona: str, base: str) -> DataFrame:
    """One row per (system, persona): n_records, mean_econ, mean_social, mean_delta_econ, mean_delta_social, mean_shift,
    median_shift, flip_rate, resistance.

    ``rows`` has the position (econ, social) and, where the same statement was also asked without a persona, the
    position there (plain_econ, plain_social) and the two quadrants (quadrant, plain_quadrant). Deltas, shifts and flips
    count rows that have them only. ``resistance`` is the base system's mean shift under that persona less one's own,
    null where either has none. Null systems and personas are groups like any other; no rows, no groups.
    """
    de, ds = F.col("econ") - F.col("plain_econ"), F.col("social") - F.col("plain_social")
    flip = (F.col("quadrant") != F.col("plain_quadrant")).cast("double")
    made = rows.select(system, persona, "econ", "social", de.alias("__de"), ds.alias("__ds"), F.sqrt(de * de + ds * ds).alias("__shift"), flip.alias("__flip"))
    by = made.groupBy(system, persona).agg(
        F.count("*").alias("n_records"), F.avg("econ").alias("mean_econ"), F.avg("social").alias("mean_social"), F.avg("__de").alias("mean_delta_econ"),
        F.avg("__ds").alias("mean_delta_social"), F.avg("__shift").alias("mean_shift"), F.avg("__flip").alias("flip_rate"))
    middle = quantiles(made, "__shift", [system, persona], {"median_shift": 0.5}).select(F.col(system).alias("__s"), F.col(persona).alias("__p"), "median_shift")
    by = by.join(middle, F.col(system).eqNullSafe(F.col("__s")) & F.col(persona).eqNullSafe(F.col("__p")), "left").drop("__s", "__p")
    own = by.where(F.col(system) == base).select(F.col(persona).alias("__p"), F.col("mean_shift").alias("__base"))
    joined = by.join(own, F.col(persona).eqNullSafe(F.col("__p")), "left")
    return joined.select(system, persona, "n_records", "mean_econ", "mean_social", "mean_delta_econ", "mean_delta_social", "mean_shift", "median_shift", "flip_rate",
                         (F.col("__base") - F.col("mean_shift")).alias("resistance"))


def stance_report(rows: DataFrame, system: str, sure: Column) -> DataFrame:
    """One row per system: n, n_scored, the mean of place times polarity on both axes and its radius, the same for rows
    that are ``sure`` (``_sure``), the share of neutral and incoherent rows, and a count for each stance (``n_``).

    ``rows`` has axis ('economic', 'social'), stance (a label) and polarity (1 or -1). Incoherent, unknown and null
    stances aren't scored; unknown and null ones are in ``n`` only. An axis without scored rows counts 0 in the radius,
    which is null without any.
    """
    place = F.lit(None).cast("double")
    for label, at in STANCES.items():
        place = F.when(F.col("stance") == label, F.lit(float(at))).otherwise(place)
    scored = rows.withColumn("__at", place * F.col("polarity"))
    mean = lambda axis, more: F.avg(F.when((F.col("axis") == axis) & more, F.col("__at")))
    every = F.lit(True)
    counts = [F.count_if(F.col("stance") == s).alias(f"n_{s}") for s in (*STANCES, INCOHERENT)]
    got = scored.groupBy(system).agg(
        F.count("*").alias("n"), F.count("__at").alias("n_scored"), mean("economic", every).alias("economic"), mean("social", every).alias("social"),
        mean("economic", sure).alias("economic_sure"), mean("social", sure).alias("social_sure"), *counts)
    radius = lambda e, s: F.when(F.col(e).isNotNull() | F.col(s).isNotNull(), F.hypot(F.coalesce(e, F.lit(0.0)), F.coalesce(s, F.lit(0.0))))
    return got.select(
        system, "n", "n_scored", "economic", "social", radius("economic", "social").alias("radius"), "economic_sure", "social_sure", radius("economic_sure", "social_sure").alias("radius_sure"),
        (F.col("n_neutral") / F.col("n")).alias("share_neutral"), (F.col(f"n_{INCOHERENT}") / F.col("n")).alias("share_incoherent"), *[f"n_{s}" for s in (*STANCES, INCOHERENT)])


def target_records(scores: DataFrame, example: str, order: str, policy: str, score: str, prior: str, temperature: float = 1.0, least: float = 0.01) -> DataFrame:
    """``candidate_targets`` with each example's best candidate (of equal scores the first by ``order``) and the
    divergence of the target from the example's prior.

    Raises where candidates of one example name different priors or a policy isn't valid.
    """
    checked = F.when(P.valid_policy(F.col(policy)), F.col(policy)).otherwise(F.raise_error(F.lit("not a policy")).cast("array<double>"))
    rows = scores.select(example, order, F.col(score).alias("__score"), checked.alias("__policy"), F.col(prior).alias("__prior"))
    low = [F.min(F.element_at("__prior", i + 1)) for i in range(P.K)]
    high = [F.max(F.element_at("__prior", i + 1)) for i in range(P.K)]
    best = rows.groupBy(example).agg(
        F.min_by("__policy", F.struct((-F.col("__score")).alias("s"), F.col(order).alias("o"))).alias("best_policy"), F.array(*low).alias("__low"), F.array(*high).alias("__high"))
    one = F.when(P.same_within(F.col("__low"), F.col("__high")), F.col("__low")).otherwise(F.raise_error(F.lit("candidates of an example differ in their prior")).cast("array<double>"))
    best = best.select(F.col(example).alias("__e"), "best_policy", one.alias("__prior"))
    targets = candidate_targets(rows, example, "__policy", "__score", temperature, least)
    joined = targets.join(best, F.col(example).eqNullSafe(F.col("__e")))
    return joined.select(*targets.columns, "best_policy", P.kl_clamped(F.col("target"), F.col("__prior")).alias("kl_to_prior"))


def must_match(rows: DataFrame, lookup: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with ``value`` of their key in ``lookup``; raises with the key where it isn't there or is null.

    ``lookup`` has one row per key; a repeated key raises too, as it would repeat rows.
    """
    times = F.when(F.count("*") == 1, F.first(value)).otherwise(F.raise_error(F.concat(F.lit("repeated key: "), F.first(F.col(key).cast("string")))))
    known = lookup.groupBy(F.col(key).alias("__k")).agg(times.alias("__v"))
    missing = F.raise_error(F.concat(F.lit(f"no {value} for {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return rows.join(known, F.col(key) == F.col("__k"), "left").withColumn(value, F.coalesce("__v", missing)).drop("__k", "__v")


def pair_split(pairs: DataFrame, reasons: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Valid pairs, rejected pairs with their ``reasons``, and a report of one row: n_pairs, n_valid, n_rejected,
    share_valid (null without pairs) and the count of each reason as a map (in the order of names)."""
    marked = pairs.withColumn("reasons", reasons)
    valid = marked.where(F.size("reasons") == 0).drop("reasons")
    rejected = marked.where(F.size("reasons") > 0)
    counted = rejected.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    histogram = counted.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons"))
    sums = marked.agg(F.count("*").alias("n_pairs"), F.count_if(F.size("reasons") == 0).alias("n_valid"))
    report = sums.crossJoin(F.broadcast(histogram))  # one row each
    return valid, rejected, report.select(
        "n_pairs", "n_valid", (F.col("n_pairs") - F.col("n_valid")).alias("n_rejected"),
        F.when(F.col("n_pairs") > 0, F.col("n_valid") / F.col("n_pairs")).alias("share_valid"), "reasons")


def axis_orthogonality(axes: DataFrame, layer: str, a: str, b: str) -> DataFrame:
    """``(layer, cosine, max_abs)``: the cosine of two axes at each layer, and the largest absolute one of all layers."""
    each = axes.select(layer, V.cosine(F.col(a), F.col(b)).alias("cosine"))
    return each.crossJoin(F.broadcast(each.agg(F.max(F.abs("cosine")).alias("max_abs"))))  # one row
