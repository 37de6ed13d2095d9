"""Roll-ups, evaluation summaries and data-quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textaxis.functions import policy as P
from textaxis.operators.stats import mean_or_zero, population_std


class GateError(RuntimeError):
    """A data-quality check failed; nothing was written."""


def document_rollup(chunks: DataFrame, doc: str, index: str) -> DataFrame:
    """Per document: chunks, mean and population std of both scores, quadrant counts, first and dominant quadrant.

    The dominant quadrant is the most frequent, ties to the one that comes first in the document.
    """
    cells = chunks.groupBy(doc, "quadrant").agg(
        F.count("*").alias("n"), F.min(index).alias("__first"), F.sum("score_econ").alias("se"), F.sum("score_soc").alias("ss"))
    base = chunks.groupBy(doc).agg(
        F.count("*").alias("n_chunks"), mean_or_zero(F.col("score_econ")).alias("mean_econ"), mean_or_zero(F.col("score_soc")).alias("mean_soc"),
        population_std(F.col("score_econ")).alias("std_econ"), population_std(F.col("score_soc")).alias("std_soc"),
        F.min_by("quadrant", index).alias("first_quadrant"))
    tops = cells.groupBy(doc).agg(
        F.max_by("quadrant", F.struct("n", -F.col("__first"))).alias("dominant_quadrant"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("quadrant", "n")))).alias("quadrant_counts"))
    return base.join(tops, doc)


def nested_shares(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts and shares of ``inner`` inside each ``outer``, nulls as 'unlabeled'."""
    counted = rows.withColumn(inner, F.coalesce(inner, F.lit("unlabeled"))).groupBy(outer, inner).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(outer)))


def cell_diagnostics(rows: DataFrame, base: str, a: str, b: str, c: str) -> DataFrame:
    """Counts by (base, a, b) and by (base, a, c) in one pass of grouping sets."""
    return (
        rows.groupingSets([[F.col(base), F.col(a), F.col(b)], [F.col(base), F.col(a), F.col(c)]], base, a, b, c)
        .agg(F.count("*").alias("n"), F.grouping_id().alias("set"))
    )


def pivot_with_totals(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts pivoted over ``values``, zero filled, with a total column and a 'total' row."""
    wide = rows.where(F.col(column).isin(*values)).groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0, values)
    total = F.lit(0)
    for v in values:
        total = total + F.col(f"`{v}`")
    wide = wide.withColumn(row, F.col(row).cast("string")).withColumn("total", total.cast("long"))
    bottom = wide.agg(*[F.sum(f"`{c}`").alias(c) for c in [*values, "total"]]).withColumn(row, F.lit("total"))
    return wide.unionByName(bottom.select(*wide.columns))


def pivot_statistics(rows: DataFrame, row: str, column: str, values: list[str], x: str) -> DataFrame:
    """Mean and median of ``x`` pivoted over ``values``: columns ``<value>_mean`` and ``<value>_median``, null where a cell has no
    value, with a last row 'total' over all of ``rows`` in ``values``. One row for each value of ``row``.

    Medians come from carried counts of distinct values (``stats.quantiles``), so no task holds a cell.
    """
    from textaxis.operators.stats import quantiles

    able = rows.where(F.col(column).isin(*values)).select(F.col(row).cast("string").alias(row), column, x)
    both = able.unionByName(able.withColumn(row, F.lit("total")))
    cells = quantiles(both, x, [row, column], {"median": 0.5})
    return cells.groupBy(row).pivot(column, values).agg(F.first("mean").alias("mean"), F.first("median").alias("median"))


def summary_sets(rows: DataFrame, keys: list[str], measures: list[Column]) -> DataFrame:
    """The same measures overall and by each key alone: grouping sets with a column that names the set."""
    sets = [[]] + [[F.col(k)] for k in keys]
    named = F.lit("overall")
    for k in keys:
        named = F.when(F.grouping(k) == 0, F.lit(k)).otherwise(named)
    return rows.groupingSets(sets, *keys).agg(named.alias("by"), *measures)


def dominance(rows: DataFrame, cell: list[str], key: str, share: float = 0.8) -> DataFrame:
    """Cells where one key holds more than ``share`` of the rows, with that key."""
    counted = rows.groupBy(*cell, key).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*cell)
    top = counted.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("__rn", F.row_number().over(w.orderBy(F.desc("n"), key)))
    return top.where((F.col("__rn") == 1) & (F.col("share") > share)).drop("__rn")


# -- evaluation ------------------------------------------------------------------------------------------------------


def both_orders(first: Column, second: Column) -> Column:
    """A verdict free of position bias: a side wins only if both orders name it, else tie."""
    return F.when((first == second) & first.isin("A", "B"), first).otherwise("tie")


def win_rates(verdicts: DataFrame, criteria: list[str]) -> DataFrame:
    """Per criterion wins, ties, rates and the share of consistent orders; columns are <criterion>_1 and <criterion>_2."""
    parts = [F.struct(F.lit(c).alias("criterion"), both_orders(F.col(f"{c}_1"), F.col(f"{c}_2")).alias("winner"), (F.col(f"{c}_1") == F.col(f"{c}_2")).alias("same")) for c in criteria]
    long = verdicts.select(F.inline(F.array(*parts)))
    return long.groupBy("criterion").agg(
        F.count("*").alias("n"), F.count_if(F.col("winner") == "A").alias("wins_a"), F.count_if(F.col("winner") == "B").alias("wins_b"),
        F.count_if(F.col("winner") == "tie").alias("ties"), F.avg((F.col("winner") == "A").cast("double")).alias("rate_a"), F.avg(F.col("same").cast("double")).alias("consistent"))


def paired_delta(rows: DataFrame, key: str, system: str, value: str, baseline: str, treatment: str) -> DataFrame:
    """Mean, median and reduced share of treatment minus baseline over keys that have both."""
    a = rows.where(F.col(system) == baseline).groupBy(key).agg(F.avg(value).alias("__a"))
    b = rows.where(F.col(system) == treatment).groupBy(key).agg(F.avg(value).alias("__b"))
    d = a.join(b, key).select((F.col("__b") - F.col("__a")).alias("d"))
    return d.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.percentile("d", 0.5).alias("median"), F.avg((F.col("d") < 0).cast("double")).alias("reduced"))


def mean_of_means(rows: DataFrame, model: str, prompt: str, x: str, y: str) -> DataFrame:
    """Centroid per prompt, then the mean of centroids per model, with the spread of the centroids."""
    by = rows.groupBy(model, prompt).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"))
    return by.groupBy(model).agg(F.count("*").alias("n_prompts"), F.avg("cx").alias("x"), F.avg("cy").alias("y"), population_std(F.col("cx")).alias("sx"), population_std(F.col("cy")).alias("sy"))


def reason_join(left: DataFrame, right: DataFrame, key: str, same: list[str]) -> DataFrame:
    """Full outer join with the reason why a key can't be used: no left row, no right row, or differing columns."""
    a = left.select(F.col(key).alias("__k"), *[F.col(c).alias(f"l_{c}") for c in same], F.lit(True).alias("__l"))
    b = right.select(F.col(key).alias("__j"), *[F.col(c).alias(f"r_{c}") for c in same], F.lit(True).alias("__r"))
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
    reason = F.when(F.col("__l").isNull(), "no_left").when(F.col("__r").isNull(), "no_right").when(differs, "mismatch").otherwise("ok")
    return a.join(b, F.col("__k") == F.col("__j"), "full_outer").select(F.coalesce("__k", "__j").alias(key), reason.alias("reason"))


def unique_match(left: DataFrame, right: DataFrame, unit: list[str], tie: str, left_key: str, right_key: str) -> DataFrame:
    """Left rows with their only match on ``unit``; where there are several, with the only one that agrees on ``tie``.
    A left row without a unique match is left out."""
    cand = left.select(left_key, *unit, F.col(tie).alias("__lt")).join(right.select(right_key, *unit, F.col(tie).alias("__rt")), unit)
    w = Window.partitionBy(left_key)
    cand = cand.withColumn("__n", F.count("*").over(w)).withColumn("__same", F.col("__lt") == F.col("__rt"))
    cand = cand.withColumn("__m", F.count_if("__same").over(w))
    kept = cand.where((F.col("__n") == 1) | (F.col("__same") & (F.col("__m") == 1)))
    return kept.select(left_key, right_key, F.when(F.col("__n") == 1, "unit").otherwise("tie").alias("matched_by"))


def candidate_targets(scores: DataFrame, example: str, policy: str, score: str, temperature: float = 1.0, least: float = 0.01) -> DataFrame:
    """Per example the softmax-weighted mixture of its candidates' policies, floored, with its entropy and size and the
    best score."""
    w = Window.partitionBy(example)
    weighed = scores.withColumn("__e", F.exp((F.col(score) - F.max(score).over(w)) / temperature))
    parts = [(F.sum(F.col("__e") * F.element_at(policy, i + 1)) / F.sum("__e")) for i in range(P.K)]
    mixed = weighed.groupBy(example).agg(F.count("*").alias("n_candidates"), F.max(score).alias("best_score"), F.array(*parts).alias("__p"))
    target = P.floored(F.col("__p"), least)
    return mixed.withColumn("target", target).withColumn("entropy", P.entropy(F.col("target"))).drop("__p")


def target_report(targets: DataFrame, prior: Column) -> DataFrame:
    """Means over the rows of ``candidate_targets``: candidates, best score, entropy, divergence from the prior."""
    kl = P.kl_clamped(F.col("target"), prior)
    return targets.agg(F.count("*").alias("n_records"), F.avg("n_candidates").alias("mean_candidates"), F.avg("best_score").alias("mean_best"),
                       F.avg("entropy").alias("mean_entropy"), F.avg(kl).alias("mean_kl"))


def split_summary(rows: DataFrame, by: list[str], dimensions: list[str]) -> DataFrame:
    """Per ``by``: rows, mean tokens (3 digits), mean margin and scores (6 digits), and counts of each of ``dimensions``
    as a map (null as 'unlabeled'). Rows have n_tokens, margin, score_econ and score_soc."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("n_tokens"), 3).alias("mean_tokens"),
                                *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("margin", "score_econ", "score_soc")])
    for d in dimensions:
        counted = rows.groupBy(*by, F.coalesce(d, F.lit("unlabeled")).alias("__d")).agg(F.count("*").alias("__c"))
        maps = counted.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__d", "__c")))).alias(f"{d}_counts"))
        out = out.join(maps, by)
    return out


def stance_summary(rows: DataFrame, by: str) -> DataFrame:
    """Mean stance times polarity by axis, and the radius over both axes (columns: axis, stance -2..2, polarity)."""
    axis = rows.groupBy(by, "axis").agg(F.avg(F.col("stance") * F.col("polarity")).alias("m"), F.count("*").alias("n"))
    return axis.groupBy(by).agg(F.sum("n").alias("n_scored"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("radius"))


# -- gates -----------------------------------------------------------------------------------------------------------


def checks(train: DataFrame, validation: dict[str, DataFrame], expected: list[str], held_topic: str | None = None, held_source: str | None = None,
           max_cell: int = 250, source_cap: float = 0.7, topic_cap: float = 0.5, kl_cap: float = 8.0, length_ratio: float = 3.0,
           margin_ratio: float = 2.5, least: int = 15, group: str | None = None, group_cap: float | None = None, group_gap: float | None = None) -> DataFrame:
    """One row per check: ``check_name, value, bound, passed``.

    Rows have quadrant, source, topic, document_id, n_tokens and margin. ``validation`` holds the splits val_indist,
    val_source and val_topic, or some of them; ``expected`` the quadrants that every split must hold. ``group`` names a
    column of source groups: no group may have more than ``group_cap`` of a quadrant, nor shares of two expected
    quadrants that differ by more than ``group_gap`` (a quadrant without the group has share 0).
    """
    out: list[DataFrame] = []

    def row(name: str, df: DataFrame, value: Column, bound: float, ok: Column) -> None:
        out.append(df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("check_name"), "value", F.lit(float(bound)).alias("bound"), F.coalesce(ok, F.lit(True)).alias("passed")))

    top = F.max("x")
    v = F.col("value")
    cells = train.groupBy("quadrant", "source", "topic").agg(F.count("*").alias("x"))
    row("MAX_CELL_SIZE", cells, top, max_cell, v <= max_cell)
    for name, key, cap in (("SOURCE_CAP", "source", source_cap), ("TOPIC_CAP", "topic", topic_cap)):
        by = train.groupBy("quadrant", key).agg(F.count("*").alias("n"))
        share = by.select((F.col("n") / F.sum("n").over(Window.partitionBy("quadrant"))).alias("x"))
        row(name, share, top, cap, v <= cap)
    if group is not None:
        by = train.groupBy("quadrant", group).agg(F.count("*").alias("n"))
        share = by.withColumn("x", F.col("n") / F.sum("n").over(Window.partitionBy("quadrant")))
        if group_cap is not None:
            row("SOURCE_GROUP_CAP", share, top, group_cap, v <= group_cap)
        if group_gap is not None:
            low = F.when(F.count("*") < len(expected), 0.0).otherwise(F.min("x"))
            row("SOURCE_GROUP_ALIGNMENT", share.groupBy(group).agg((F.max("x") - low).alias("x")), top, group_gap, v <= group_gap)
    row("TOPIC_KL", topic_divergence(train), F.max("kl"), kl_cap, v <= kl_cap)
    for name, of, cap in (("LENGTH_RATIO", "n_tokens", length_ratio), ("CONF_MARGIN_RATIO", "margin", margin_ratio)):
        means = train.groupBy("quadrant").agg(F.avg(of).alias("x"))
        row(name, means, F.max("x") / F.greatest(F.min("x"), F.lit(1e-9)), cap, v <= cap)
    for split, rows in validation.items():
        leaked = rows.select("document_id").distinct().join(train.select("document_id").distinct(), "document_id", "left_semi")
        row(f"NO_DOC_LEAKAGE:{split}", leaked, F.count("*"), 0, v == 0)
    if held_topic is not None and "val_topic" in validation:
        row("VAL_TOPIC_PURITY", validation["val_topic"], F.count_if(~F.col("topic").eqNullSafe(F.lit(held_topic))), 0, v == 0)
    if held_source is not None and "val_source" in validation:
        row("VAL_SOURCE_PURITY", validation["val_source"], F.count_if(~F.col("source").eqNullSafe(F.lit(held_source))), 0, v == 0)
    wanted = train.sparkSession.createDataFrame([(q,) for q in expected], "quadrant string")
    for split, rows in {"train": train, **validation}.items():
        sizes = wanted.join(rows.groupBy("quadrant").agg(F.count("*").alias("x")), "quadrant", "left").na.fill(0, ["x"])
        row(f"NON_EMPTY:{split}", sizes, F.min("x"), least, v >= least)
    got = out[0]
    for df in out[1:]:
        got = got.unionByName(df)
    return got


def topic_divergence(rows: DataFrame, epsilon: float = 1e-9) -> DataFrame:
    """``(a, b, kl)``: KL of the topic shares of each ordered pair of quadrants a < b, epsilon inside the logarithm."""
    counted = rows.groupBy("quadrant", "topic").agg(F.count("*").alias("n"))
    quads, topics = counted.select("quadrant").distinct(), counted.select("topic").distinct()
    grid = quads.join(F.broadcast(topics)).join(counted, ["quadrant", "topic"], "left").na.fill(0, ["n"])  # four by the topics
    share = grid.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("quadrant")))
    a = share.select(F.col("quadrant").alias("a"), "topic", F.col("p").alias("pa"))
    b = share.select(F.col("quadrant").alias("b"), "topic", F.col("p").alias("pb"))
    return a.join(b, "topic").where("a < b").groupBy("a", "b").agg(F.sum(F.col("pa") * F.log((F.col("pa") + epsilon) / (F.col("pb") + epsilon))).alias("kl"))


def gate(report: DataFrame) -> DataFrame:
    """The report if all its checks passed; else raises with the names of those that didn't (a few dozen at most)."""
    failed = [r["check_name"] for r in report.where(~F.col("passed")).select("check_name").collect()]
    if failed:
        raise GateError(", ".join(sorted(failed)))
    return report


def record_violations(records: DataFrame, key: str, scores: str, target: str, reference: str, rows: int) -> DataFrame:
    """``(key, violation)`` of router records: missing fields, bad policy, non-finite score, repeated id, bad reference."""
    ref = F.substring_index(F.col(reference), ":", -1).try_cast("long")
    bad_score = F.exists(F.col(scores), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    found = F.array_compact(F.array(
        F.when(F.col(key).isNull() | F.col(scores).isNull() | F.col(target).isNull(), "missing_field"), F.when(~P.valid_policy(F.col(target)), "bad_policy"),
        F.when(bad_score, "bad_score"), F.when(ref.isNull() | (ref < 0) | (ref >= rows), "bad_reference"), F.when(F.count("*").over(Window.partitionBy(key)) > 1, "repeated_id")))
    return records.withColumn("__v", found).select(key, F.explode("__v").alias("violation"))


def pair_reasons(a: Column, b: Column, axis: Column, ratio: float = 2.0) -> Column:
    """All reasons to reject a contrast pair; a missing field is the only one where it holds."""
    from textaxis.functions.text import match_key, strip, word_count

    na, nb = word_count(a), word_count(b)
    longer = F.greatest(na, nb) / F.greatest(F.least(na, nb), F.lit(1))
    rest = F.array_compact(F.array(
        F.when(~axis.isin("economic", "social"), "invalid_axis"), F.when((strip(a) == "") | (strip(b) == ""), "empty_text"), F.when(a == b, "identical_exact"),
        F.when((a != b) & (match_key(a) == match_key(b)), "identical_normalized"), F.when(longer > ratio, "length_ratio")))
    return F.when(a.isNull() | b.isNull() | axis.isNull(), F.array(F.lit("missing_field"))).otherwise(rest)
