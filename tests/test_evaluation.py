"""Evaluation summaries: missing values, empty tables, and what has to raise."""

import math
import statistics

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from textaxis.functions import policy as P
from textaxis.functions import text as X
from textaxis.functions import vectors as V
from textaxis.operators import axes as A
from textaxis.operators import evaluation as E

SHIFTS = "system string, persona string, econ double, social double, plain_econ double, plain_social double, quadrant string, plain_quadrant string, n_records int"


def test_persona_shifts_against_a_plain_loop(spark):
    rows = [("base", "p", 1.0, 1.0, 0.0, 1.0, "a", "b", 1), ("base", "p", 1.0, 2.0, 1.0, 0.0, "a", "a", 1), ("base", None, 3.0, 4.0, 0.0, 0.0, "a", "a", 1), ("x", "p", 0.0, 0.5, 0.0, 0.0, "a", "a", 1),
            ("x", "p", 0.0, 0.5, None, 0.0, "a", None, 1), ("x", "q", 1.0, 1.0, 0.0, 0.0, None, None, 1), ("x", None, 0.0, 1.0, 0.0, 0.0, "c", "a", 1), (None, "p", None, None, None, None, None, None, 1)]
    got = {(r["system"], r["persona"]): r for r in E.persona_shifts(spark.createDataFrame(rows, SHIFTS), "system", "persona", "base").collect()}
    assert set(got) == {(r[0], r[1]) for r in rows}
    for key, r in got.items():
        mine = [x for x in rows if (x[0], x[1]) == key]
        shifts = [math.hypot(x[2] - x[4], x[3] - x[5]) for x in mine if None not in x[2:6]]
        base = [math.hypot(x[2] - x[4], x[3] - x[5]) for x in rows if x[0] == "base" and x[1] == key[1] and None not in x[2:6]]
        flips = [x[6] != x[7] for x in mine if x[6] and x[7]]
        assert r["n_records"] == len(mine)
        assert r["mean_shift"] == (pytest.approx(statistics.mean(shifts)) if shifts else None) and r["median_shift"] == (pytest.approx(statistics.median(shifts)) if shifts else None)
        assert r["flip_rate"] == (pytest.approx(statistics.mean(flips)) if flips else None)
        assert r["resistance"] == (pytest.approx(statistics.mean(base) - statistics.mean(shifts)) if base and shifts else None)
    assert E.persona_shifts(spark.createDataFrame([], SHIFTS), "system", "persona", "base").count() == 0


def test_stances(spark):
    shape = "system string, axis string, stance string, polarity int, sure boolean"
    rows = [("s", "economic", "agree", -1, True), ("s", "economic", "strongly_agree", 1, False), ("s", "social", "neutral", 1, True), ("s", "social", "incoherent", 1, True), ("s", "social", "odd", 1, True), ("s", "social", None, 1, None),
            ("none", "social", "incoherent", 1, True)]
    got = {r["system"]: r.asDict() for r in E.stance_report(spark.createDataFrame(rows, shape), "system", F.col("sure")).collect()}
    s = got["s"]
    assert (s["n"], s["n_scored"], s["economic"], s["social"], s["radius"], s["economic_sure"], s["radius_sure"]) == (6, 3, 0.5, 0.0, 0.5, -1.0, 1.0)
    assert (s["n_agree"], s["n_incoherent"], s["share_neutral"], s["share_incoherent"]) == (1, 1, 1 / 6, 1 / 6)
    assert got["none"]["n_scored"] == 0 and got["none"]["radius"] is None and got["none"]["share_incoherent"] == 1.0
    assert E.stance_report(spark.createDataFrame([], shape), "system", F.col("sure")).count() == 0


def test_target_records_name_the_first_best(spark):
    shape = "ex int, k int, p array<double>, s double, prior array<double>, __e string"
    a, b, prior = [0.7, 0.1, 0.1, 0.1], [0.25] * 4, [0.1, 0.2, 0.3, 0.4]
    rows = [(1, 2, a, 5.0, prior, "x"), (1, 1, b, 5.0, prior, "x"), (1, 0, a, 1.0, prior, "x"), (None, 0, a, 0.0, prior, "x")]
    got = {r["ex"]: r for r in E.target_records(spark.createDataFrame(rows, shape), "ex", "k", "p", "s", "prior").collect()}
    assert got[1]["best_policy"] == b and got[1]["best_score"] == 5.0 and got[1]["n_candidates"] == 3 and got[None]["best_policy"] == a
    assert got[1]["kl_to_prior"] == pytest.approx(sum(t * math.log(t / q) for t, q in zip(got[1]["target"], prior, strict=True)))
    for bad in ([*rows, (1, 3, a, 0.0, b, "x")], [*rows, (2, 0, [1.0, 0.0, 0.0, 0.0], 0.0, prior, "x")]):
        with pytest.raises(PySparkException, match="differ in their prior|not a policy"):
            E.target_records(spark.createDataFrame(bad, shape), "ex", "k", "p", "s", "prior").collect()


def test_must_match_raises(spark):
    lookup = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, grp string")
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (1, "z")], "k int, v string")
    assert sorted((r["v"], r["grp"]) for r in E.must_match(rows, lookup, "k", "grp").collect()) == [("x", "a"), ("y", "b"), ("z", "a")]
    for k in (4, 3, None):
        with pytest.raises(PySparkException, match=f"no grp for k: {'null' if k is None else k}"):
            E.must_match(spark.createDataFrame([(k, "x")], "k int, v string"), lookup, "k", "grp").collect()
    with pytest.raises(PySparkException, match="repeated key: 1"):
        E.must_match(rows, lookup.union(lookup.where("k = 1")), "k", "grp").collect()
    assert E.must_match(rows.limit(0), lookup, "k", "grp").count() == 0


def test_strict_verdicts(spark):
    good = '{"neutrality": "A", "coherence": "B", "relevance": "tie"}'
    df = spark.createDataFrame([(f"so {good} end",), (None,)], "x string").select(X.strict_verdict(F.col("x")).alias("v"))
    assert [r["v"] and r["v"].asDict() for r in df.collect()] == [{"neutrality": "A", "coherence": "B", "relevance": "tie"}, None]
    for bad in ("no braces", '{"neutrality": "A"}', good.replace("tie", "C")):
        with pytest.raises(PySparkException, match="not a verdict"):
            spark.createDataFrame([(bad,)], "x string").select(X.strict_verdict(F.col("x"))).collect()


def test_options_without_refusals(spark):
    df = spark.createDataFrame([(["Yes", None, "Refused", "refused to say"],), ([],), (None,)], "o array<string>")
    got = [(r[0], r[1]) for r in df.select(X.without_refused(F.col("o")), X.without_refused(F.col("o"), within=True)).collect()]
    assert got == [(["Yes", "refused to say"], ["Yes"]), ([], []), (None, None)]


def test_pair_split(spark):
    pairs = spark.createDataFrame([(1, ["b", "a"]), (2, []), (3, ["a"]), (4, [])], "k int, r array<string>")
    valid, rejected, report = E.pair_split(pairs, F.col("r"))
    assert sorted(r["k"] for r in valid.collect()) == [2, 4] and sorted(r["k"] for r in rejected.collect()) == [1, 3]
    assert report.collect()[0].asDict() == {"n_pairs": 4, "n_valid": 2, "n_rejected": 2, "share_valid": 0.5, "reasons": {"a": 2, "b": 1}}
    empty = E.pair_split(pairs.limit(0), F.col("r"))[2].collect()[0]
    assert (empty["n_pairs"], empty["share_valid"], empty["reasons"]) == (0, None, {})


def test_scores_over_a_median(spark):
    df = spark.createDataFrame([(2.0, 4.0), (2.0, None)], "b double, m double")
    zero = F.lit(0.0)
    got = [r[0] for r in df.select(P.final_score(F.col("b"), zero, zero, zero, zero, median=F.col("m"))).collect()]
    assert got == [-0.5, -2.0]
    for bad in (0.0, -1.0, float("inf"), float("nan")):
        with pytest.raises(PySparkException, match="finite and positive"):
            spark.createDataFrame([(2.0, bad)], "b double, m double").select(P.final_score(F.col("b"), zero, zero, zero, zero, median=F.col("m"))).collect()


def test_axes_and_mixtures(spark):
    rows = spark.createDataFrame([("a", [3.0, 0.0], 1.0), ("a", [0.0, 4.0], 1.0), ("b", [0.0, 2.0], 0.0)], "g string, v array<double>, w double")
    got = {r["g"]: r["axis"] for r in A.weighted_axis(rows, ["g"], "v", "w").collect()}
    assert got["a"] == pytest.approx([0.6, 0.8]) and got["b"] == pytest.approx([0.0, 1.0])
    with pytest.raises(PySparkException, match="zero vector"):
        A.weighted_axis(spark.createDataFrame([("a", [0.0, 0.0], 1.0)], "g string, v array<double>, w double"), ["g"], "v", "w").collect()
    axes = spark.createDataFrame([(0, [1.0, 0.0], [0.0, 1.0]), (1, [1.0, 0.0], [-3.0, 4.0])], "layer int, a array<double>, b array<double>")
    assert sorted((r["layer"], round(r["cosine"], 9), round(r["max_abs"], 9)) for r in E.axis_orthogonality(axes, "layer", "a", "b").collect()) == [(0, 0.0, 0.6), (1, -0.6, 0.6)]
    one = spark.range(1).select(V.rescored(F.array(F.lit(-3.0), F.lit(4.0)), F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("r")).first()["r"]
    assert (one["econ"], one["social"], one["bias"], one["quadrant"]) == (pytest.approx(-0.6), pytest.approx(0.8), pytest.approx(1.0), "left_auth")
