"""Ordered sums, ranks, quantiles, resampling, the matched sampler and greedy scans against plain versions."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textaxis.operators import ranking, resampling, stats
from textaxis.operators.corpus import equalized_texts, running_cap
from textaxis.operators.greedy import chosen, entry_table, min_gap_rows
from textaxis.operators.matched import budgets_by_share, even_budgets, matched_sample


def test_ordered_sums_with_a_hot_key_an_outlier_and_nulls(spark):
    rng = np.random.default_rng(0)
    rows = [("hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 50}", 10**15 if i == 17 else i * 3, int(rng.integers(0, 9)) if i % 11 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, at long, w long").repartition(6)
    got = ranking.ordered(df, ["k"], ["at"], "before", "w")
    assert got.columns == ["k", "at", "w", "before"]
    want, sums = {}, Counter()
    for k, at, w in sorted(rows, key=lambda r: r[1]):
        want[at] = sums[k]
        sums[k] += w or 0
    assert {r.at: r.before for r in got.collect()} == want
    slots = sorted((r.at, r.slot) for r in ranking.numbered(df.select("at"), "at").collect())
    assert [s for _, s in slots] == list(range(3000))


def test_parts_are_even_however_values_lie(spark):
    """One value far out, as many rows as asked for in each part."""
    df = spark.range(20_000).select(F.when(F.col("id") == 0, 10**15).otherwise(F.col("id")).alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in ranking.ordered_parts(df, [], ["x"]).groupBy("__part").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)

def unsteady(spark, n):
    """Distinct scores whose last bits differ whenever they are computed again, as those of sums that are added up in another order."""

    @F.pandas_udf("double")
    def near(x):
        import os

        import pandas as pd

        return pd.Series([v + b * 1e-13 for v, b in zip(x, os.urandom(len(x)), strict=True)])

    noise = near.asNondeterministic()
    return spark.range(n).select("id", (F.col("id") % 3).alias("g"), noise(F.col("id").cast("double")).alias("x"), noise((F.col("id") * 7 % n).cast("double")).alias("y"))


def test_correlations_keep_rows_whose_scores_change_when_computed_again(spark):
    n = 299
    got = stats.correlations(unsteady(spark, n), "x", "y", [])
    assert [(r.n, round(r.spearman, 6)) for r in got.collect()] == [(n, round(float(np.corrcoef(range(n), [i * 7 % n for i in range(n)])[0, 1]), 6))]
    assert {r.g: r.n for r in stats.correlations(unsteady(spark, n), "x", "y", ["g"]).collect()} == {0: 100, 1: 100, 2: 99}


def test_correlation_matrix_keeps_rows_whose_scores_change_when_computed_again(spark):
    got = stats.correlation_matrix(unsteady(spark, 299), ["x", "y"], []).collect()
    assert [(r.x, r.y, r.n) for r in got] == [("x", "x", 299), ("x", "y", 299), ("y", "y", 299)] and got[0].spearman == pytest.approx(1)


def test_permutations_keep_rows_whose_scores_change_when_computed_again(spark):
    rows = unsteady(spark, 29)
    want = round(float(np.corrcoef(range(29), [i * 7 % 29 for i in range(29)])[0, 1]), 6)
    for got in (stats.permutation_p(rows, "x", "y", "id", 20, 5), resampling.permutation_test(rows, "x", "y", "id", 20, 5)):
        assert [(r.n, round(r.spearman, 6)) for r in got.collect()] == [(29, want)]


def plain_ranks(x):
    return np.array([(sum(v < u for v in x) + (sum(v == u for v in x) + 1) / 2) for u in x])


def test_average_ranks_and_auc_with_ties_and_constant_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "abc"[i % 3], float(rng.integers(0, 6)) if i % 3 else 1.0, bool(rng.integers(2)), None if i % 41 == 0 else i % 4) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, g string, x double, p boolean, y long").repartition(4)
    got = {r.i: r.k for r in ranking.average_ranks(df, "x", ["g"], "k").collect()}
    for g in "abc":
        mine = [r for r in rows if r[1] == g]
        assert [got[r[0]] for r in mine] == plain_ranks([r[2] for r in mine]).tolist()
        pos, neg = [[r[2] for r in mine if r[3] == c] for c in (True, False)]
        area = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
        assert stats.auc(df, "x", "p", ["g"]).where(F.col("g") == g).first()["auc"] == pytest.approx(area)
    m = {(r.x, r.y): r for r in stats.correlation_matrix(df.withColumn("x2", -F.col("x")), ["x", "x2", "y"], []).collect()}
    able = [r for r in rows if r[4] is not None]
    a, b = plain_ranks([r[2] for r in able]), plain_ranks([r[4] for r in able])
    assert m["x", "x2"].spearman == pytest.approx(-1) and m["x", "y"].spearman == pytest.approx(np.corrcoef(a, b)[0, 1]) and m["x", "x"].n == len(able) and len(m) == 6
    assert stats.auc(df.where("false"), "x", "p", ["g"]).count() == 0


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [("one", 5.0), ("none", None)] + [("many", float(np.round(v, 1))) for v in rng.normal(size=1500)] + [(None, float(i)) for i in range(4)]
    at = {"p1": 0.01, "p50": 0.5, "p99": 0.99, "least": 0.0, "most": 1.0}
    got = {r.g: r for r in stats.quantiles(spark.createDataFrame(rows, "g string, x double").repartition(5), "x", ["g"], at).collect()}
    assert set(got) == {"one", "many", None}
    for g, r in got.items():
        x = [v for k, v in rows if k == g]
        assert [r[c] for c in at] == pytest.approx([np.quantile(x, p) for p in at.values()]) and (r.n, r.min, r.max) == (len(x), min(x), max(x)) and r.mean == pytest.approx(np.mean(x))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000])
def test_bijections_are_permutations_that_look_random(n):
    got = resampling.permuted(7, np.arange(200), np.arange(n), n)
    assert (np.sort(got, axis=1) == np.arange(n)).all()
    if n >= 64:
        c = np.array([np.corrcoef(np.arange(n), g)[0, 1] for g in got])
        assert abs(c.mean()) < 4 / math.sqrt(200 * n) and 0.8 < c.std() * math.sqrt(n) < 1.2
        assert abs(np.bincount(got[:, 0] * 8 // n, minlength=8) - 25).max() < 25
    parts = np.concatenate([resampling.permuted(7, np.arange(200), np.arange(a, min(n, a + 7)), n) for a in range(0, n, 7)], axis=1)
    assert (parts == got).all()


def test_poisson_draws():
    got = resampling.poisson_counts(3, np.arange(50), np.arange(10**12, 10**12 + 4000))
    assert abs(got.mean() - 1) < 0.01 and abs(got.var() - 1) < 0.02 and abs((got == 0).mean() - math.exp(-1)) < 0.005
    assert abs(np.corrcoef(got)[0, 1:]).max() < 0.08


def plain_permutation(rows, reps, seed):
    rows = [r for r in rows if r[1] is not None and r[2] is not None]
    rows.sort(key=lambda r: (r[2], r[0]))
    a, b = plain_ranks([r[1] for r in rows]), plain_ranks([r[2] for r in rows])
    to = resampling.permuted(seed, np.arange(reps), np.arange(len(rows)), len(rows))
    seen = np.corrcoef(a, b)[0, 1]
    return len(rows), seen, sum(abs(np.corrcoef(a, b[t])[0, 1]) >= abs(seen) - 1e-9 for t in to)


@pytest.mark.parametrize("runs", [1 << 20, 2])
def test_permutation_test_equals_a_plain_one(spark, monkeypatch, runs):
    """Also with the runs of ties in several blocks."""
    monkeypatch.setattr(resampling, "RUNS", runs)
    rng = np.random.default_rng(3)
    rows = [(i * 5, float(rng.integers(0, 20)), float(rng.integers(0, 12)) if i % 9 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, x double, y double").repartition(5)
    got = resampling.permutation_test(df, "x", "y", "k", 400, 11).first()
    n, seen, hits = plain_permutation(rows, 400, 11)
    assert (got.n, got.hits) == (n, hits) and got.spearman == pytest.approx(seen) and got.p == pytest.approx((hits + 1) / 401)
    assert resampling.permutation_test(df.where("k < 2"), "x", "y", "k", 10, 1).first()["p"] is None


def test_bootstrap_is_near_theory_and_independent_of_partitions(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(3, 2, 900)
    df = spark.createDataFrame([(i, float(v), None if i % 2 else float(v)) for i, v in enumerate(x)], "k long, x double, y double")
    a, b = ({r.x: r for r in resampling.bootstrap_moments(df.repartition(p), ["x", "y"], "k", 1000, 5).collect()} for p in (1, 7))
    assert a["x"].se == pytest.approx(b["x"].se) and a["x"].se == pytest.approx(x.std() / 30, rel=0.1)
    assert a["y"].n == 450 and a["y"].mean == pytest.approx(x[::2].mean()) and a["y"].se == pytest.approx(x[::2].std() / math.sqrt(450), rel=0.1)
    assert resampling.bootstrap_moments(df.where("false"), ["x"], "k", 10, 5).first()["mean"] is None


def test_center_verdict_needs_all_four_checks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "ab"[i % 2], float(np.clip(rng.normal(), -2, 2)), float(np.clip(rng.normal(), -2, 2))) for i in range(400)]
    polarity = spark.createDataFrame([(a, s > 0, s * 1.0) for a in ("x", "y") for s in (1, -1)], "axis string, positive boolean, x double")
    df = spark.createDataFrame(rows, "k long, c string, x double, y double")
    got = stats.center_verdict(df, polarity, "c", ("x", "y"), "k").collect()
    assert all(r.all_passed and r.stable and r.no_outliers for r in got)
    far = df.unionByName(spark.createDataFrame([(999, "a", 50.0, 0.0)], df.schema))
    assert [r.all_passed for r in stats.center_verdict(far, polarity, "c", ("x", "y"), "k").collect()] == [False, False]
    few = stats.center_verdict(df.where("k < 8"), polarity, "c", ("x", "y"), "k", limit=99).collect()
    assert not any(r.stable for r in few) and not few[0].all_passed


def plain_matched(rows, target, shares, topics, seed, caps, share, least):
    """Rows are (key, quadrant, source, group, topic, score)."""
    order = lambda k, i: (hashlib.md5(f"{seed + i}:{k}".encode()).hexdigest(), k)
    most = [max(1, math.floor(target * c)) for c in caps]
    out = {}
    for q in {r[1] for r in rows if r[1] is not None}:
        mine = [r for r in rows if r[1] == q and r[4] in topics]
        taken, used = {}, [Counter(), Counter(), Counter()]

        def scan(candidates, need, i, room, enforced, stage, taken=taken, used=used):
            if len(candidates) > need:
                candidates = sorted(candidates, key=lambda r: (-r[5] if r[5] is not None else math.inf, r[0]))[:max(need, math.ceil(len(candidates) * share))]
            for r in sorted(candidates, key=lambda r: order(r[0], i)):
                if room() <= 0:
                    break
                if all(used[c][r[2 + c]] < most[c] for c in enforced):
                    taken[r[0]] = (stage, len(taken))
                    for c in range(3):
                        used[c][r[2 + c]] += 1

        for g, budget in budgets_by_share(target, shares).items():
            for t, want in even_budgets(budget, topics).items():
                cell = [r for r in mine if (r[3], r[4]) == (g, t)]
                if len(cell) >= least:
                    at = len(taken)
                    scan(cell, want, 0, lambda at=at, want=want, g=g, budget=budget: min(want - len(taken) + at, budget - used[1][g]), (0, 1, 2), "topic")
            if (short := budget - used[1][g]) > 0:
                scan([r for r in mine if r[3] == g and r[0] not in taken], short, 1, lambda g=g, budget=budget: budget - used[1][g], (0, 1, 2), "group")
        if (short := target - len(taken)) > 0:
            scan([r for r in mine if r[0] not in taken], short, 2, lambda: target - len(taken), (0, 2), "final")
        out |= taken
    return out


@pytest.mark.parametrize(("n", "target", "caps", "share", "least"), [
    (10_000, 300, (0.2, 0.45, 0.3), 0.25, 5), (3000, 200, (0.7, 0.65, 0.5), 0.4, 1), (400, 90, (0.3, 0.5, 0.4), 0.4, 20), (6000, 700, (0.1, 0.4, 0.3), 0.3, 1), (5000, 60, (0.02, 0.5, 0.2), 0.01, 1)])
def test_matched_sample_equals_a_plain_loop(spark, n, target, caps, share, least):
    """Cells larger than every cap, small cells, ties, a group outside the shares, rows without group, source or score."""
    rng = np.random.default_rng(n)
    rows = []
    for i in range(n):
        s = int(rng.zipf(1.5)) % 12
        rows.append((i, f"q{rng.integers(3)}" if i % 97 else None, f"s{s}" if i % 31 else None, f"g{s % 4}" if i % 29 else None, f"t{int(rng.zipf(1.6)) % 5}", float(np.round(rng.random(), 2)) if i % 23 else None))
    shares, topics = {"g1": 0.5, "g0": 0.3, "g2": 0.2}, ["t1", "t2", "t0", "t3"]
    df = spark.createDataFrame(rows, "k long, q string, s string, g string, t string, x double")
    got = matched_sample(df, "q", "s", "g", "t", "x", "k", target, shares, topics, n, *caps, share, least)
    assert {r.k: (r.stage, r.place) for r in got.collect()} == plain_matched(rows, target, shares, topics, n, caps, share, least)
    assert matched_sample(df.where("false"), "q", "s", "g", "t", "x", "k", target, shares, topics, n).count() == 0


def plain_gap(at, gap):
    out = []
    for i in sorted(set(at)):
        if not out or i >= out[-1] + gap:
            out.append(i)
    return out


@pytest.mark.parametrize("gap", [0, 1, 7, 500, 10**9])
def test_greedy_gaps_over_long_and_short_keys(spark, gap):
    """One key in many ranges, short keys, repeated indexes, nulls; gaps smaller and larger than a range."""
    rng = np.random.default_rng(gap % 97)
    rows = [("long", int(x)) for x in rng.integers(0, 20_000, 6000)] + [(f"k{i % 40}", int(rng.integers(-50, 50))) for i in range(600)] + [("one", 5), ("one", 5), (None, 3), ("k1", None)]
    df = spark.createDataFrame(rows, "k string, i long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((r.k, r.i) for r in min_gap_rows(df, "k", "i", gap).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == sorted((k, i) for k in {r[0] for r in rows if r[0]} for i in plain_gap([i for x, i in rows if x == k and i is not None], gap))
    assert min_gap_rows(df.where("false"), "k", "i", gap).count() == 0


def test_scans_composed_from_parts_equal_one_scan():
    rng = np.random.default_rng(0)
    for _ in range(300):
        at, gap = np.unique(rng.integers(0, 300, rng.integers(1, 60))), int(rng.integers(1, 60))
        cuts = np.unique(np.r_[0, rng.integers(0, len(at) + 1, rng.integers(0, 6)), len(at)])
        since, got = None, []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            got += at[a:b][chosen(at[a:b], gap, since)].tolist()
            entry, leave = entry_table(at[a:b], gap)
            i = 0 if since is None else int(np.searchsorted(entry, since))
            since = int(leave[i]) if i < len(entry) else since
        assert got == plain_gap(at.tolist(), gap)


def test_word_budgets_of_a_hot_key(spark):
    rows = [(i, "hot" if i % 4 else "cold", " ".join(f"w{i}_{j}" for j in range(i % 5))) for i in range(400)] + [(1000, None, "a b c"), (1001, "few", "a"), (1002, "hot", None)]
    df = spark.createDataFrame(rows, "i long, k string, t string").repartition(4)
    got = {r.k: (r.n_rows, r.n_words, r.t) for r in equalized_texts(df, "k", "i", "t", 100, 3).collect()}
    for k in ("hot", "cold"):
        mine = sorted((r for r in rows if r[1] == k and (r[2] or "").split()), key=lambda r: hashlib.md5(f"3:{r[0]}".encode()).hexdigest())
        w, used = [], 0
        for r in mine:
            used += len(w) < 100
            w += r[2].split()
        assert got[k] == (used, 100, " ".join(w[:100]))
    assert set(got) == {"hot", "cold"}
    capped = running_cap(df.withColumn("n", F.size(F.split("t", " "))), "k", ["i"], "n", 50).where("k = 'hot'").collect()
    assert max(r.words_before for r in capped) < 50 and len({r.i for r in capped}) == len(capped) >= 12
