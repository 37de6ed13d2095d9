"""Column builders against plain Python, on the cases where engines usually differ."""

import math
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from textaxis.functions import policy as P
from textaxis.functions import text as X
from textaxis.functions import vectors as V
from textaxis.operators import axes as A
from textaxis.operators import corpus as O
from textaxis.operators import reports as R
from textaxis.operators import stats as S
from textaxis.operators.ranking import numbered

TEXTS = ["", "  a  b ", "a\xa0b c", "x\x1cy\r\nz\r\n\r\n\r\n\r\nw", "\tTab\t\ttab ", "Ünï çode ①½ naïve", "don’t", "one", None]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def values(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_words_and_space(spark):
    df = column(spark, TEXTS)
    assert values(df, X.words(F.col("v"))) == [(t or "").split() for t in TEXTS]
    assert values(df, X.strip(F.col("v"))) == [t if t is None else t.strip() for t in TEXTS]
    want = [t if t is None else re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t.replace("\r\n", "\n").replace("\r", "\n"))).strip() for t in TEXTS]
    assert values(df, X.normalize_whitespace(F.col("v"))) == want


def test_coercions(spark):
    df = column(spark, [" NaN", "none ", "null", "", " x ", None])
    assert values(df, X.coerce_text(F.col("v"))) == [None, None, "null", None, "x", None]
    df = column(spark, ["0", "86399", "-1", "1e3", "soon", None])
    assert values(df, X.epoch_date(F.col("v"))) == ["1970-01-01", "1970-01-01", "1969-12-31", "1970-01-01", None, None]
    df = column(spark, ["2020-01-02T1", "20-01-02", "", None])
    assert values(df, X.iso_date(F.col("v"))) == ["2020-01-02", None, None, None]
    df = column(spark, ["['a', \"b c\"]", "a, b ,", "[]", ""])
    assert values(df, X.tag_list(F.col("v"))) == [["a", "b c"], ["a", "b"], [], []]


def test_half_even(spark):
    df = column(spark, [0.5, 1.5, 2.5, -0.5], "double")
    assert values(df, X.half_even(F.col("v"), 0)) == [0.0, 2.0, 2.0, -0.0]


def test_verdict_needs_all_winners(spark):
    good = 'x {"neutrality": "A", "coherence": "tie", "relevance": "B"} y'
    df = column(spark, [good, good.replace("tie", "C"), "{broken", "none", None])
    got = values(df, X.verdict(F.col("v")))
    assert tuple(got[0]) == ("A", "tie", "B") and got[1:] == [None] * 4


def test_text_scores(spark):
    t = "I can’t help. It depends! Extraordinary " + "word " * 25
    df = column(spark, [t, "", None])
    assert values(df, X.contains_any(F.col("v"), X.REFUSAL_PHRASES)) == [True, False, False]
    assert values(df, X.quality_score(F.col("v"))) == [0.8, 0.2, 0.2]
    assert values(df, F.round(X.vagueness_score(F.col("v")), 6)) == [0.2, 0.3, 0.3]
    assert values(df, X.max_word_share(F.col("v")))[0] == 25 / len(t.split())


def test_vectors(spark):
    df = column(spark, [[3.0, 4.0], [0.0, 0.0], [1.0, float("nan")], None], "array<float>")
    assert values(df.where("i = 0"), V.unit(F.col("v"))) == [[0.6, 0.8]]
    with pytest.raises(Exception, match="zero vector"):
        values(df.where("i = 1"), V.unit(F.col("v")))
    assert values(df.where("i < 2"), V.unit_above(F.col("v"))) == [[0.6, 0.8], [0.0, 0.0]]
    assert values(df, V.valid(F.col("v"), 2)) == [True, True, False, False]
    assert values(df.where("i = 0"), V.dot_wide(F.col("v"), F.col("v"))) == [25.0]


def test_quadrants_break_ties_to_right_and_auth(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, -0.1, 0.0), (2, 0.0, -0.1), (3, -1.0, -1.0), (4, None, 1.0)], "i int, e double, s double")
    assert values(df, V.quadrant(F.col("e"), F.col("s"))) == ["right_auth", "left_auth", "right_lib", "left_lib", None]


def test_policies(spark):
    rng = np.random.default_rng(0)
    ps = rng.dirichlet([0.5] * 4, 50)
    df = column(spark, [p.tolist() for p in ps], "array<double>")
    for got, least in ((values(df, P.floored(F.col("v"), 0.05)), 0.05), (values(df, P.clipped(F.col("v"), 0.05)), 0.0)):
        assert np.allclose(np.sum(got, axis=1), 1) and np.min(got) >= least - 1e-12
    x = np.maximum(ps - 0.05, 0)
    assert np.allclose(values(df, P.floored(F.col("v"), 0.05)), 0.05 + 0.8 * x / x.sum(axis=1, keepdims=True))
    assert np.allclose(values(df, P.sharpen(F.col("v"), 0.5)), ps**2 / (ps**2).sum(axis=1, keepdims=True))
    assert np.allclose(values(df, P.entropy(F.col("v"))), -(ps * np.log(ps)).sum(axis=1))
    assert np.allclose(values(df, P.softmax(F.col("v"), 0.1)), np.exp(ps * 10) / np.exp(ps * 10).sum(axis=1, keepdims=True))
    assert all(values(df, P.valid_policy(F.col("v"))))
    odd = column(spark, [[1.0, 0.0, 0.0, 0.0], [0.25] * 3, [float("nan")] * 4, None, [0.25] * 4], "array<double>")
    assert values(odd, P.valid_policy(F.col("v"))) == [False, False, False, False, True]
    assert values(odd.where("i = 0"), P.kl_infinite(P.uniform(), F.col("v"))) == [math.inf]


def test_candidate_fan_keeps_first(spark):
    df = spark.createDataFrame([(0, [0.25] * 4, [1.0, 2.0, 0.5, 0.1])], "i int, p array<double>, q array<double>")
    fan = values(df, P.candidate_fan(F.col("p"), F.col("q")))[0]
    kept = values(df, P.keep_first_distinct(P.candidate_fan(F.col("p"), F.col("q"))))[0]
    plain = []
    for c in fan:
        if not any(max(abs(a - b) for a, b in zip(c, k, strict=True)) <= 1e-6 for k in plain):
            plain.append(c)
    assert kept == plain and len(fan) == 7 and len(kept) == 4 and np.allclose(fan[4], [0.25, 0.05, 0.45, 0.25])


def plain_edit_loop(p, a, states, econ, social, steps):
    corners = [-econ - social, social - econ, econ - social, econ + social]
    made, reason = 0, None
    for _ in range(steps):
        q = p * np.exp(-a)
        q /= q.sum()
        mixed = (q[:, None] * states).sum(axis=0)
        mixed /= np.linalg.norm(mixed)
        b = np.array([c @ mixed / np.linalg.norm(c) for c in corners])
        moved, turned = np.abs(q - p).max(), np.abs(b - a).max()
        p, a, made = q, b, made + 1
        if min(abs(econ @ mixed), abs(social @ mixed)) <= 0.015:
            reason = "axis_proximity"
        elif moved <= 1e-3 and turned <= 1e-3:
            reason = "converged"
        if reason:
            break
    return p, a, made, reason


def test_edit_loop_equals_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    axes = [x / np.linalg.norm(x) for x in rng.normal(size=(2, 6))]  # not orthogonal
    rows = [(i, rng.dirichlet([1.0] * 4).tolist(), rng.normal(0, 0.5, 4).tolist(), rng.normal(size=(4, 6)).tolist()) for i in range(60)]
    still = rng.normal(size=6)  # equal states score alike whatever the weights
    even = np.array([x @ still / np.linalg.norm(x) / np.linalg.norm(still) for x in (-axes[0] - axes[1], axes[1] - axes[0], axes[0] - axes[1], axes[0] + axes[1])])
    rows.append((60, [0.25] * 4, even.tolist(), [still.tolist()] * 4))
    odd = [(61, None, [0.0] * 4, rows[0][3]), (62, [1.0, 0.0, 0.0, 0.0], [0.0] * 4, rows[0][3]), (63, [0.25] * 4, [0.0] * 4, None)]
    df = spark.createDataFrame(rows + odd, "i int, p array<double>, a array<double>, h array<array<double>>")
    econ, social = (F.array(*[F.lit(float(v)) for v in x]) for x in axes)
    columns = [F.col(c) for c in "pah"]
    for steps, recursive in ((10, True), (200, True), (10, False)):
        got = values(df, P.edit_loop(*columns, econ, social, steps=steps, recursive=recursive))
        assert got[len(rows):] == [None] * 3
        for (_, p, a, h), r in zip(rows, got, strict=False):
            p, a, made, reason = plain_edit_loop(np.array(p), np.array(a), np.array(h), *axes, steps if recursive else 1)
            assert (r["steps"], r["reason"]) == (made, reason if recursive else None)
            assert np.allclose(r["policy"], p) and np.allclose(r["align"], a)


def test_fans_end_with_draws(spark):
    df = spark.createDataFrame([(i, [0.1, 0.2, 0.3, 0.4], [1.0, 2.0, 0.5, 0.1]) for i in range(3)], "i int, p array<double>, q array<double>")
    df = df.withColumn("d", P.dirichlet_draws(F.array(*[F.element_at("p", i + 1) * 64.0 for i in range(4)]), F.col("i")))
    draws = values(df, F.col("d"))
    for fan, n in ((P.candidate_fan(F.col("p"), F.col("q"), draws=F.col("d")), 23), (P.standalone_fan(F.col("p"), draws=F.col("d")), 30)):
        for made, drawn in zip(values(df, fan), draws, strict=True):
            assert len(made) == n and np.allclose(np.sum(made, axis=1), 1) and np.min(made) > 0.009
            assert np.allclose(made[-16:], drawn, atol=0.02)


def test_unknown_modes_raise(spark):
    df = spark.createDataFrame([("router", [0.4, 0.3, 0.2, 0.1]), ("uniform", None)], "m string, p array<double>").withColumn("i", F.monotonically_increasing_id())
    assert values(df, P.initial_mixture(F.col("m"), F.col("p"))) == [[0.4, 0.3, 0.2, 0.1], [0.25] * 4]
    with pytest.raises(Exception, match="unknown mode"):
        values(df, P.initial_mixture(F.lit("other"), F.col("p")))


def test_dirichlet_draws_repeat(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0, 4.0]) for i in range(5)], "i int, a array<double>")
    one, two = (values(df.repartition(n), P.dirichlet_draws(F.col("a"), F.col("i"), 3)) for n in (1, 4))
    assert one == two and np.allclose(np.sum(one, axis=2), 1)


@pytest.mark.parametrize(("size", "overlap", "least"), [(4, 0, 1), (4, 1, 2), (5, 4, 5), (3, 0, 3)])
def test_chunks_equal_a_loop(spark, size, overlap, least):
    texts = [" ".join(f"w{j}" for j in range(n)) for n in range(0, 14)] + [None]
    want = []
    for i, t in enumerate(texts):
        w, k, s = (t or "").split(), 0, 0
        while w:
            part = w[s:s + size]
            if len(part) >= least:
                want.append((i, k, len(part), " ".join(part)))
                k += 1
            if s + size >= len(w):
                break
            s += size - overlap
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert sorted(tuple(r) for r in O.chunk_windows(df, size, overlap, least).collect()) == sorted(want)


def test_three_way_sizes(spark):
    got = {r["id"]: tuple(r["c"]) for r in spark.range(200).select("id", O.three_way_counts(F.col("id").cast("double")).alias("c")).collect()}
    assert [got[n] for n in (0, 1, 2, 3, 10)] == [(0, 0, 0), (1, 0, 0), (1, 1, 0), (1, 1, 1), (8, 1, 1)]
    assert all(sum(c) == n for n, c in got.items()) and all(min(c) >= 1 for n, c in got.items() if n >= 3)


def test_an_empty_bucket_takes_from_the_largest(spark):
    def plain(n, shares):
        if n < 3:
            return {0: (0, 0, 0), 1: (1, 0, 0), 2: (1, 1, 0)}[n]
        exact = [n * s for s in shares]
        got = [int(e) for e in exact]
        for i in sorted(range(3), key=lambda i: (-round(exact[i] - got[i], 9), i))[:n - sum(got)]:
            got[i] += 1
        while 0 in got and max(got) > 1:
            most, zero = got.index(max(got)), got.index(0)
            got[most] -= 1
            got[zero] += 1
        return tuple(got)

    for shares in ((0.1, 0.8, 0.1), (0.05, 0.05, 0.9), (0.98, 0.01, 0.01), (0.8, 0.1, 0.1)):
        got = {r["id"]: tuple(r["c"]) for r in spark.range(40).select("id", O.three_way_counts(F.col("id").cast("double"), shares).alias("c")).collect()}
        assert got == {n: plain(n, shares) for n in range(40)}


def test_one_source_and_topic_with_two_groups(spark):
    df = spark.createDataFrame([(i, "q", "s", "A" if i < 50 else "B", "t", float(100 - i)) for i in range(100)], "k int, q string, s string, g string, t string, c double")
    got = O.balanced_capped_sample(df, "q", "s", "g", "t", "c", "k", 20, 1.0, 0.5, 1.0).collect()
    assert sorted(r["k"] for r in got) == [*range(10), *range(50, 60)]


def test_numbers_along_an_order(spark):
    df = spark.createDataFrame([(int(x),) for x in np.random.default_rng(3).permutation(1000) ** 2 - 500], "k long")
    rows = sorted(tuple(r) for r in numbered(df.repartition(5), "k").collect())
    assert [at for _, at in rows] == list(range(1000))


def test_long_arrays_take_linear_time(spark):
    def took(n):
        words, numbers = f"array_join(transform(sequence(1, {n}), i -> concat('w', i % 977)), ' ')", f"transform(sequence(1, {n}), i -> i % 7 + 1.0D)"
        df = spark.range(4).select(F.expr(words).alias("x"), F.expr(numbers).alias("v"))
        out = df.select(X.distinct_ratio(F.col("x"), 2), X.max_word_share(F.col("x")), F.size(V.unit(F.col("v"))), F.size(V.unit_above(F.col("v"))))
        out.collect()
        began = time.perf_counter()
        out.collect()
        return time.perf_counter() - began

    assert took(64_000) < 3 * took(32_000) + 0.5


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 7).alias("d"))
    for f in (lambda x: O.three_way_split(x, ["d"], "k", 1), lambda x: O.document_split(x, "d", 0.3, 1), lambda x: O.folds(x, "k", 5, 1)):
        a, b = (sorted(tuple(r) for r in f(df.repartition(n)).collect()) for n in (1, 9))
        assert a == b
    split = O.document_split(df, "d", 0.3, 1)
    train, val = (split.where(F.col("split") == s) for s in ("train", "val"))
    assert O.without_leaks(val, train, "d").count() == val.count() > 0


def test_balanced_sampler_equals_a_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"q{i % 2}", f"s{rng.integers(4)}", f"g{rng.integers(3)}", f"t{rng.integers(3)}", float(rng.integers(20))) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, q string, s string, g string, t string, c double")
    got = {r["k"] for r in O.balanced_capped_sample(df, "q", "s", "g", "t", "c", "k", 30, 0.4, 0.5, 0.5).collect()}
    want = set()
    for q in ("q0", "q1"):
        used, n = {}, 0
        for k, _, s, g, t, _ in sorted((r for r in rows if r[1] == q), key=lambda r: (-r[5], r[0])):
            caps = ((("s", s), 12), (("g", g), 15), (("t", t), 15))
            if n < 30 and all(used.get(x, 0) < m for x, m in caps):
                n += 1
                want.add(k)
                for x, _ in caps:
                    used[x] = used.get(x, 0) + 1
    assert got == want


def vectors_table(spark, n=200, width=6):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, n).astype(bool)
    x = rng.normal(size=(n, width)) + np.outer(y, [1.0, 0.5, 0, 0, 0, 0])
    g = [f"g{i % 3}" if i % 7 else None for i in range(n)]
    df = spark.createDataFrame([(i, x[i].tolist(), bool(y[i]), g[i]) for i in range(n)], "k int, v array<double>, p boolean, g string")
    return df, x, y, np.array([str(t) for t in g])


def plain_auc(s, y):
    a, b = s[y], s[~y]
    return float(((a[:, None] > b[None, :]) + 0.5 * (a[:, None] == b[None, :])).mean())


def test_auc_and_group_out(spark):
    df, x, y, g = vectors_table(spark)
    got = {r["held"]: r["auc"] for r in A.leave_one_group_out(df, "v", "p", "g").collect()}
    assert set(got) == {"g0", "g1", "g2"}
    for held, auc in got.items():
        train, test = g != held, g == held
        axis = x[train & y].mean(axis=0) - x[train & ~y].mean(axis=0)
        assert auc == pytest.approx(plain_auc(x[test] @ axis, y[test]))
    ties = spark.createDataFrame([(1.0, True, "a"), (1.0, False, "a"), (2.0, True, "a"), (1.0, True, "b")], "s double, p boolean, g string")
    assert {r["g"]: r["auc"] for r in S.auc(ties, "s", "p", ["g"]).collect()} == {"a": 0.75, "b": None}


def test_kfold_and_random_directions(spark):
    df, x, y, _ = vectors_table(spark)
    folded = O.folds(df, "k", 4, 0)
    fold = np.array([r["fold"] for r in folded.orderBy("k").collect()])
    got = A.kfold_auc(folded, "v", "p", "fold").first()
    s = np.zeros(len(y))
    for k in range(4):
        axis = x[(fold != k) & y].mean(axis=0) - x[(fold != k) & ~y].mean(axis=0)
        s[fold == k] = x[fold == k] @ (axis / np.linalg.norm(axis))
    assert got["auc"] == pytest.approx(plain_auc(s, y))
    r = A.random_direction_null(df, "v", "p", 6, 50, 4).first()
    d = np.random.default_rng(4).normal(size=(6, 50))
    z = x @ (d / np.linalg.norm(d, axis=0))
    c = (z[y].mean(axis=0) - z[~y].mean(axis=0)) / np.sqrt((z[y].var(axis=0, ddof=1) + z[~y].var(axis=0, ddof=1)) / 2)
    assert (r["mean"], r["p95"], r["max"]) == pytest.approx((np.abs(c).mean(), np.quantile(np.abs(c), 0.95), np.abs(c).max()))


def test_logistic_axis_is_near_the_mean_difference(spark):
    df, x, y, _ = vectors_table(spark)
    axis = np.array(A.logistic_axis(df, "v", F.col("p")).first()["axis"])
    diff = x[y].mean(axis=0) - x[~y].mean(axis=0)
    assert np.linalg.norm(axis) == pytest.approx(1) and axis @ diff / np.linalg.norm(diff) > 0.9


def test_wide_and_folded_dots_agree(spark):
    df, x, _, _ = vectors_table(spark)
    got = df.select(V.dot(F.col("v"), F.col("v")).alias("a"), V.dot_wide(F.col("v"), F.col("v")).alias("b")).collect()
    assert all(r["a"] == pytest.approx(r["b"]) for r in got)


def test_topics_without_prototypes(spark):
    df, *_ = vectors_table(spark)
    none = spark.createDataFrame([], "name string, vec array<double>")
    r = A.nearest_prototypes(df, "k", "v", none, "name", "vec").first()
    assert (r["topic_primary"], r["topic_primary_score"], r["topic_secondary"]) == ("other", 0.0, None)


def test_gate(spark):
    rows = spark.createDataFrame([("q0", "s", "t", i, 100, 0.1) for i in range(20)], "quadrant string, source string, topic string, document_id int, n_tokens long, margin double")
    report = R.checks(rows, {"val_indist": rows.limit(1)}, ["q0"], source_cap=1.0, topic_cap=1.0)
    with pytest.raises(R.GateError, match="NON_EMPTY:val_indist, NO_DOC_LEAKAGE:val_indist"):
        R.gate(report)
    other = rows.withColumn("document_id", F.col("document_id") + 100)
    good = R.checks(rows, {"val_indist": other}, ["q0"], source_cap=1.0, topic_cap=1.0)
    assert R.gate(good).count() == good.count()


def test_questions_match_by_beginning_then_by_containment(spark):
    long = "How much, if at all, do you think the following proposals would do to reduce economic inequality in the U.S.?"
    questions = [("a", long + " Taxes"), ("b", "Do you favor it"), ("c", long + " Schools"), ("d", "Some say so. " + long), ("e", "favor")]
    texts = ["  " + long, "xx " + long, long[:60], "Well: do you? Do you favor it or not", "favor", "nothing", "", None]

    def plain(q):
        begins = {v[:80]: k for k, v in questions}
        if q is None:
            return None
        q = q.strip()
        return begins.get(q[:80]) or next((k for k, v in questions if q[:60] in v or v[:60] in q), None)

    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    asked = spark.createDataFrame([(k, q, i) for i, (k, q) in enumerate(questions)], "key string, question string, n int")
    got = {r["id"]: r["key"] for r in O.match_questions(rows, asked, "id", "text", "key", "question", "n").collect()}
    assert got == {i: plain(q) for i, q in enumerate(texts)}
    assert [got[i] for i in range(6)] == ["c", "a", "a", "b", "e", None]


def test_pooling_masks_padding_and_prefixes(spark):
    states = [[1.0, 2.0], [3.0, 4.0], [5.0, 9.0]]
    cases = [(states, [1, 1, 0], 0), (states, [1, 1, 1], 1), (states, [1, 1, 1], 5), (states, [0, 0, 0], 0), ([], [], 0), (None, None, 0), (states, [1], 0)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, s array<array<double>>, m array<int>, k int")
    mask = V.response_mask(F.col("m"), F.col("k"))
    got = rows.select("id", V.pooled(F.col("s"), mask).alias("mean"), V.pooled(F.col("s"), mask, "last_token").alias("last")).orderBy("id").collect()
    assert [r["mean"] for r in got] == [[2.0, 3.0], [4.0, 6.5], [3.0, 5.0], [0.0, 0.0], None, None, None]
    assert [r["last"] for r in got[:6]] == [[3.0, 4.0], [3.0, 4.0], [5.0, 9.0], [1.0, 2.0], None, None]
    with pytest.raises(ValueError):
        V.pooled(F.col("s"), F.col("m"), "max")


def test_encoder_sees_each_text_once_in_bounded_calls(spark):
    def encoder(texts):
        assert 0 < len(texts) <= 3 and None not in texts
        return [[len(x), x.count("a")] for x in texts]

    texts = ["a", None, "banana", "", "x" * 5000, None, "aa", "bb", "c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["vec"] for r in A.encode_batches(rows, "id", "text", encoder, size=3).collect()}
    assert got == {i: None if x is None else [len(x), x.count("a")] for i, x in enumerate(texts)}
    assert A.encode_batches(rows.where("id < 0"), "id", "text", encoder).count() == 0


def test_shuffled_labels_against_numpy(spark):
    import hashlib

    rng = np.random.default_rng(3)
    x, p = rng.normal(size=(60, 5)), np.arange(60) % 3 == 0
    x[p] += 0.8

    def d(a):
        axis = x[a].mean(axis=0) - x[~a].mean(axis=0)
        y = x @ (axis / np.linalg.norm(axis))
        return (y[a].mean() - y[~a].mean()) / np.sqrt((y[a].var(ddof=1) + y[~a].var(ddof=1)) / 2)

    null = np.array([d(np.array([int(hashlib.md5(f"7:{r // 32}:{k}".encode()).hexdigest()[r % 32], 16) >= 8 for k in range(60)])) for r in range(40)])
    data = [(k, x[k].tolist(), bool(p[k])) for k in range(60)] + [(60, None, True), (61, x[0].tolist(), None)]
    rows = spark.createDataFrame(data, "id int, v array<double>, p boolean").repartition(3)
    got = A.shuffled_label_null(rows, "v", "p", "id", 5, 40, 7).first()
    assert np.allclose([got["real"], got["mean"], got["p95"], got["max"]], [d(p), null.mean(), np.percentile(null, 95), null.max()])
    assert got["reps"] == 40 and got["p"] == pytest.approx(((null >= d(p)).sum() + 1) / 41)
    none = A.shuffled_label_null(rows.where("id < 0"), "v", "p", "id", 5, 40, 7).first()
    assert none["reps"] == 0 and none["real"] is None


def test_reference_shares_take_the_weakest_quadrant(spark):
    rows = [("a", "x")] * 90 + [("a", "y")] * 2 + [("b", "x")] * 20 + [("b", "y")] * 20 + [("b", "z")] * 3 + [("c", "other")] * 9
    df = spark.createDataFrame(rows, "q string, g string")
    got = O.reference_proportions(df, "q", "g", ["a", "b"], ["x", "y"], 40, 0.1, 0.5).orderBy("g").collect()
    assert [(r["g"], r["reference"], r["capacity"], r["n"]) for r in got] == [("x", "a", 22, 90), ("y", "a", 22, 2)]
    assert [r["share"] for r in got] == pytest.approx([0.5 / 0.6, 0.1 / 0.6])
    empty = O.reference_proportions(df.where("q = 'd'"), "q", "g", ["b", "a"], ["x", "y"], 40, 0.0, 0.5).collect()
    assert {(r["reference"], r["capacity"], r["raw_share"], r["share"]) for r in empty} == {("b", 0, 0.0, 0.0)}


def test_years_of_five_digits_have_no_sign(spark):
    df = spark.createDataFrame([(1, 1000000000 + 3_000_000 * 86413), (2, 253402300799)], "i int, v long")
    assert values(df, X.epoch_date(F.col("v"))) == ["10216-08-24", "9999-12-31"]


def test_distributions_are_computed_once_a_row(spark):
    """No sum, mean or deviation is repeated inside a lambda, where it would be computed again for each part."""
    df = spark.createDataFrame([([0.1, 0.2, 0.3, 0.4],)], "q array<double>")
    plan = lambda c: df.select(c.alias("r"))._jdf.queryExecution().analyzed().toString().lower()
    text = plan(P.prior_runtime(F.col("q"), F.element_at("q", 1)))
    assert text.count("exp(") == text.count("sqrt(") == text.count("array_max(") == 1
    assert plan(P.floored(F.col("q"), 0.1)).count("greatest(") == 1
