"""Queries of the distribution algebra over four scores made from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from textaxis.functions import policy as P
from textaxis.operators import reports as R
from textaxis.plans.registry import Registry

registry = Registry()
query = registry.query

#: Concentration of the fans' draws.
CONCENTRATION = 64.0
#: Four scores and a prior per event, in both languages.
SCORES = """
    q as (select event_id, user_id, [value / 100, (event_id % 7) / 7 - 0.5, (event_id % 5) / 5, (event_id % 11) / 11 - 0.3] as q from events),
    b as (select event_id, user_id, q, list_transform(q, lambda v: exp(-v - list_max(list_transform(q, lambda w: -w)))) as e from q),
    p as (select event_id, user_id, q, list_transform(e, lambda v: v / list_sum(e)) as p from b)"""


def scores(t):
    e = F.col("event_id")
    q = F.array(F.col("value") / 100, (e % 7) / 7 - 0.5, (e % 5) / 5, (e % 11) / 11 - 0.3)
    return t("events").select("event_id", "user_id", q.alias("q")).withColumn("p", P.prior_raw(F.col("q")))


def parts(column, digits=6):
    return [F.round(F.element_at(column, i + 1), digits).alias(f"p{i}") for i in range(4)]


def parts_sql(x: str) -> str:
    return ", ".join(f"round(({x})[{i + 1}], 6) as p{i}" for i in range(4))


@query("d1_d2_prior_raw", f"with {SCORES} select event_id, {parts_sql('p')} from p")
def _(t):
    return scores(t).select("event_id", *parts(F.col("p")))


@query("d2_prior_runtime", f"""
    with {SCORES}, z as (select event_id, q, list_avg(q) as m, sqrt(list_avg(list_transform(q, lambda v: (v - list_avg(q)) * (v - list_avg(q))))) as s, q[1] < 0.05 as gated from q),
    y as (select event_id, gated, list_transform(q, lambda v: case when s < 1e-8 then 0.0 else (v - m) / s end) as z from z), x as (select event_id, gated, list_transform(z, lambda v: exp(-v)) as e from y),
    r as (select event_id, case when gated then [0.25, 0.25, 0.25, 0.25]::double[] else list_transform(e, lambda v: v / list_sum(e)) end as r from x) select event_id, {parts_sql('r')} from r""")
def _(t):
    return scores(t).select("event_id", *parts(P.prior_runtime(F.col("q"), F.element_at("q", 1))))


@query("d3_calibrated", f"""
    with {SCORES}, c as (select event_id, [p[1] * exp(0.5), p[2], p[3] * exp(-0.25), p[4]] as c from p), r as (select event_id, list_transform(c, lambda v: v / list_sum(c)) as r from c) select event_id, {parts_sql('r')} from r""")
def _(t):
    delta = F.array(*map(F.lit, (0.5, 0.0, -0.25, 0.0)))
    return scores(t).select("event_id", *parts(P.calibrated(F.col("p"), delta)))


@query("d4_entropy", f"with {SCORES} select event_id, round(-list_sum(list_transform(p, lambda v: v * ln(v))), 6) as entropy, round(-list_sum(list_transform(p, lambda v: v * ln(v))) / ln(4), 6) as share from p")
def _(t):
    return scores(t).select("event_id", F.round(P.entropy(F.col("p")), 6).alias("entropy"), F.round(P.entropy_share(F.col("p")), 6).alias("share"))


@query("d5_d6_divergences", f"""
    with {SCORES} select event_id, round(list_sum(list_transform(p, lambda v: v * ln((v + 1e-9) / (0.25 + 1e-9)))), 6) as kl_smoothed, round(greatest(0.0, list_sum(list_transform(p, lambda v: greatest(v, 1e-12) * ln(greatest(v, 1e-12) / 0.25)))), 6) as kl_clamped,
      round(list_sum(list_transform(p, lambda v: v * ln(v / 0.25))), 6) as kl_strict, round(list_sum(list_transform(p, lambda v: abs(v - 0.25))), 6) as l1 from p""")
def _(t):
    p, u = F.col("p"), P.uniform()
    return scores(t).select("event_id", *[F.round(x, 6).alias(n) for n, x in (("kl_smoothed", P.kl_smoothed(p, u)), ("kl_clamped", P.kl_clamped(p, u)), ("kl_strict", P.kl_strict(p, u)), ("l1", P.l1(p, u)))])


@query("d7_d22_argmax", f"with {SCORES} select k, count(*) as n from (select ['left_lib', 'left_auth', 'right_lib', 'right_auth'][list_position(p, list_max(p))] as k from p) group by k")
def _(t):
    return scores(t).groupBy(P.argmax_key(F.col("p")).alias("k")).agg(F.count("*").alias("n"))


@query("d8_d19_sharpen", f"""
    with {SCORES}, c as (select event_id, list_transform(p, lambda v: v * v) as c from p), r as (select event_id, list_transform(c, lambda v: v / list_sum(c)) as r from c) select event_id, {parts_sql('r')}, true as same from r""")
def _(t):
    a, b = P.sharpen(F.col("p"), 0.5), P.resample(F.col("p"), 0.5)
    return scores(t).select("event_id", *parts(a), P.same_within(a, b, 1e-6).alias("same"))


@query("d9_floor", f"""
    with {SCORES}, c as (select event_id, list_transform(p, lambda v: greatest(v - 0.1, 0.0)) as x from p), r as (select event_id, list_transform(x, lambda v: 0.1 + 0.6 * v / list_sum(x)) as r from c) select event_id, {parts_sql('r')} from r""")
def _(t):
    return scores(t).select("event_id", *parts(P.floored(F.col("p"), 0.1)))


@query("d20_clip", f"""
    with {SCORES}, c as (select event_id, list_transform(p, lambda v: greatest(v, 0.1)) as x from p), r as (select event_id, list_transform(x, lambda v: v / list_sum(x)) as r from c) select event_id, {parts_sql('r')} from r""")
def _(t):
    return scores(t).select("event_id", *parts(P.clipped(F.col("p"), 0.1)))


@query("d10_opposite", f"""
    with {SCORES}, t as (select event_id, list_position(q, list_max(q)) as t from q)
    select event_id, {', '.join(f"(case t when {i + 1} then 0.05 when {4 - i} then 0.45 else 0.25 end)::double as p{i}" for i in range(4))} from t""")
def _(t):
    return scores(t).select("event_id", *parts(P.opposite_heavy(F.col("q"))))


@query("d11_fan")
def _(t):
    """Candidates per prompt after tolerance dedupe; the tests hold the fold against a plain loop."""
    draws = P.dirichlet_draws(F.array(*[F.element_at("p", i + 1) * CONCENTRATION for i in range(4)]), F.col("event_id") + 42)
    fan = P.keep_first_distinct(P.candidate_fan(F.col("p"), F.col("q"), draws=F.col("draws")))
    return scores(t).withColumn("draws", draws).select("event_id", F.posexplode(fan).alias("candidate", "c")).select("event_id", "candidate", *parts(F.col("c")))


@query("d21_standalone_fan")
def _(t):
    """The other runner's candidates, with repeats."""
    draws = P.dirichlet_draws(F.array(*[F.lit(CONCENTRATION)] * 4), F.col("event_id") + 42)
    rows = scores(t).withColumn("draws", draws)
    return rows.select("event_id", F.posexplode(P.standalone_fan(F.col("p"), draws=F.col("draws"))).alias("candidate", "c")).select("event_id", "candidate", *parts(F.col("c")))


@query("l15_dirichlet")
def _(t):
    """Seeded Dirichlet draws; the tests check the sums and the repeatability."""
    draws = P.dirichlet_draws(F.col("p"), F.col("event_id") + 42)
    return scores(t).select("event_id", F.posexplode(draws).alias("draw", "c")).select("event_id", "draw", *parts(F.col("c")))


@query("d12_targets", f"""
    with {SCORES}, s as (select user_id, event_id, p, exp(q[1] - max(q[1]) over (partition by user_id)) as w from p),
    m as (select user_id, count(*) as n, [sum(w * p[1]) / sum(w), sum(w * p[2]) / sum(w), sum(w * p[3]) / sum(w), sum(w * p[4]) / sum(w)] as m from s group by user_id),
    x as (select user_id, n, list_transform(m, lambda v: greatest(v - 0.01, 0.0)) as x from m), r as (select user_id, n, list_transform(x, lambda v: 0.01 + 0.96 * v / list_sum(x)) as r from x)
    select user_id, n as n_candidates, {parts_sql('r')}, round(-list_sum(list_transform(r, lambda v: v * ln(v))), 6) as entropy from r""")
def _(t):
    rows = scores(t).withColumn("s", F.element_at("q", 1))
    got = R.candidate_targets(rows, "user_id", "p", "s")
    return got.select("user_id", "n_candidates", *parts(F.col("target")), F.round("entropy", 6).alias("entropy"))


@query("d13_final_score", f"""
    with {SCORES} select event_id, round(-abs(q[2]) + 0.5 * q[3] - 0.5 * (event_id % 2) - 0.25 * q[1] - 0.1 * list_sum(list_transform(p, lambda v: v * ln(v / 0.25))) / ln(4), 6) as score from p""")
def _(t):
    q = lambda i: F.element_at("q", i)
    s = P.final_score(F.abs(q(2)), q(3), (F.col("event_id") % 2).cast("double"), q(1), P.kl_strict(F.col("p"), P.uniform()))
    return scores(t).select("event_id", F.round(s, 6).alias("score"))


@query("d14_consistency", f"""
    with {SCORES}, s as (select user_id, {', '.join(f'max(p[{i}]) - min(p[{i}]) as s{i}' for i in range(1, 5))} from p group by user_id)
    select user_id, round(greatest(s1, s2, s3, s4), 6) as spread, greatest(s1, s2, s3, s4) <= 1e-6 as consistent from s""")
def _(t):
    part = lambda i: F.element_at("p", i)
    spread = F.greatest(*[F.max(part(i)) - F.min(part(i)) for i in range(1, 5)])
    return scores(t).groupBy("user_id").agg(F.round(spread, 6).alias("spread"), (spread <= 1e-6).alias("consistent"))


def _edit_sql(steps: int = 10) -> str:
    """The loop's steps one by one; each embedding's quarters are the four states."""
    four, sixteen = range(1, 5), [(i, j) for i in range(1, 5) for j in range(1, 5)]
    total = lambda x: " + ".join(x.format(i=i) for i in four)
    state = ", ".join([f"h{i}" for i in four])
    made = ", ".join([f"e{i}, s{i}" for i in four] + [f"g{i}{j}" for i, j in sixteen])
    axis = "list_transform(range(16), lambda i: {})"
    out = f"""v as (select vec_id, {', '.join(f'embedding[{16 * i - 15}:{16 * i}]::double[] as h{i}' for i in four)}, {', '.join(f'1 + vec_id % {i + 1} as r{i}' for i in four)} from embeddings),
    n0 as materialized (select vec_id, {', '.join(f"list_inner_product(h{i}, {axis.format('0.25::double')}) as e{i}, list_inner_product(h{i}, {axis.format('(0.25 - 0.5 * (i % 2))::double')}) as s{i}" for i in four)},
      {', '.join(f'list_inner_product(h{i}, h{j}) as g{i}{j}' for i, j in sixteen)}, {', '.join(f'r{i} / (r1 + r2 + r3 + r4) as p{i}, (vec_id % {i + 4}) / 10 - 0.2 as a{i}' for i in four)}, 0 as steps, null::varchar as reason from v)"""
    for k in range(1, steps + 1):
        out += f""",
    w{k} as materialized (select *, {', '.join(f'p{i}::double * exp(-a{i}::double) as w{i}' for i in four)} from n{k - 1}),
    q{k} as materialized (select *, {', '.join(f'w{i} / ({total("w{i}")}) as q{i}' for i in four)} from w{k}),
    m{k} as materialized (select *, sqrt({' + '.join(f'q{i} * q{j} * g{i}{j}' for i, j in sixteen)}) as size from q{k}),
    x{k} as materialized (select *, ({total("q{i} * e{i}")}) / size as x, ({total("q{i} * s{i}")}) / size as y from m{k}),
    b{k} as materialized (select *, (-x - y) / sqrt(2) as b1, (y - x) / sqrt(2) as b2, (x - y) / sqrt(2) as b3, (x + y) / sqrt(2) as b4 from x{k}),
    n{k} as materialized (select vec_id, {made}, {', '.join(f'case when reason is null then q{i} else p{i} end as p{i}, case when reason is null then b{i} else a{i} end as a{i}' for i in four)}, steps + (reason is null)::int as steps,
      case when reason is not null then reason when least(abs(x), abs(y)) <= 0.015 then 'axis_proximity'
        when greatest({', '.join(f'abs(q{i} - p{i}), abs(b{i} - a{i})' for i in four)}) <= 1e-3 then 'converged' end as reason from b{k})"""
    return f"with {out} select vec_id, steps, reason, {', '.join(f'round(p{i}, 4) as p{i - 1}, round(a{i}, 4) as a{i - 1}' for i in four)} from n{steps}"


@query("d15_edit_loop", _edit_sql())
def _(t):
    """Policies edited until the mixture of an embedding's quarters is near an axis."""
    k = F.col("vec_id")
    states = F.array(*[F.slice("embedding", 16 * i + 1, 16) for i in range(4)])
    econ, social = F.array(*[F.lit(0.25)] * 16), F.array(*[F.lit(0.25 - 0.5 * (i % 2)) for i in range(16)])
    start = P.normalize(F.array(*[(1 + k % (i + 2)).cast("double") for i in range(4)]))
    align = F.array(*[(k % (i + 5)) / 10 - 0.2 for i in range(4)])
    got = t("embeddings").select("vec_id", P.edit_loop(start, align, states, econ, social).alias("r"))
    return got.select("vec_id", "r.steps", "r.reason", *parts(F.col("r.policy"), 4), *[F.round(F.element_at("r.align", i + 1), 4).alias(f"a{i}") for i in range(4)])


@query("d18_initial_mixture", f"with {SCORES}, m as (select event_id, case when event_id % 2 = 0 then p else [0.25, 0.25, 0.25, 0.25]::double[] end as m from p) select event_id, {parts_sql('m')} from m")
def _(t):
    mode = F.when(F.col("event_id") % 2 == 0, "router").otherwise("uniform")
    return scores(t).select("event_id", *parts(P.initial_mixture(mode, F.col("p"))))


@query("a29_target_report", f"""
    with {SCORES}, s as (select user_id, event_id, p, q[1] as q1, exp(q[1] - max(q[1]) over (partition by user_id)) as w from p),
    m as (select user_id, count(*) as n, max(q1) as best, [sum(w * p[1]) / sum(w), sum(w * p[2]) / sum(w), sum(w * p[3]) / sum(w), sum(w * p[4]) / sum(w)] as m from s group by user_id),
    x as (select *, list_transform(m, lambda v: greatest(v - 0.01, 0.0)) as x from m), r as (select *, list_transform(x, lambda v: 0.01 + 0.96 * v / list_sum(x)) as r from x)
    select count(*) as n_records, round(avg(n), 6) as mean_candidates, round(avg(best), 6) as mean_best, round(avg(-list_sum(list_transform(r, lambda v: v * ln(v)))), 6) as mean_entropy,
      round(avg(list_sum(list_transform(r, lambda v: v * ln(v / 0.25)))), 6) as mean_kl from r""")
def _(t):
    got = R.target_report(R.candidate_targets(scores(t).withColumn("s", F.element_at("q", 1)), "user_id", "p", "s"), P.uniform())
    return got.select("n_records", *[F.round(c, 6).alias(c) for c in got.columns[1:]])


@query("a36_opposite_peak", f"with {SCORES} select user_id % 10 as g, count(*) as n, round(avg((list_position(p, list_max(p)) = 5 - list_position(q, list_max(q)))::int), 6) as opposite from p group by 1")
def _(t):
    """How often a policy peaks across the quadrant with the largest score."""
    peak = lambda x: F.array_position(x, F.array_max(x))
    across = (peak(F.col("p")) == 5 - peak(F.col("q"))).cast("double")
    return scores(t).groupBy((F.col("user_id") % 10).alias("g")).agg(F.count("*").alias("n"), F.round(F.avg(across), 6).alias("opposite"))


@query("a37_diagnostics", f"""
    with {SCORES} select event_id, round(-list_sum(list_transform(p, lambda v: v * ln(v))), 6) as entropy, round(list_max(p), 6) as max_weight, ['left_lib', 'left_auth', 'right_lib', 'right_auth'][list_position(p, list_max(p))] as top, q[1] < 0.05 as fallback from p""")
def _(t):
    p = F.col("p")
    return scores(t).select("event_id", F.round(P.entropy(p), 6).alias("entropy"), F.round(F.array_max(p), 6).alias("max_weight"), P.argmax_key(p).alias("top"), (F.element_at("q", 1) < 0.05).alias("fallback"))


@query("a28_router_summary", f"""
    with {SCORES}, d as (select list_sum(list_transform(p, lambda v: abs(v - 0.25))) as l, list_position(p, list_max(p)) = 1 as hit from p)
    select count(*) as n, round(avg(l), 6) as mean, round(quantile_cont(l, 0.5), 6) as median, round(avg(hit::int), 6) as top1 from d""")
def _(t):
    d = scores(t).select(P.l1(F.col("p"), P.uniform()).alias("l"), (P.argmax_key(F.col("p")) == "left_lib").alias("hit"))
    return d.agg(F.count("*").alias("n"), F.round(F.avg("l"), 6).alias("mean"), F.round(F.percentile("l", 0.5), 6).alias("median"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("top1"))


@query("q14_q15_violations", f"""
    with {SCORES}, v as (select event_id % 9000 as k, event_id % 13 = 0 as bad, event_id % 1200 >= 1000 as far, count(*) over (partition by event_id % 9000) > 1 as again from p)
    select violation, count(*) as n from (select 'bad_policy' as violation from v where bad union all select 'bad_reference' from v where far union all select 'repeated_id' from v where again) group by violation""")
def _(t):
    e = F.col("event_id")
    rows = scores(t).select((e % 9000).alias("k"), "q", F.when(e % 13 == 0, F.transform("p", lambda x: x * 2)).otherwise(F.col("p")).alias("p"), F.concat(F.lit("hidden.pt:"), (e % 1200).cast("string")).alias("ref"))
    return R.record_violations(rows, "k", "q", "p", "ref", 1000).groupBy("violation").agg(F.count("*").alias("n"))
