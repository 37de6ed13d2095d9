"""Queries of evaluation summaries and of the variants of smaller operators that raise, re-norm or report."""

from __future__ import annotations

from pyspark.sql import functions as F

from textaxis.functions import policy as P
from textaxis.functions import text as X
from textaxis.functions import vectors as V
from textaxis.operators import axes as A
from textaxis.operators import corpus as O
from textaxis.operators import evaluation as E
from textaxis.operators import reports as R
from textaxis.operators import stats as S
from textaxis.plans.policy_queries import SCORES, parts, parts_sql, scores
from textaxis.plans.registry import Registry
from textaxis.plans.vector_queries import SCORED

registry = Registry()
query = registry.query

_SHIFTS = ("mean_econ", "mean_social", "mean_delta_econ", "mean_delta_social", "mean_shift", "median_shift", "flip_rate", "resistance")


def _quadrant_sql(econ: str, social: str) -> str:
    return f"case when {econ} is not null and {social} is not null then case when {econ} >= 0 then 'right' else 'left' end || '_' || case when {social} >= 0 then 'auth' else 'lib' end end"


@query("a27_j7_persona_shifts", f"""
    with e as (select event_type as system, (user_id % 20)::bigint as persona, value / 100 - 0.5 as econ, (event_id % 7) / 7 - 0.5 as social, case when event_id % 6 > 0 then (event_id % 5) / 5 - 0.4 end as pe, (event_id % 11) / 11 - 0.3 as ps from events),
    r as (select *, econ - pe as de, case when pe is not null then social - ps end as ds0, social - ps as ds, sqrt((econ - pe) * (econ - pe) + (social - ps) * (social - ps)) as shift,
      ({_quadrant_sql('econ', 'social')} <> {_quadrant_sql('pe', 'ps')})::int as flip from e),
    g as (select system, persona, count(*) as n_records, avg(econ) as mean_econ, avg(social) as mean_social, avg(de) as mean_delta_econ, avg(ds) as mean_delta_social, avg(shift) as mean_shift, median(shift) as median_shift, avg(flip) as flip_rate from r group by 1, 2)
    select g.system, g.persona, g.n_records, {', '.join(f'round(g.{c}, 6) as {c}' for c in _SHIFTS[:-1])}, round(b.mean_shift - g.mean_shift, 6) as resistance from g left join g b on b.system = 'view' and b.persona = g.persona""")
def _(t):
    """Each system's shifts under each persona, and its resistance against the base system's mean shift there."""
    e, v = F.col("event_id"), F.col("value") / 100 - 0.5
    rows = t("events").select(
        F.col("event_type").alias("system"), (F.col("user_id") % 20).alias("persona"), v.alias("econ"), ((e % 7) / 7 - 0.5).alias("social"),
        F.when(e % 6 > 0, (e % 5) / 5 - 0.4).alias("plain_econ"), ((e % 11) / 11 - 0.3).alias("plain_social"))
    rows = rows.withColumn("quadrant", V.quadrant(F.col("econ"), F.col("social"))).withColumn("plain_quadrant", V.quadrant(F.col("plain_econ"), F.col("plain_social")))
    got = E.persona_shifts(rows, "system", "persona", "view")
    return got.select("system", "persona", "n_records", *[F.round(c, 6).alias(c) for c in _SHIFTS])


_LABELS = [*E.STANCES, E.INCOHERENT, None]


@query("a34_stance_report", f"""
    with r as (select event_type as system, ([{', '.join(f"'{s}'" if s else 'null' for s in _LABELS)}])[event_id % 7 + 1] as stance, ([-2, -1, 0, 1, 2, null, null])[event_id % 7 + 1] * case when event_id % 3 = 0 then -1 else 1 end as pt,
      case when event_id % 2 = 0 then 'economic' else 'social' end as axis, value > 50 as sure from events),
    g as (select system, count(*) as n, count(pt) as n_scored, avg(pt) filter (where axis = 'economic') as economic, avg(pt) filter (where axis = 'social') as social, avg(pt) filter (where axis = 'economic' and sure) as es, avg(pt) filter (where axis = 'social' and sure) as ss,
      {', '.join(f"count(*) filter (where stance = '{s}') as n_{s}" for s in _LABELS if s)} from r group by system)
    select system, n, n_scored, round(economic, 6) as economic, round(social, 6) as social, round(sqrt(economic * economic + social * social), 6) as radius, round(es, 6) as economic_sure, round(ss, 6) as social_sure, round(sqrt(es * es + ss * ss), 6) as radius_sure,
      round(n_neutral / n, 6) as share_neutral, round(n_incoherent / n, 6) as share_incoherent, {', '.join(f'n_{s}' for s in _LABELS if s)} from g""")
def _(t):
    """Judged stances of each system: both axes, radius, rows judged with confidence apart, all counts."""
    e = F.col("event_id")
    rows = t("events").select(
        F.col("event_type").alias("system"), F.element_at(F.array(*[F.lit(s) for s in _LABELS]), (e % 7 + 1).cast("int")).alias("stance"), F.when(e % 3 == 0, -1).otherwise(1).alias("polarity"),
        F.when(e % 2 == 0, "economic").otherwise("social").alias("axis"), "value")
    got = E.stance_report(rows, "system", F.col("value") > 50)
    return got.select(*[F.round(c, 6).alias(c) if k == "double" else c for c, k in got.dtypes])


@query("a20_weighted_axis", """
    with e as (select vec_id, label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as v from embeddings),
    m as (select label, i, sum(v * greatest(vec_id % 3, 1e-12)) / sum(greatest(vec_id % 3, 1e-12)) as m from e group by label, i)
    select label, (i - 1)::int as place, round(m / sqrt(sum(m * m) over (partition by label)), 6) as part from m""")
def _(t):
    """Weighted mean vectors of the labels, normalized again."""
    got = A.weighted_axis(t("embeddings").withColumn("w", (F.col("vec_id") % 3).cast("double")), ["label"], "embedding", "w")
    return got.select("label", F.posexplode("axis").alias("place", "part")).select("label", "place", F.round("part", 6).alias("part"))


@query("v22_layer_orthogonality", f"""
    with {SCORED}, c as (select (i > 32)::int as layer, sum(econ * soc) / (sqrt(sum(econ * econ)) * sqrt(sum(soc * soc)) + 1e-12) as c from x group by 1)
    select layer, round(c, 6) as cosine, round(max(abs(c)) over (), 6) as max_abs from c""")
def _(t):
    """Cosine of both axes at each half of the embedding, and the largest of them."""
    e = t("embeddings")
    a = A.mean_difference_axis(e, "embedding", F.col("label") >= 5, True).select(F.col("axis").alias("a"))
    b = A.mean_difference_axis(e, "embedding", F.col("label") % 2 == 0, True).select(F.col("axis").alias("b"))
    half = lambda k: F.struct(F.lit(k).alias("layer"), F.slice("a", 1 + 32 * k, 32).alias("a"), F.slice("b", 1 + 32 * k, 32).alias("b"))
    axes = a.join(b).select(F.inline(F.array(half(0), half(1))))  # one row each
    return E.axis_orthogonality(axes, "layer", "a", "b").select("layer", F.round("cosine", 6).alias("cosine"), F.round("max_abs", 6).alias("max_abs"))


@query("v27_rescored_mixture", f"""
    with {SCORED}, h as (select vec_id // 4 as g, i, sum(v * (1 + vec_id % 4) / 10) as h from (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as v from embeddings) group by 1, 2 having count(*) = 4),
    hn as (select g, sqrt(sum(h * h)) as n from h group by g), hs as (select g, sum(h / n * econ) as e, sum(h / n * soc) as s from h join hn using (g) join x using (i) group by g)
    select g, round(e, 6) as econ, round(s, 6) as social, round(sqrt(e * e + s * s), 6) as bias, {_quadrant_sql('e', 's')} as quadrant from hs""")
def _(t):
    """Four states mixed, normalized and scored again on both axes."""
    e = t("embeddings")
    econ = A.mean_difference_axis(e, "embedding", F.col("label") >= 5, True).select(F.col("axis").alias("e"))
    soc = A.mean_difference_axis(e, "embedding", F.col("label") % 2 == 0, True).select(F.col("axis").alias("s"))
    four = e.groupBy(F.expr("vec_id div 4").alias("g")).agg(*[F.max(F.when(F.col("vec_id") % 4 == k, F.col("embedding"))).alias(f"h{k}") for k in range(4)])
    four = four.where("h0 is not null and h1 is not null and h2 is not null and h3 is not null").join(F.broadcast(econ.join(soc)))  # one row of axes
    mix = V.mixture([F.lit((1 + k) / 10) for k in range(4)], [F.col(f"h{k}") for k in range(4)])
    got = four.select("g", V.rescored(mix, F.col("e"), F.col("s")).alias("r")).select("g", "r.*")
    return got.select("g", *[F.round(c, 6).alias(c) for c in ("econ", "social", "bias")], "quadrant")


@query("j3_must_match", "select s_suppkey, n_name from supplier join nation on s_nationkey = n_nationkey")
def _(t):
    """Each supplier with its nation's name; a nation that isn't known would raise."""
    nations = t("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return E.must_match(t("supplier").select("s_suppkey", "s_nationkey"), nations, "s_nationkey", "n_name").select("s_suppkey", "n_name")


@query("x11_strict_verdicts", "select event_id, case event_id % 3 when 0 then 'A' when 1 then 'B' else 'tie' end as neutrality, 'A' as coherence, case when value > 50 then 'B' else 'tie' end as relevance from events")
def _(t):
    """Judges' verdicts out of their answers; an answer without one would raise."""
    e = F.col("event_id")
    winner = F.when(e % 3 == 0, "A").when(e % 3 == 1, "B").otherwise("tie")
    body = F.concat(F.lit('Sure: {"neutrality": "'), winner, F.lit('",\n"coherence": "A", "relevance": "'), F.when(F.col("value") > 50, "B").otherwise("tie"), F.lit('"}\nDone.'))
    return t("events").select("event_id", X.strict_verdict(body).alias("v")).select("event_id", "v.*")


@query("f9_refused", """
    with o as (select conv_id, turn, ['Refused', role, 'I REFUSED: ' || role, substr(text, 1, 12)] as o from conversations)
    select conv_id, turn, array_to_string(list_filter(o, lambda x: x <> 'Refused'), '|') as equal, array_to_string(list_filter(o, lambda x: not contains(lower(x), 'refused')), '|') as inside from o""")
def _(t):
    """Options without the refusal, by equality and by what they mention."""
    o = F.array(F.lit("Refused"), F.col("role"), F.concat(F.lit("I REFUSED: "), F.col("role")), F.substring("text", 1, 12))
    return t("conversations").select("conv_id", "turn", F.array_join(X.without_refused(o), "|").alias("equal"), F.array_join(X.without_refused(o, within=True), "|").alias("inside"))


@query("d10_adjacent", f"""
    with {SCORES}, t as (select event_id, list_position(q, list_max(q)) in (1, 4) as outer_top, k from q, (values (0), (1)) v(k)),
    s as (select event_id, k, case when outer_top then 1 else 0 end as a, case when outer_top then 2 else 3 end as b from t)
    select event_id, k as variant, {', '.join(f"round(case {i} when case k when 0 then a else b end then 2.25 when case k when 0 then b else a end then 0.75 else 0.25 end / 3.5, 6)::double as p{i}" for i in range(4))} from s""")
def _(t):
    """Both policies raised at one side of the largest score."""
    variants = F.array(*P.adjacent_variants(F.col("q")))
    return scores(t).select("event_id", F.posexplode(variants).alias("variant", "c")).select("event_id", "variant", *parts(F.col("c")))


@query("d12_target_records", f"""
    with {SCORES}, s as (select user_id, event_id, p, q[1] as s, exp(q[1] - max(q[1]) over (partition by user_id)) as w from p),
    m as (select user_id, count(*) as n, max(s) as best, first(p order by s desc, event_id) as bp, [sum(w * p[1]) / sum(w), sum(w * p[2]) / sum(w), sum(w * p[3]) / sum(w), sum(w * p[4]) / sum(w)] as m from s group by user_id),
    x as (select *, list_transform(m, lambda v: greatest(v - 0.01, 0.0)) as x from m), r as (select *, list_transform(x, lambda v: 0.01 + 0.96 * v / list_sum(x)) as r from x)
    select user_id, n as n_candidates, round(best, 6) as best_score, {parts_sql('bp')}, round(-list_sum(list_transform(r, lambda v: v * ln(v))), 6) as entropy,
      round(r[1] * ln(r[1] / 0.1) + r[2] * ln(r[2] / 0.2) + r[3] * ln(r[3] / 0.3) + r[4] * ln(r[4] / 0.4), 6) as kl_to_prior from r""")
def _(t):
    """Target records with their diagnostics: candidates, best score and policy, entropy, divergence from the prior."""
    rows = scores(t).withColumn("s", F.element_at("q", 1)).withColumn("prior", F.array(*[F.lit(x) for x in (0.1, 0.2, 0.3, 0.4)]))
    got = E.target_records(rows, "user_id", "event_id", "p", "s", "prior")
    return got.select("user_id", "n_candidates", F.round("best_score", 6).alias("best_score"), *parts(F.col("best_policy")), F.round("entropy", 6).alias("entropy"), F.round("kl_to_prior", 6).alias("kl_to_prior"))


@query("d13_over_median", f"""
    with {SCORES}, m as (select median(value / 50) as m from events where event_type = 'view')
    select event_id, round(-(q[1] * 2) / m + 0.5 * q[3] - 0.5 * (event_id % 2) - 0.25 * q[1] - 0.1 * list_sum(list_transform(p, lambda v: v * ln(v / 0.25))) / ln(4), 6) as score from p, m""")
def _(t):
    """Candidates' scores with the bias over the median of a baseline's rows."""
    q = lambda i: F.element_at("q", i)
    base = t("events").where("event_type = 'view'").select((F.col("value") / 50).alias("bias"))
    median = S.quantiles(base, "bias", [], {"median": 0.5}).select("median")  # one row
    s = P.final_score(q(1) * 2, q(3), (F.col("event_id") % 2).cast("double"), q(1), P.kl_strict(F.col("p"), P.uniform()), median=F.col("median"))
    return scores(t).crossJoin(F.broadcast(median)).select("event_id", F.round(s, 6).alias("score"))


@query("l6_source_allocation", """
    with n as (select source, count(*) as n from documents group by source), f as (select *, floor(n * 0.8) as a, floor(n * 0.1) as b, round(n * 0.8 - floor(n * 0.8), 9) as ra, round(n * 0.1 - floor(n * 0.1), 9) as rb from n),
    g as (select *, n - a - 2 * b as l from f),
    h as (select source, n, a + ((rb > ra)::int * 2 < l)::int as a, b + ((ra >= rb)::int < l)::int as v, b + ((ra >= rb)::int + 1 < l)::int as t from g),
    k as (select source, n, a - (v = 0)::int - (t = 0)::int as a, greatest(v, 1) as v, greatest(t, 1) as t from h)
    select source, n, (case when n <= 2 then 1 else a end)::bigint as train, (case n when 1 then 0 when 2 then 1 else v end)::bigint as val, (case when n < 3 then 0 else t end)::bigint as test from k""")
def _(t):
    """Sizes of a three-way split of each source's documents."""
    by = t("documents").groupBy("source").agg(F.count("*").alias("n"))
    return by.select("source", "n", O.three_way_counts(F.col("n").cast("double")).alias("c")).select("source", "n", "c.*")


@query("q16_pair_report", """
    with r as (select [x for x in [case when k % 9 = 0 then 'invalid_axis' end, case when k % 5 = 0 then 'empty_text' end, case when k % 7 = 0 then 'identical_exact' end, case when k % 5 = 0 or k % 7 <> 0 and k % 4 = 0 then 'length_ratio' end] if x is not null] as x from (select event_id as k from events) where k % 35 <> 0)
    select count(*) as n_pairs, count(*) filter (where len(x) = 0) as n_valid, count(*) filter (where len(x) > 0) as n_rejected, round(avg((len(x) = 0)::int), 6) as share_valid,
      (select string_agg(reason || '=' || n, ',' order by reason) from (select reason, count(*) as n from (select unnest(x) as reason from r) group by reason)) as reasons from r""")
def _(t):
    """Contrast pairs split into valid and rejected ones, with the report."""
    k = F.col("event_id")
    a = F.lit("left words here")
    b = F.when(k % 5 == 0, "  ").when(k % 7 == 0, a).when(k % 4 == 0, "many more words than the other one of them has").otherwise("right words here")
    pairs = t("events").where("event_id % 35 <> 0").select("event_id", a.alias("a"), b.alias("b"), F.when(k % 9 == 0, "other").otherwise("social").alias("axis"))
    _valid, _rejected, report = E.pair_split(pairs, R.pair_reasons(F.col("a"), F.col("b"), F.col("axis")))
    entries = F.array_join(F.transform(F.map_entries("reasons"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return report.select("n_pairs", "n_valid", "n_rejected", F.round("share_valid", 6).alias("share_valid"), entries.alias("reasons"))
