"""Queries of the vector, axis and statistics operators over ``embeddings``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from textaxis.functions import vectors as V
from textaxis.operators import axes as A
from textaxis.operators import reports as R
from textaxis.operators import resampling as RS
from textaxis.operators import router as RT
from textaxis.operators import stats as S
from textaxis.operators.corpus import folds
from textaxis.plans.registry import Registry

registry = Registry()
query = registry.query

SCORED = """
    e as (select vec_id, label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as v from embeddings),
    n as (select vec_id, sqrt(sum(v * v)) as n from e group by vec_id),
    u as (select e.vec_id, label, i, v / n as v from e join n using (vec_id)),
    m as (select i, avg(v) filter (where label >= 5) - avg(v) filter (where label < 5) as econ, avg(v) filter (where label % 2 = 0) - avg(v) filter (where label % 2 <> 0) as soc from u group by i),
    x as (select i, econ / sqrt((select sum(econ * econ) from m)) as econ, soc / sqrt((select sum(soc * soc) from m)) as soc from m),
    s as (select vec_id, label, sum(v * econ) as se, sum(v * soc) as ss from u join x using (i) group by vec_id, label),
    scored as (select *, case when se >= 0 then 'right' else 'left' end || '_' || case when ss >= 0 then 'auth' else 'lib' end as quadrant, least(abs(se), abs(ss)) as margin from s)"""


def scored(t):
    return A.scored_items(t("embeddings"), "embedding", "label")


@query("entry_quadrants", f"""
    with {SCORED}, kept as (select * from scored where abs(se) >= 0.0 and abs(ss) >= 0.0 and margin >= 0.015),
    r as (select *, row_number() over (partition by quadrant order by margin desc, vec_id) as rank from kept)
    select quadrant, count(*) as n_retained, round(avg(margin), 6) as mean_margin, round(avg(margin) filter (where rank <= 5), 6) as top5_margin from r group by quadrant""")
def _(t):
    kept = scored(t).where(V.passes_thresholds(F.col("score_econ"), F.col("score_soc"), 0.0, 0.0, 0.015))
    top = A.top_examples(kept, "quadrant", "margin", "vec_id", 5).groupBy("quadrant").agg(F.round(F.avg("margin"), 6).alias("top5_margin"))
    return kept.groupBy("quadrant").agg(F.count("*").alias("n_retained"), F.round(F.avg("margin"), 6).alias("mean_margin")).join(top, "quadrant").select("quadrant", "n_retained", "mean_margin", "top5_margin")


@query("v1_norms", "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as norm, len(embedding)::bigint as width from embeddings")
def _(t):
    return t("embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.size("embedding").cast("long").alias("width"))


@query("v2_v3_unit_sums", """
    with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), n as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from e)
    select vec_id, round(list_sum(v) / (n + 1e-12), 6) as sum_epsilon, round(case when n > 1e-8 then list_sum(v) / n else list_sum(v) end, 6) as sum_above from n""")
def _(t):
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return t("embeddings").select("vec_id", F.round(total(V.unit(F.col("embedding"), 1e-12)), 6).alias("sum_epsilon"), F.round(total(V.unit_above(F.col("embedding"))), 6).alias("sum_above"))


@query("v4_v12_scores", f"with {SCORED} select vec_id, round(se, 6) as score_econ, round(ss, 6) as score_soc, quadrant, round(margin, 6) as margin, round(sqrt(se * se + ss * ss), 6) as bias from scored")
def _(t):
    bias = V.bias_magnitude(F.col("score_econ"), F.col("score_soc"))
    return scored(t).select("vec_id", F.round("score_econ", 6).alias("score_econ"), F.round("score_soc", 6).alias("score_soc"), "quadrant", F.round("margin", 6).alias("margin"), F.round(bias, 6).alias("bias"))


@query("v5_neighbour_cosine", """
    with e as (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as v from embeddings)
    select a.vec_id, round(sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v)) + 1e-12), 6) as cosine from e a join e b on b.vec_id = a.vec_id + 1 and a.i = b.i group by a.vec_id""")
def _(t):
    e = t("embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("v8_v9_quadrant_scores", f"""
    with {SCORED}, b as (select i, -econ - soc as ll, -econ + soc as la, econ - soc as rl, econ + soc as ra from x),
    w as (select i, ll / sqrt((select sum(ll * ll) from b)) as ll, la / sqrt((select sum(la * la) from b)) as la, rl / sqrt((select sum(rl * rl) from b)) as rl, ra / sqrt((select sum(ra * ra) from b)) as ra from b)
    select vec_id, round(sum(v * ll), 6) as left_lib, round(sum(v * la), 6) as left_auth, round(sum(v * rl), 6) as right_lib, round(sum(v * ra), 6) as right_auth from u join w using (i) group by vec_id""")
def _(t):
    e = t("embeddings")
    econ = A.mean_difference_axis(e, "embedding", F.col("label") >= 5, True).select(F.col("axis").alias("e"))
    soc = A.mean_difference_axis(e, "embedding", F.col("label") % 2 == 0, True).select(F.col("axis").alias("s"))
    basis = econ.join(soc).select(F.struct(*[v.alias(q) for q, v in V.quadrant_basis(F.col("e"), F.col("s")).items()]).alias("b"))
    got = e.join(F.broadcast(basis)).select("vec_id", V.quadrant_scores(V.unit(F.col("embedding")), {q: F.col("b")[q] for q in V.QUADRANTS}).alias("q"))
    return got.select("vec_id", *[F.round(F.col("q")[q], 6).alias(q) for q in V.QUADRANTS])


@query("v11_centered", """
    with e as (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as v from embeddings), c as (select i, avg(v) as c from e group by i)
    select vec_id, round(sqrt(sum((v - c) * (v - c))), 6) as distance from e join c using (i) group by vec_id""")
def _(t):
    e = t("embeddings")
    center = A.mean_vector(e, [], "embedding", out="c")
    return e.join(F.broadcast(center)).select("vec_id", F.round(V.norm(V.subtract(F.col("embedding"), F.col("c"))), 6).alias("distance"))


PROTO = """
    e as (select vec_id, label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as v from embeddings), n as (select vec_id, sqrt(sum(v * v)) + 1e-12 as n from e group by vec_id),
    p as (select label as name, i, avg(v) as v from e group by label, i), pn as (select name, sqrt(sum(v * v)) + 1e-12 as n from p group by name),
    c as (select vec_id, name::varchar as name, sum(e.v * p.v) / any_value(n.n) / any_value(pn.n) as s from e join p using (i) join n using (vec_id) join pn using (name) group by vec_id, name),
    r as (select *, row_number() over (partition by vec_id order by s desc, name) as k from c)"""


@query("v14_topics", f"""
    with {PROTO} select a.vec_id, a.name as topic_primary, round(a.s, 6) as primary_score, b.name as topic_secondary, round(b.s, 6) as secondary_score from r a left join r b on a.vec_id = b.vec_id and b.k = 2 where a.k = 1""")
def _(t):
    e = t("embeddings")
    got = A.nearest_prototypes(e, "vec_id", "embedding", A.mean_vector(e, ["label"], "embedding"), "label", "vec")
    return got.select("vec_id", "topic_primary", F.round("topic_primary_score", 6).alias("primary_score"), "topic_secondary", F.round("topic_secondary_score", 6).alias("secondary_score"))


@query("v14_retained_topics", f"""
    with {PROTO} select a.vec_id, a.name as topic_primary, round(a.s, 6) as primary_score, b.name as topic_secondary from r a left join r b on a.vec_id = b.vec_id and b.k = 2 where a.k = 1
      and a.vec_id in (with {SCORED} select vec_id from scored where margin >= 0.015)""")
def _(t):
    """Topics of retained items only, with the prototypes in three blocks."""
    e = t("embeddings")
    kept = scored(t).where(F.col("margin") >= 0.015)
    got = A.nearest_prototypes(kept, "vec_id", "embedding", A.mean_vector(e, ["label"], "embedding"), "label", "vec", most=4)
    return got.select("vec_id", "topic_primary", F.round("topic_primary_score", 6).alias("primary_score"), "topic_secondary")


@query("v15_layers", f"""
    with {SCORED} select vec_id, round(sum(case when i <= 32 then 0.25 else 0.75 end * v * econ / case when i <= 32 then (select sqrt(sum(econ * econ)) + 1e-12 from x where i <= 32) else (select sqrt(sum(econ * econ)) + 1e-12 from x where i > 32) end), 6) as score from u join x using (i) group by vec_id""")
def _(t):
    e = t("embeddings")
    half = lambda c, k: F.slice(c, 1 + 32 * k, 32)
    axis = A.mean_difference_axis(e, "embedding", F.col("label") >= 5, True)
    unit = V.unit(F.col("embedding"))
    layers = e.select("vec_id", F.explode(F.array(*[F.struct(F.lit(k).alias("layer"), half(unit, k).alias("v")) for k in (0, 1)])).alias("l")).select("vec_id", "l.*")
    table = axis.select(F.explode(F.array(*[F.struct(F.lit(k).alias("layer"), half(F.col("axis"), k).alias("axis"), F.lit(w).alias("w")) for k, w in ((0, 0.25), (1, 0.75))])).alias("a")).select("a.*")
    return A.combined_projection(layers, "vec_id", "layer", "v", table, "w").select("vec_id", F.round("score", 6).alias("score"))


@query("v19_v20_separation", f"""
    with {SCORED} select round(abs(avg(se) filter (where label >= 5) - avg(se) filter (where label < 5)) / sqrt(greatest((var_pop(se) filter (where label >= 5) + var_pop(se) filter (where label < 5)) / 2, 1e-12)), 6) as separation,
      round((avg(se) filter (where label >= 5) - avg(se) filter (where label < 5)) / (sqrt((var_samp(se) filter (where label >= 5) + var_samp(se) filter (where label < 5)) / 2) + 1e-12), 6) as cohens_d from scored""")
def _(t):
    got = scored(t).agg(*S.separation(F.col("score_econ"), F.col("label") >= 5))
    return got.select(F.round("separation", 6).alias("separation"), F.round("cohens_d", 6).alias("cohens_d"))


@query("v21_layer_quality", f"""
    with {SCORED} select label, round(0.6 * avg((quadrant like 'right%')::int) + 0.4 * least(avg(margin) / 2, 1.0), 6) as quality from scored group by label""")
def _(t):
    got = scored(t).groupBy("label").agg(F.avg(F.col("quadrant").startswith("right").cast("double")).alias("a"), F.avg("margin").alias("m"))
    return got.select("label", F.round(A.layer_quality(F.col("a"), F.col("m")), 6).alias("quality"))


@query("v22_orthogonality", f"with {SCORED} select round(sum(econ * soc), 6) as cosine, round(abs(sum(econ * soc)), 6) as max_abs from x")
def _(t):
    e = t("embeddings")
    a = A.mean_difference_axis(e, "embedding", F.col("label") >= 5, True).select(F.col("axis").alias("a"))
    b = A.mean_difference_axis(e, "embedding", F.col("label") % 2 == 0, True).select(F.col("axis").alias("b"))
    c = V.cosine(F.col("a"), F.col("b"))
    return a.join(b).agg(F.round(F.first(c), 6).alias("cosine"), F.round(F.max(F.abs(c)), 6).alias("max_abs"))


@query("v23_cross_separation", f"""
    with {SCORED}, l as (select 'score_econ' as axis, 'econ' as contrast, se as x, label >= 5 as p from scored union all select 'score_econ', 'social', se, label % 2 = 0 from scored
      union all select 'score_soc', 'econ', ss, label >= 5 from scored union all select 'score_soc', 'social', ss, label % 2 = 0 from scored)
    select axis, contrast, round((avg(x) filter (where p) - avg(x) filter (where not p)) / (sqrt((var_samp(x) filter (where p) + var_samp(x) filter (where not p)) / 2) + 1e-12), 6) as cohens_d from l group by axis, contrast""")
def _(t):
    got = A.cross_separation(scored(t), ["score_econ", "score_soc"], {"econ": F.col("label") >= 5, "social": F.col("label") % 2 == 0})
    return got.select("axis", "contrast", F.round("cohens_d", 6).alias("cohens_d"))


@query("v25_shift", f"""
    with {SCORED}, q as (select a.vec_id, b.se - a.se as de, b.ss - a.ss as ds, a.quadrant <> b.quadrant as changed from scored a join scored b on b.vec_id = a.vec_id + 1)
    select vec_id, round(sqrt(de * de + ds * ds), 6) as shift, changed from q""")
def _(t):
    a = scored(t).select("vec_id", "score_econ", "score_soc", "quadrant")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("score_econ").alias("e2"), F.col("score_soc").alias("s2"), F.col("quadrant").alias("q2"))
    shift = V.position_shift(F.col("e2") - F.col("score_econ"), F.col("s2") - F.col("score_soc"))
    return a.join(b, "vec_id").select("vec_id", F.round(shift, 6).alias("shift"), (F.col("quadrant") != F.col("q2")).alias("changed"))


@query("v26_axis_limits", f"""
    with {SCORED}, c as (select label, avg(se) as c, stddev_pop(se) as d from scored group by label)
    select round(min(c - d) - 0.05, 6) as lo, round(max(c + d) + 0.05, 6) as hi, (select round(quantile_cont(abs(se), 0.995), 6) from scored) as q995 from c""")
def _(t):
    s = scored(t)
    by = s.groupBy("label").agg(F.avg("score_econ").alias("c"), S.population_std(F.col("score_econ")).alias("d"))
    q = s.agg(F.round(F.percentile(F.abs("score_econ"), 0.995), 6).alias("q995"))
    return by.agg(F.round(F.min(F.col("c") - F.col("d")) - 0.05, 6).alias("lo"), F.round(F.max(F.col("c") + F.col("d")) + 0.05, 6).alias("hi")).join(q)


@query("v27_mixture", """
    with e as (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as v from embeddings)
    select vec_id // 4 as g, round(sqrt(sum(h * h)), 6) as norm from (select min(vec_id) as vec_id, i, sum(v * (1 + vec_id % 4) / 10) as h from e group by vec_id // 4, i having count(*) = 4) group by vec_id // 4""")
def _(t):
    e = t("embeddings").withColumn("g", F.expr("vec_id div 4"))
    by = e.groupBy("g").agg(*[F.max(F.when(F.col("vec_id") % 4 == k, F.col("embedding"))).alias(f"h{k}") for k in range(4)]).where("h0 is not null and h1 is not null and h2 is not null and h3 is not null")
    mix = V.mixture([F.lit((1 + k) / 10) for k in range(4)], [F.col(f"h{k}") for k in range(4)])
    return by.select("g", F.round(V.norm(mix), 6).alias("norm"))


@query("a20_weighted_mean", """
    with e as (select vec_id, label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as v from embeddings)
    select label, round(sum(m), 6) as total from (select label, i, sum(v * greatest(vec_id % 3, 1e-12)) / sum(greatest(vec_id % 3, 1e-12)) as m from e group by label, i) group by label""")
def _(t):
    e = t("embeddings").withColumn("w", (F.col("vec_id") % 3).cast("double"))
    return A.mean_vector(e, ["label"], "embedding", "w").select("label", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("a11_a13_rollup", f"""
    with {SCORED}, d as (select *, vec_id // 10 as doc from scored), c as (select doc, quadrant, count(*) as n, min(vec_id) as f from d group by doc, quadrant),
    k as (select *, row_number() over (partition by doc order by n desc, f) as r from c)
    select doc, count(*) as n_chunks, round(avg(se), 6) as mean_econ, round(stddev_pop(ss), 6) as std_soc, arg_min(quadrant, vec_id) as first_quadrant, (select quadrant from k where k.doc = d.doc and r = 1) as dominant_quadrant,
      count(*) filter (where quadrant = 'left_lib') as n_left_lib from d group by doc""")
def _(t):
    got = R.document_rollup(scored(t).withColumn("doc", F.expr("vec_id div 10")), "doc", "vec_id")
    return got.select("doc", "n_chunks", F.round("mean_econ", 6).alias("mean_econ"), F.round("std_soc", 6).alias("std_soc"), "first_quadrant", "dominant_quadrant",
                      F.coalesce(F.try_element_at("quadrant_counts", F.lit("left_lib")), F.lit(0)).cast("long").alias("n_left_lib"))


@query("p23_reclassify", f"""
    with {SCORED} select case when se - 0.1 >= 0 then 'right' else 'left' end || '_' || case when ss + 0.1 >= 0 then 'auth' else 'lib' end as quadrant, count(*) as n from scored group by 1""")
def _(t):
    moved = scored(t).withColumn("quadrant", V.quadrant(F.col("score_econ"), F.col("score_soc"), (0.1, -0.1)))
    return moved.groupBy("quadrant").agg(F.count("*").alias("n"))


@query("t1_t3_correlations", f"""
    with {SCORED}, r as (select *, rank() over (partition by label order by se) + (count(*) over (partition by label, se) - 1) / 2 as a, rank() over (partition by label order by ss) + (count(*) over (partition by label, ss) - 1) / 2 as b from scored)
    select label, count(*) as n, round(corr(se, ss), 6) as pearson, round(corr(a, b), 6) as spearman from r group by label""")
def _(t):
    got = S.correlations(scored(t), "score_econ", "score_soc", ["label"])
    return got.select("label", "n", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@query("t6_auc", f"""
    with {SCORED}, r as (select *, label >= 5 as p, rank() over (order by ss) + (count(*) over (partition by ss) - 1) / 2 as k from scored)
    select 'all' as g, count(*) filter (where p) as n_pos, count(*) filter (where not p) as n_neg,
      round((sum(k) filter (where p) - count(*) filter (where p) * (count(*) filter (where p) + 1) / 2) / (count(*) filter (where p) * count(*) filter (where not p)), 6) as auc from r""")
def _(t):
    got = S.auc(scored(t).select(F.lit("all").alias("g"), "score_soc", (F.col("label") >= 5).alias("p")), "score_soc", "p", ["g"])
    return got.select("g", "n_pos", "n_neg", F.round("auc", 6).alias("auc"))


@query("t12_w12_outliers", f"""
    with {SCORED}, z as (select vec_id, (se - avg(se) over ()) / stddev_samp(se) over () as ze, (ss - avg(ss) over ()) / stddev_pop(ss) over () as zs from scored)
    select vec_id, round(ze, 6) as z_sample, round(zs, 6) as z_population from z where abs(ze) > 2.5 or abs(zs) > 2.5""")
def _(t):
    z = S.z_scores(S.z_scores(scored(t), "score_econ", [], False, "ze"), "score_soc", [], True, "zs")
    return z.where("abs(ze) > 2.5 or abs(zs) > 2.5").select("vec_id", F.round("ze", 6).alias("z_sample"), F.round("zs", 6).alias("z_population"))


@query("t13_t16_center", f"""
    with {SCORED}, z as (select *, abs((se - avg(se) over ()) / stddev_samp(se) over ()) > 2.5 or abs((ss - avg(ss) over ()) / stddev_samp(ss) over ()) > 2.5 as o, (label % 3)::varchar as c from scored),
    l as (select 'score_econ' as axis, c, o, se as x from z union all select 'score_soc', c, o, ss from z),
    k as (select axis, c, avg(x) as m, row_number() over (partition by axis order by c) as r from l where not o group by axis, c),
    b as (select axis, count(*) as n_raw, count(*) filter (where o) as n_outliers, avg(x) filter (where not o) as center, stddev_samp(x) filter (where not o) as sd from l group by axis),
    q as (select 'score_econ' as axis, avg(se) filter (where label % 2 = 0) as p, avg(se) filter (where label % 2 <> 0) as n from scored union all
      select 'score_soc', avg(ss) filter (where label >= 5), avg(ss) filter (where label < 5) from scored),
    f as (select b.axis, n_raw, n_outliers, center, p - n as charged_spread, abs(center - (p + n) / 2) / (abs(p - n) + 1e-12) as ratio,
      abs((select m from k where k.axis = b.axis and r = 1) - (select m from k where k.axis = b.axis and r = 2)) <= 0.5 * sd as categories_agree from b join q using (axis))
    select axis, n_raw, n_outliers, round(center, 6) as center, round(charged_spread, 6) as charged_spread, round(ratio, 6) as midpoint_ratio, categories_agree, ratio <= 0.15 as midpoint_ok,
      (select bool_and(categories_agree and ratio <= 0.15) from f) as passed from f""")
def _(t):
    s = scored(t)
    polarity = s.select(F.inline(F.array(
        F.struct(F.lit("score_econ").alias("axis"), (F.col("label") % 2 == 0).alias("positive"), F.col("score_econ").alias("x")),
        F.struct(F.lit("score_soc").alias("axis"), (F.col("label") >= 5).alias("positive"), F.col("score_soc").alias("x")))))
    got = S.validate_center(s.withColumn("c", (F.col("label") % 3).cast("string")), polarity, "c", ("score_econ", "score_soc"))
    return got.select("axis", "n_raw", "n_outliers", F.round("center", 6).alias("center"), F.round("charged_spread", 6).alias("charged_spread"), F.round("midpoint_ratio", 6).alias("midpoint_ratio"),
                      "categories_agree", "midpoint_ok", "passed")


@query("t5_split_half", f"""
    with {SCORED}, h as (select *, row_number() over (partition by label order by md5('3:' || vec_id::varchar), vec_id) as r, count(*) over (partition by label) as n from scored),
    hm as (select label, avg(se) filter (where r <= n // 2) as a, avg(se) filter (where r > n // 2) as b from h where n > 1 group by label)
    select count(*) as n, round(corr(a, b), 6) as half, round(2 * corr(a, b) / (1 + corr(a, b)), 6) as reliability from hm""")
def _(t):
    got = S.split_half(scored(t), "label", "vec_id", "score_econ", 3)
    return got.select("n", F.round("half", 6).alias("half"), F.round("reliability", 6).alias("reliability"))


@query("t4_permutation", f"""
    with {SCORED}, g as (select label, avg(se) as x, avg(ss) as y from scored group by label), r as (select label, rank() over (order by x) as rx, rank() over (order by y) as ry, row_number() over (order by label) as place from g),
    p as (select rep, ry, row_number() over (partition by rep order by md5('5:' || rep::varchar || ':' || label::varchar), label) as place from r, range(200) t(rep)),
    c as (select rep, corr(r.rx, p.ry) as c from p join r using (place) group by rep)
    select (select count(*) from r) as n, (select round(corr(rx, ry), 6) from r) as spearman, round((count(*) filter (where abs(c) >= abs((select corr(rx, ry) from r)) - 1e-12) + 1) / 201, 6) as p from c""")
def _(t):
    by = scored(t).groupBy("label").agg(F.avg("score_econ").alias("x"), F.avg("score_soc").alias("y"))
    got = S.permutation_p(by, "x", "y", "label", 200, 5)
    return got.select("n", F.round("spearman", 6).alias("spearman"), F.round("p", 6).alias("p"))


@query("t9_kfold_auc", """
    with f as (select vec_id, label, embedding, ((row_number() over (order by md5('0:' || vec_id::varchar), vec_id) - 1) % 5)::int as fold from embeddings),
    e as (select vec_id, label, fold, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as v from f),
    m as (select k, i, avg(v) filter (where label >= 5) - avg(v) filter (where label < 5) as m from e, range(5) t(k) where fold <> k group by k, i),
    a as (select k, i, m / (sqrt(sum(m * m) over (partition by k)) + 1e-12) as a from m),
    s as (select vec_id, label >= 5 as p, sum(v * a) as s from e join a on e.fold = a.k and e.i = a.i group by vec_id, label),
    r as (select p, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2 as r from s)
    select count(*) filter (where p) as n_pos, count(*) filter (where not p) as n_neg,
      round((sum(r) filter (where p) - count(*) filter (where p) * (count(*) filter (where p) + 1) / 2) / (count(*) filter (where p) * count(*) filter (where not p)), 6) as auc from r""")
def _(t):
    """Held-out AUC by five seeded folds."""
    rows = folds(t("embeddings").withColumn("p", F.col("label") >= 5), "vec_id", 5, 0)
    return A.kfold_auc(rows, "embedding", "p", "fold").select("n_pos", "n_neg", F.round("auc", 6).alias("auc"))


@query("t10_leave_one_group_out", """
    with f as (select vec_id, label, embedding, case when vec_id % 4 < 3 then (vec_id % 4)::varchar end as g from embeddings), h as (select distinct g as held from f where g is not null),
    e as (select vec_id, label, g, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as v from f),
    m as (select held, i, avg(v) filter (where label >= 5) - avg(v) filter (where label < 5) as m from e, h where g is distinct from held group by held, i),
    a as (select held, i, m / (sqrt(sum(m * m) over (partition by held)) + 1e-12) as a from m),
    s as (select held, vec_id, label >= 5 as p, sum(v * a) as s from e join a on e.g = a.held and e.i = a.i group by held, vec_id, label),
    r as (select held, p, s, rank() over (partition by held order by s) + (count(*) over (partition by held, s) - 1) / 2 as r from s)
    select held, count(*) filter (where p) as n_pos, count(*) filter (where not p) as n_neg,
      round((sum(r) filter (where p) - count(*) filter (where p) * (count(*) filter (where p) + 1) / 2) / (count(*) filter (where p) * count(*) filter (where not p)), 6) as auc from r group by held""")
def _(t):
    """AUC of each label's thirds on axes of the others."""
    rows = t("embeddings").withColumn("p", F.col("label") >= 5).withColumn("g", F.when(F.col("vec_id") % 4 < 3, (F.col("vec_id") % 4).cast("string")))
    return A.leave_one_group_out(rows, "embedding", "p", "g").select("held", "n_pos", "n_neg", F.round("auc", 6).alias("auc"))


@query("t7_random_directions")
def _(t):
    """|d| on 500 seeded random directions; the tests hold it against numpy."""
    got = A.random_direction_null(t("embeddings").withColumn("p", F.col("label") >= 5), "embedding", "p", 64, 500, 0)
    return got.select("reps", *[F.round(c, 6).alias(c) for c in ("mean", "p95", "max")])


@query("t15_bootstrap", f"""
    with {SCORED}, g as (select label, avg(se) as x from scored group by label), p as (select row_number() over (order by label) - 1 as place, x from g), gn as (select count(*) as n from g),
    d as (select rep, ('0x' || substr(md5('9:' || rep::varchar || ':' || place::varchar), 1, 12))::bigint % n as place from p, gn, range(200) t(rep)),
    bm as (select rep, avg(x) as m from d join p using (place) group by rep) select round(avg(m), 6) as mean, round(stddev_samp(m), 6) as se from bm""")
def _(t):
    by = scored(t).groupBy("label").agg(F.avg("score_econ").alias("x"))
    got = S.bootstrap_se(by, "x", "label", 200, 9)
    return got.select(F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"))


def mix32_sql(x: str, p: str) -> str:
    """Columns ``{p}1`` to ``{p}5``; the last is the 32-bit mix of ``x``, an unsigned 64-bit expression."""
    return (f"xor({x}, ({x}) >> 16) as {p}1, ({p}1 * 2246822507) & 4294967295 as {p}2, xor({p}2, {p}2 >> 13) as {p}3, "
            f"({p}3 * 3266489909) & 4294967295 as {p}4, xor({p}4, {p}4 >> 16) as {p}5")


def stream_sql(seed: int, stream: int, p: str) -> str:
    """The key of a stream of random numbers of repetition ``rep``, as column ``{p}5``."""
    first = int(RS.mix32(np.array([(seed + 0x9E3779B9 * (stream + 1)) & 0xFFFFFFFF], np.uint64))[0])
    return mix32_sql(f"(({first}::ubigint + rep) & 4294967295)", p)


def permutation_sql(seed: int, reps: int) -> str:
    """CTEs after ``places(place, x2, y2)``: ``walked(rep, place, v)``, where each permutation puts each place."""
    rounds, left, right = [], "(v >> half)", "(v & mask)"
    for r in range(4):
        rounds += [mix32_sql(f"(({right} + k{r}) & 4294967295)", f"r{r}m"), f"xor({left}, r{r}m5 & mask) as r{r}"]
        left, right = right, f"r{r}"
    keys = ", ".join(stream_sql(seed, r, f"s{r}m") for r in range(4))
    return f"""
    shape as (select count(*)::ubigint as n from places),
    sized as (select n, h::ubigint as half, ((1::ubigint << h) - 1)::ubigint as mask from (select n, (select min(h) from range(1, 32) t(h) where (1::ubigint << (2 * h)) >= n)::int as h from shape)),
    keys as (select rep, s0m5 as k0, s1m5 as k1, s2m5 as k2, s3m5 as k3 from (select rep, {keys} from (select range::ubigint as rep from range({reps})))),
    walk as (select rep, place::ubigint as place, place::ubigint as v, 0 as step from places, (select range::ubigint as rep from range({reps}))
      union all select rep, place, (r2 << half) | r3, step + 1 from (select walk.rep, place, step, half, {', '.join(rounds)} from walk join keys on walk.rep = keys.rep, sized where step = 0 or v >= n)),
    walked as (select rep, place, v from walk, sized where step > 0 and v < n)"""


@query("t4_permutation_items", f"""
    with recursive {SCORED}, places as (select (row_number() over (order by ss, vec_id) - 1)::bigint as place, 2 * rank() over (order by se) + count(*) over (partition by se) - 1 as x2, 2 * rank() over (order by ss) + count(*) over (partition by ss) - 1 as y2 from scored),
    {permutation_sql(5, 10_000)},
    c as (select rep, corr(a.x2, b.y2) as c from walked join places a on a.place = walked.place join places b on b.place = walked.v group by rep)
    select (select count(*) from places) as n, (select round(corr(x2, y2), 6) from places) as spearman, count(*) filter (where abs(c) >= abs((select corr(x2, y2) from places)) - 1e-9) as hits,
      round((count(*) filter (where abs(c) >= abs((select corr(x2, y2) from places)) - 1e-9) + 1) / 10001, 9) as p from c""")
def _(t):
    """Ten thousand permutations of all items."""
    got = RS.permutation_test(scored(t), "score_econ", "score_soc", "vec_id", 10_000, 5)
    return got.select("n", F.round("spearman", 6).alias("spearman"), "hits", F.round("p", 9).alias("p"))


def bootstrap_sql(seed: int, reps: int) -> str:
    """CTEs after ``items(id, x)`` (longs and doubles): ``means(rep, m)``."""
    bounds = " + ".join(f"(hm5 >= {b})::int" for b in RS.POISSON)
    return f"""
    keyed as (select rep, sm5 as k from (select rep, {stream_sql(seed, 0, 'sm')} from (select range::ubigint as rep from range({reps})))),
    drawn as (select rep, x, {bounds} as w from (select rep, x, {mix32_sql("((id::ubigint & 4294967295) + k) & 4294967295", "lm")}, {mix32_sql("((lm5 + (id::ubigint >> 32)) & 4294967295)", "hm")} from items, keyed)),
    means as (select rep, sum(w * x) / sum(w) as m from drawn group by rep)"""


@query("t15_bootstrap_items", f"""
    with {SCORED}, items as (select vec_id as id, se as x from scored), {bootstrap_sql(9, 1000)}
    select 'score_econ' as x, (select count(*) from items) as n, (select round(avg(x), 6) from items) as mean, round(avg(m), 6) as boot_mean, round(stddev_samp(m), 6) as se from means""")
def _(t):
    """A thousand resamples of all items."""
    got = RS.bootstrap_moments(scored(t), ["score_econ"], "vec_id", 1000, 9)
    return got.select("x", "n", *[F.round(c, 6).alias(c) for c in ("mean", "boot_mean", "se")])


@query("t16_center_verdict", f"""
    with {SCORED}, z as (select *, abs((se - avg(se) over ()) / stddev_samp(se) over ()) > 2.5 or abs((ss - avg(ss) over ()) / stddev_samp(ss) over ()) > 2.5 as o, (label % 3)::varchar as c from scored),
    l as (select 'score_econ' as axis, c, o, se as x from z union all select 'score_soc', c, o, ss from z),
    cm as (select axis, c, avg(x) as m, row_number() over (partition by axis order by c) as r from l where not o group by axis, c),
    b as (select axis, count(*) filter (where o) as n_outliers, avg(x) filter (where not o) as center, stddev_samp(x) filter (where not o) as sd from l group by axis),
    q as (select 'score_econ' as axis, avg(se) filter (where label % 2 = 0) as p, avg(se) filter (where label % 2 <> 0) as n from scored union all
      select 'score_soc', avg(ss) filter (where label >= 5), avg(ss) filter (where label < 5) from scored),
    items as (select vec_id as id, [se, ss] as x2, 0.0 as x from z where not o), {bootstrap_sql(42, 1000).replace('drawn as (select rep, x,', 'drawn as (select rep, x2,').replace('from (select rep, x,', 'from (select rep, x2,').replace('sum(w * x) / sum(w) as m', 'sum(w * x2[1]) / sum(w) as m1, sum(w * x2[2]) / sum(w) as m2')},
    be as (select 'score_econ' as axis, stddev_samp(m1) as bse from means union all select 'score_soc', stddev_samp(m2) from means),
    f as (select b.axis, n_outliers, center, p - n as spread, abs(center - (p + n) / 2) / (abs(p - n) + 1e-12) <= 0.15 as midpoint_ok, bse, bse / (abs(p - n) + 1e-12) as ratio,
      abs((select m from cm where cm.axis = b.axis and r = 1) - (select m from cm where cm.axis = b.axis and r = 2)) <= 0.5 * sd as categories_agree from b join q using (axis) join be using (axis))
    select axis, n_outliers, round(center, 6) as center, n_outliers = 0 as no_outliers, categories_agree, midpoint_ok, round(bse, 6) as bootstrap_se, round(ratio, 6) as se_ratio, ratio <= 0.05 as stable,
      (select bool_and(n_outliers = 0 and categories_agree and midpoint_ok and ratio <= 0.05) from f) as all_passed from f""")
def _(t):
    """All four checks of the centre, with a thousand resamples of the items that are no outliers."""
    s = scored(t)
    polarity = s.select(F.inline(F.array(
        F.struct(F.lit("score_econ").alias("axis"), (F.col("label") % 2 == 0).alias("positive"), F.col("score_econ").alias("x")),
        F.struct(F.lit("score_soc").alias("axis"), (F.col("label") >= 5).alias("positive"), F.col("score_soc").alias("x")))))
    got = S.center_verdict(s.withColumn("c", (F.col("label") % 3).cast("string")), polarity, "c", ("score_econ", "score_soc"), "vec_id")
    return got.select("axis", "n_outliers", F.round("center", 6).alias("center"), "no_outliers", "categories_agree", "midpoint_ok", F.round("bootstrap_se", 6).alias("bootstrap_se"),
                      F.round("se_ratio", 6).alias("se_ratio"), "stable", "all_passed")


@query("t3_correlation_matrix", f"""
    with {SCORED}, v as (select vec_id, 'score_econ' as c, 1 as i, se as v from scored union all select vec_id, 'score_soc', 2, ss from scored union all select vec_id, 'label', 3, label from scored),
    r as (select *, rank() over (partition by c order by v) + (count(*) over (partition by c, v) - 1) / 2 as k from v)
    select a.c as x, b.c as y, count(*) as n, round(corr(a.v, b.v), 6) as pearson, round(corr(a.k, b.k), 6) as spearman from r a join r b on a.vec_id = b.vec_id and a.i <= b.i group by a.c, b.c""")
def _(t):
    got = S.correlation_matrix(scored(t).withColumn("label", F.col("label").cast("double")), ["score_econ", "score_soc", "label"], [])
    return got.select("x", "y", "n", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@query("v17_logistic_axis")
def _(t):
    """The logistic axis's cosine with the mean-difference axis; the tests bound it."""
    e = t("embeddings")
    a = A.logistic_axis(e, "embedding", F.col("label") >= 5)
    b = A.mean_difference_axis(e, "embedding", F.col("label") >= 5).select(F.col("axis").alias("b"))
    return a.join(b).select(F.round(V.cosine(F.col("axis"), F.col("b")), 2).alias("cosine"))


@query("v6_pooling", """
    with x as (select vec_id, i, j, embedding[i * 8 + j + 1]::double as v, case when i < vec_id % 9 and vec_id % 9 < 8 then 0 else 1 end as m from embeddings, range(8) a(i), range(8) b(j)),
    p as (select vec_id, j, sum(v * m) / greatest(sum(m), 1) as mean, max(v) filter (where i = 7 - case when vec_id % 9 < 8 then vec_id % 9 else 0 end) as last from x group by vec_id, j)
    select vec_id, round(sqrt(sum(mean * mean)), 6) as mean_norm, round(sqrt(sum(last * last)), 6) as last_norm from p group by vec_id""")
def _(t):
    """Each embedding as eight states of eight numbers; a prefix of up to eight is masked, all eight fall back."""
    states = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    rows = t("embeddings").select("vec_id", states.alias("states"), V.response_mask(F.array_repeat(F.lit(1), 8), (F.col("vec_id") % 9).cast("int")).alias("mask"))
    by = lambda how: F.round(V.norm(V.pooled(F.col("states"), F.col("mask"), how)), 6)
    return rows.select("vec_id", by("mean").alias("mean_norm"), by("last_token").alias("last_norm"))


@query("v24_method_agreement", """
    with e as (select vec_id, vec_id % 4 as layer, label >= 5 as p, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as v from embeddings),
    m as (select layer, i, avg(v) filter (where p) - avg(v) filter (where not p) as a, avg(sign(v)) filter (where p) - avg(sign(v)) filter (where not p) as b from e group by layer, i),
    c as (select layer, sum(a * b) / sqrt(sum(a * a) * sum(b * b)) as cosine from m group by layer)
    select layer, round(cosine, 6) as cosine, round(min(cosine) over (), 6) as min_cosine from c""")
def _(t):
    """The mean difference of vectors and of their signs, for four layers."""
    rows = t("embeddings").select((F.col("vec_id") % 4).alias("layer"), (F.col("label") >= 5).alias("pole"), "embedding", F.transform("embedding", lambda x: F.signum(x)).alias("signs"))

    def axes(vec, out):
        m = A.mean_vector(rows, ["layer", "pole"], vec, out="m").groupBy("layer")
        m = m.agg(F.max(F.when(F.col("pole"), F.col("m"))).alias("p"), F.max(F.when(~F.col("pole"), F.col("m"))).alias("n"))
        return m.select("layer", V.subtract(F.col("p"), F.col("n")).alias(out))

    got = A.method_agreement(axes("embedding", "a").join(axes("signs", "b"), "layer"), "layer", "a", "b")
    return got.select("layer", F.round("cosine", 6).alias("cosine"), F.round("min_cosine", 6).alias("min_cosine"))


@query("t8_shuffled_labels", """
    with e as (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as v from embeddings),
    r as (select vec_id, rep, case when rep = 64 then label >= 5 else substr(md5('5:' || (rep // 32) || ':' || vec_id), (rep % 32 + 1)::int, 1) >= '8' end as a from embeddings, range(65) t(rep)),
    m as (select rep, i, avg(v) filter (where a) - avg(v) filter (where not a) as d from r join e using (vec_id) group by rep, i),
    u as (select rep, i, d / sqrt(sum(d * d) over (partition by rep)) as d from m),
    x as (select rep, a, sum(v * d) as x from r join e using (vec_id) join u using (rep, i) group by rep, a, vec_id),
    s as (select rep, (avg(x) filter (where a) - avg(x) filter (where not a)) / sqrt((var_samp(x) filter (where a) + var_samp(x) filter (where not a)) / 2) as d from x group by rep),
    o as (select d as real from s where rep = 64)
    select count(*) as reps, round(any_value(real), 6) as real, round(avg(d), 6) as mean, round(quantile_cont(d, 0.95), 6) as p95, round(max(d), 6) as max, (count(*) filter (where d >= real) + 1) / (count(*) + 1) as p
    from s, o where rep < 64""")
def _(t):
    got = A.shuffled_label_null(t("embeddings").withColumn("p", F.col("label") >= 5), "embedding", "p", "vec_id", 64, 64, 5)
    return got.select("reps", *[F.round(c, 6).alias(c) for c in ("real", "mean", "p95", "max")], "p")


def _head():
    """A fixed head of four by 64 numbers, which SQL can make too."""
    k, i = np.arange(4)[:, None], np.arange(64)[None, :]
    return RT.Head(((k * 7 + (i + 1) * 3) % 5 - 2) / 10, np.arange(4) / 20)


@query("d3_head_policy", """
    with e as (select vec_id, label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as v from embeddings),
    z as (select vec_id, k, sum(v * (((k * 7 + i * 3) % 5 - 2) / 10)) + k / 20 - 0.25 * ((label + k) % 4) as z from e, range(4) t(k) group by vec_id, label, k),
    s as (select vec_id, k, exp(z - max(z) over (partition by vec_id)) as x from z)
    select vec_id, k::int as place, round(x / sum(x) over (partition by vec_id), 6) as p from s""")
def _(t):
    """Policies from a log-prior and a linear head over hidden states."""
    prior = F.array(*[-0.25 * ((F.col("label") + k) % 4) for k in range(4)])
    rows = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("h"), prior.alias("prior"))
    got = RT.calibrated(rows, "h", "prior", _head()).select("vec_id", F.posexplode("policy").alias("place", "p"))
    return got.select("vec_id", "place", F.round("p", 6).alias("p"))


@query("d16_router_training")
def _(t):
    """Mean losses of each of three epochs over all items; the tests hold the loop against numpy."""
    z = F.array(*[-0.25 * ((F.col("label") + k) % 4) for k in range(4)])
    rows = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("h"), z.alias("prior"))
    softmax = lambda c: F.transform(c, lambda x: F.exp(x) / F.aggregate(c, F.lit(0.0), lambda s, y: s + F.exp(y)))
    rows = rows.withColumn("prior", F.transform(softmax(F.col("prior")), lambda x: F.log(x))).withColumn("target", softmax(F.array(*[2.0 * F.element_at("h", k + 1) for k in range(4)])))
    head = RT.train_head(rows, "h", "prior", "target", "vec_id", epochs=3, batch_size=256, rate=0.01, kl=0.05, entropy=0.01)
    spark = rows.sparkSession
    return spark.createDataFrame([(i, *[round(h[c], 6) for c in RT.LOSSES]) for i, h in enumerate(head.history)], "epoch int, " + ", ".join(f"{c} double" for c in RT.LOSSES))
