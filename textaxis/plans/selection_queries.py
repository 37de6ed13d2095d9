"""Queries of filters, slices, lookups, group checks and result rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from textaxis.functions import vectors as V
from textaxis.operators import axes as A
from textaxis.operators import corpus as O
from textaxis.operators import reports as R
from textaxis.plans.registry import Registry
from textaxis.plans.vector_queries import SCORED

registry = Registry()
query = registry.query


@query("f8_f10_f11_filters", """
    select event_type, count(*) as n, round(sum(value), 4) as total from events where event_id % 5 <> 0 and user_id is not null and user_id % 7 in (1, 2, 4) and event_id % 3 <> 0 group by event_type""")
def _(t):
    """Values that are no NaN, a key that is there and a member of a set, and no fallback rows."""
    e = F.col("event_id")
    rows = t("events").withColumn("value", F.when(e % 5 == 0, float("nan")).otherwise(F.col("value"))).withColumn("fallback", e % 3 == 0)
    kept = rows.where(~F.isnan("value") & F.col("user_id").isNotNull() & (F.col("user_id") % 7).isin(1, 2, 4) & ~F.col("fallback"))
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("f12_w15_slice", "select event_id, position from (select event_id, row_number() over (order by event_id) - 1 as position from events) where position >= 100 and position < 350")
def _(t):
    """Rows 100 to 349 by their number in the file."""
    return O.slice_rows(t("events").select("event_id"), "event_id", 100, 350)


@query("l1_l2_longest", "select doc_id, n_chars from documents order by n_chars desc, doc_id limit 50")
def _(t):
    """The 50 longest texts."""
    return t("documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)


@query("l16_strict_signs", """
    with e as (select event_id, case when value - 50 > 0 then 'right' else 'left' end || '_' || case when event_id % 7 - 3 > 0 then 'auth' else 'lib' end as quadrant from events),
    c as (select * from e qualify row_number() over (partition by quadrant order by md5('7:' || event_id), event_id) <= 20)
    select event_id, quadrant, row_number() over (order by md5('8:' || event_id), event_id) - 1 as place from c""")
def _(t):
    rows = t("events").select("event_id", (F.col("value") - 50).alias("econ"), (F.col("event_id") % 7 - 3).alias("social"))
    return O.stratify_by_sign(rows, "econ", "social", "event_id", 20, 7).select("event_id", "quadrant", F.col("place").cast("long").alias("place"))


@query("j16_topic_key", "select topic, count(*) as n from events left join (values ('view', 'browsing'), ('click', 'acting')) as m(event_type, topic) using (event_type) group by topic")
def _(t):
    """Each statement's topic from a list, null where the list has none."""
    e = t("events").select("event_type")
    topics = e.sparkSession.createDataFrame([("view", "browsing"), ("click", "acting")], "event_type string, topic string")
    return e.join(F.broadcast(topics), "event_type", "left").groupBy("topic").agg(F.count("*").alias("n"))


@query("j21_persona_expert", "select c_mktsegment, n_name as expert, count(*) as n from customer join (select * from nation where n_nationkey % 4 = 1) on c_nationkey = n_nationkey group by 1, 2")
def _(t):
    """Each persona with the expert that it names; personas without one are left out."""
    experts = t("nation").where("n_nationkey % 4 = 1").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("expert"))
    return t("customer").join(F.broadcast(experts), "c_nationkey").groupBy("c_mktsegment", "expert").agg(F.count("*").alias("n"))


@query("p24_result_rows", "select doc_id, to_json({'doc_id': doc_id, 'source': source, 'lang': lang, 'n_chars': n_chars}) :: varchar as line from documents")
def _(t):
    columns = ("doc_id", "source", "lang", "n_chars")
    return t("documents").select("doc_id", F.to_json(F.struct(*columns)).alias("line"))


@query("a14_split_summary", f"""
    with {SCORED}, r as (select *, case when vec_id % 5 = 0 then 'val' else 'train' end as split, 100 + vec_id % 40 as n_tokens, 's' || vec_id % 3 as source, 't' || label as topic from scored),
    by_source as (select quadrant, split, string_agg(source || ':' || n, ',' order by source) as sources from (select quadrant, split, source, count(*) as n from r group by all) group by all),
    by_topic as (select quadrant, split, string_agg(topic || ':' || n, ',' order by topic) as topics from (select quadrant, split, topic, count(*) as n from r group by all) group by all)
    select quadrant, split, count(*) as n, round(avg(n_tokens), 3) as mean_tokens, round(avg(margin), 6) as mean_margin, round(avg(se), 6) as mean_score_econ, round(avg(ss), 6) as mean_score_soc, any_value(sources) as sources, any_value(topics) as topics
    from r join by_source using (quadrant, split) join by_topic using (quadrant, split) group by quadrant, split""")
def _(t):
    k = F.col("vec_id")
    rows = A.scored_items(t("embeddings"), "embedding", "label").select(
        "quadrant", "margin", "score_econ", "score_soc", F.when(k % 5 == 0, "val").otherwise("train").alias("split"), (100 + k % 40).alias("n_tokens"),
        F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"), F.concat(F.lit("t"), F.col("label").cast("string")).alias("topic"))
    got = R.split_summary(rows, ["quadrant", "split"], ["source", "topic"])
    said = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return got.select("quadrant", "split", "n", "mean_tokens", "mean_margin", "mean_score_econ", "mean_score_soc", said("source_counts").alias("sources"), said("topic_counts").alias("topics"))


@query("v18_sign_convention", f"with {SCORED} select round(avg(se) filter (where label >= 5) - avg(se) filter (where label < 5), 6) as spread from scored")
def _(t):
    """An axis that was turned round by its sign is turned back: the positive pole projects higher."""
    items, positive = t("embeddings"), F.col("label") >= 5
    axis = A.mean_difference_axis(items, "embedding", positive, True).select(V.scaled(F.col("axis"), -1.0).alias("axis"))
    pole = lambda p: F.avg(F.when(positive == p, F.col("s")))
    means = A.project(items, "embedding", {"s": axis}).agg(pole(True).alias("p"), pole(False).alias("n"))
    turned = axis.crossJoin(F.broadcast(means)).select(A.sign_convention(F.col("axis"), F.col("p"), F.col("n")).alias("axis"))
    return A.project(items, "embedding", {"s": turned}).agg(F.round(pole(True) - pole(False), 6).alias("spread"))


def _documents(t):
    return t("documents").select(
        F.col("doc_id").alias("document_id"), F.col("lang").alias("quadrant"), "source", F.concat(F.lit("t"), (F.col("doc_id") % 5).cast("string")).alias("topic"),
        (F.ascii(F.substring("source", -1, 1)) % 3).alias("group"), F.col("n_chars").alias("n_tokens"), F.lit(0.1).alias("margin"))


@query("q3_q4_groups", """
    with c as (select lang, ascii(right(source, 1)) % 3 as g, count(*) as n from documents group by 1, 2), s as (select g, n / sum(n) over (partition by lang) as x from c)
    select 'SOURCE_GROUP_CAP' as check_name, round(max(x), 6) as value, 0.7::double as bound, max(x) <= 0.7 as passed from s
    union all select 'SOURCE_GROUP_ALIGNMENT', round(max(d), 6), 0.05::double, max(d) <= 0.05 from (select max(x) - case when count(*) < 4 then 0 else min(x) end as d from s group by g)""")
def _(t):
    got = R.checks(_documents(t), {}, ["en", "de", "fr", "es"], group="group", group_cap=0.7, group_gap=0.05)
    return got.where(F.col("check_name").startswith("SOURCE_GROUP")).select("check_name", F.round("value", 6).alias("value"), "bound", "passed")


@query("q10_q11_purity", """
    select 'VAL_TOPIC_PURITY' as check_name, count(*) filter (where doc_id % 5 <> 1)::double as value, 0::double as bound, count(*) filter (where doc_id % 5 <> 1) = 0 as passed from documents where doc_id % 10 = 1
    union all select 'VAL_SOURCE_PURITY', count(*) filter (where source is distinct from 'src1')::double, 0::double, count(*) filter (where source is distinct from 'src1') = 0 from documents where doc_id % 3 = 1""")
def _(t):
    rows = _documents(t)
    splits = {"val_topic": rows.where("document_id % 10 = 1"), "val_source": rows.where("document_id % 3 = 1")}
    got = R.checks(rows.where("document_id % 3 = 0"), splits, ["en"], held_topic="t1", held_source="src1")
    return got.where(F.col("check_name").endswith("PURITY")).select("check_name", "value", "bound", "passed")


@query("l10_reference_shares", """
    with c as (select lang as quadrant, 'g' || doc_id % 7 % 3 as grp, count(*) as n from documents where source <> 'src0' or doc_id % 7 % 3 = 1 group by 1, 2),
    g as (select quadrant, place, grp, coalesce(n, 0) as n from (values ('en', 0), ('de', 1), ('fr', 2), ('es', 3)) q(quadrant, place) cross join (values ('g0'), ('g1'), ('g2'), ('g3')) s(grp) left join c using (quadrant, grp)),
    w as (select quadrant, sum(least(n, 24))::bigint as capacity from g group by quadrant, place order by capacity, place limit 1),
    r as (select grp, quadrant as reference, capacity, n, n / greatest(sum(n) over (), 1) as raw from g join w using (quadrant)),
    s as (select *, least(greatest(raw, 0.05), 0.4) as clipped from r)
    select grp, reference, capacity, n, round(raw, 6) as raw_share, round(clipped / sum(clipped) over (), 6) as share from s""")
def _(t):
    """The weakest language by capacity, and its group shares; one group has no rows."""
    k = F.col("doc_id") % 7 % 3
    rows = t("documents").where((F.col("source") != "src0") | (k == 1)).select(F.col("lang").alias("quadrant"), F.concat(F.lit("g"), k.cast("string")).alias("grp"))
    got = O.reference_proportions(rows, "quadrant", "grp", ["en", "de", "fr", "es"], ["g0", "g1", "g2", "g3"], 60, 0.05, 0.4)
    return got.select("grp", "reference", "capacity", "n", F.round("raw_share", 6).alias("raw_share"), F.round("share", 6).alias("share"))


@query("j15_match_questions", """
    with d as (select doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as x from documents), q as (select item_id, text as y from benchmark),
    f as (select doc_id, max(item_id) as item_id from d join q on substr(x, 1, 80) = substr(y, 1, 80) group by doc_id),
    s as (select doc_id, min(item_id) as item_id from d join q on contains(y, substr(x, 1, 60)) or contains(x, substr(y, 1, 60)) group by doc_id)
    select doc_id, coalesce(f.item_id, s.item_id) as item_id from d left join f using (doc_id) left join s using (doc_id)""")
def _(t):
    """Each document's benchmark item, by equal beginnings, else by containment."""
    return O.match_questions(t("documents"), t("benchmark").withColumn("place", F.col("item_id")), "doc_id", "text", "item_id", "text", "place")
