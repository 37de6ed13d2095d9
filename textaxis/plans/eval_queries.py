"""Queries of joins, aggregates and evaluation summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from textaxis.operators import people as PE
from textaxis.operators import reports as R
from textaxis.operators import stats as S
from textaxis.plans.registry import Registry
from textaxis.plans.text_queries import strip_sql, words_sql

registry = Registry()
query = registry.query


@query("j1_speaker_map", """
    with s as (select c_custkey, arg_max(o_orderpriority, o_orderkey) as p from (select o_custkey as c_custkey, o_orderkey, o_orderpriority from orders) group by c_custkey)
    select c_mktsegment, p as last_priority, count(*) as n from customer join s using (c_custkey) group by 1, 2""")
def _(t):
    """The map keeps its last row per key; the probe side is joined to it."""
    last = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("last_priority"))
    return t("customer").join(last, "c_custkey").groupBy("c_mktsegment", "last_priority").agg(F.count("*").alias("n"))


@query("j2_unique_match", """
    with c as (select s_suppkey, c_custkey, s_suppkey % 5 = c_custkey % 5 as same from supplier join customer on s_nationkey = c_nationkey and s_suppkey % 20 = c_custkey % 20),
    w as (select *, count(*) over (partition by s_suppkey) as n, count(*) filter (where same) over (partition by s_suppkey) as m from c)
    select s_suppkey, c_custkey, case when n = 1 then 'unit' else 'tie' end as matched_by from w where n = 1 or (same and m = 1)""")
def _(t):
    left = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 20).alias("unit"), (F.col("s_suppkey") % 5).alias("tie"))
    right = t("customer").select("c_custkey", F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 20).alias("unit"), (F.col("c_custkey") % 5).alias("tie"))
    return R.unique_match(left, right, ["nation", "unit"], "tie", "s_suppkey", "c_custkey")


@query("j3_group_lookup", "select coalesce(r_name, 'other') as grp, count(*) as n from supplier left join nation on s_nationkey = n_nationkey and n_nationkey % 3 > 0 left join region on n_regionkey = r_regionkey group by 1")
def _(t):
    groups = t("nation").where("n_nationkey % 3 > 0").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    joined = t("supplier").join(F.broadcast(groups), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy(F.coalesce("r_name", F.lit("other")).alias("grp")).agg(F.count("*").alias("n"))


@query("j4_reason_join", """
    with a as (select doc_id, quality as q from labels), b as (select doc_id, (n_chars > 500)::int as q from documents where doc_id % 10 < 8)
    select reason, count(*) as n from (select case when a.doc_id is null then 'no_left' when b.doc_id is null then 'no_right' when a.q is distinct from b.q then 'mismatch' else 'ok' end as reason from a full join b on a.doc_id = b.doc_id) group by reason""")
def _(t):
    a = t("labels").select("doc_id", F.col("quality").alias("q"))
    b = t("documents").where("doc_id % 10 < 8").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("q"))
    return R.reason_join(a, b, "doc_id", ["q"]).groupBy("reason").agg(F.count("*").alias("n"))


@query("j5_a24_paired_delta", """
    with a as (select user_id, avg(value) as a from events where event_type = 'view' group by user_id), b as (select user_id, avg(value) as b from events where event_type = 'click' group by user_id), d as (select b - a as d from a join b using (user_id))
    select count(*) as n, round(avg(d), 6) as mean, round(quantile_cont(d, 0.5), 6) as median, round(avg((d < 0)::int), 6) as reduced from d""")
def _(t):
    got = R.paired_delta(t("events"), "user_id", "event_type", "value", "view", "click")
    return got.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "reduced")])


@query("j6_j7_baseline_delta", """
    select o_orderpriority, count(*) as n, count(acct) as n_base, round(avg(o_totalprice - acct), 2) as mean_delta from orders left join (select c_custkey, c_acctbal as acct from customer where c_custkey % 4 > 0) on o_custkey = c_custkey group by o_orderpriority""")
def _(t):
    base = t("customer").where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return t("orders").join(base, "o_custkey", "left").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count("c_acctbal").alias("n_base"), F.round(F.avg(F.col("o_totalprice") - F.col("c_acctbal")), 2).alias("mean_delta"))


@query("j8_chained_left", """
    select n_nationkey, coalesce(c, 0) as customers, coalesce(s, 0) as suppliers, r_name from nation left join (select c_nationkey, count(*) as c from customer group by 1) on c_nationkey = n_nationkey
      left join (select s_nationkey, count(*) as s from supplier group by 1) on s_nationkey = n_nationkey left join region on r_regionkey = n_regionkey""")
def _(t):
    c = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    s = t("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    got = t("nation").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return got.select("n_nationkey", F.coalesce("customers", F.lit(0)).cast("long").alias("customers"), F.coalesce("suppliers", F.lit(0)).cast("long").alias("suppliers"), "r_name")


@query("j9_t11_template_invariance", """
    with p as (select user_id, event_type as e, avg(value) as v from events group by 1, 2) select a.e as t1, b.e as t2, count(*) as n, round(corr(a.v, b.v), 6) as pearson from p a join p b on a.user_id = b.user_id and a.e < b.e group by 1, 2""")
def _(t):
    p = t("events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    a, b = p.toDF("user_id", "t1", "v1"), p.toDF("user_id", "t2", "v2")
    return a.join(b, "user_id").where("t1 < t2").groupBy("t1", "t2").agg(F.count("*").alias("n"), F.round(F.corr("v1", "v2"), 6).alias("pearson"))


@query("j10_row_reference", "select count(*) as n, sum(v.label)::bigint as labels from events e join embeddings v on v.vec_id = e.event_id % 1000")
def _(t):
    from textaxis.functions.text import row_reference

    e = t("events").select(row_reference(F.concat(F.lit("hidden.pt:"), (F.col("event_id") % 1000).cast("string"))).alias("vec_id"))
    return e.join(t("embeddings").select("vec_id", "label"), "vec_id").agg(F.count("*").alias("n"), F.sum("label").alias("labels"))


@query("j15_prefix_match", """
    select (select count(*) from conversations c where exists (select 1 from conversations d where substr(d.text, 1, 80) = substr(c.text, 1, 80) and (d.conv_id, d.turn) < (c.conv_id, c.turn))) as n_prefix""")
def _(t):
    """Prefix equality is an equi-join on the first 80 characters; here: turns whose prefix came up before."""
    from pyspark.sql import Window

    w = Window.partitionBy("p").orderBy("conv_id", "turn")
    c = t("conversations").select("conv_id", "turn", F.md5(F.substring("text", 1, 80)).alias("p"))
    return c.withColumn("r", F.row_number().over(w)).agg(F.count_if(F.expr("r > 1")).alias("n_prefix"))


@query("j19_j22_resume", """
    select (select count(*) from events where not (event_id % 3 = 0 and user_id % 2 = 0)) as open_rows, (select count(distinct user_id) from events where user_id not in (select user_id from events where event_id % 50 = 0)) as open_users""")
def _(t):
    e = t("events").select("event_id", "user_id")
    done = e.where("event_id % 3 = 0 and user_id % 2 = 0")
    rows = e.join(done, ["event_id", "user_id"], "left_anti").agg(F.count("*").alias("open_rows"))
    users = e.join(e.where("event_id % 50 = 0").select("user_id").distinct(), "user_id", "left_anti").agg(F.count_distinct("user_id").alias("open_users"))
    return rows.join(users)


@query("a1_a3_counts", "select event_type, count(*) as n, count(distinct user_id) as users, count(*) filter (where value > 50) as high from events group by event_type")
def _(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") > 50).alias("high"))


@query("a4_a7_moments", """
    select user_id, round(avg(value), 6) as mean, round(coalesce(stddev_pop(value), 0), 6) as sd_pop, round(coalesce(stddev_samp(value), 0), 6) as sd_samp, round(quantile_cont(value, 0.5), 6) as median from events group by user_id""")
def _(t):
    v = F.col("value")
    return t("events").groupBy("user_id").agg(F.round(S.mean_or_zero(v), 6).alias("mean"), F.round(S.population_std(v), 6).alias("sd_pop"), F.round(S.sample_std(v), 6).alias("sd_samp"), F.round(F.percentile(v, 0.5), 6).alias("median"))


@query("a8_percentiles", """
    select event_type, round(avg(value), 6) as mean, min(value) as min, round(quantile_cont(value, 0.1), 6) as p10, round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.75), 6) as p75,
      round(quantile_cont(value, 0.9), 6) as p90, max(value) as max from events group by event_type""")
def _(t):
    got = t("events").groupBy("event_type").agg(*S.percentile_pack(F.col("value")))
    return got.select("event_type", *[c if c in ("min", "max") else F.round(c, 6).alias(c) for c in got.columns[1:]])


@query("a25_quantiles", """
    select event_type, count(value) as n, round(avg(value), 6) as mean, min(value) as min, round(quantile_cont(value, 0.1), 6) as p10, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.9), 6) as p90,
      round(quantile_cont(value, 0.99), 6) as p99, max(value) as max from events group by event_type""")
def _(t):
    """Exact quantiles of each type from carried counts of distinct values."""
    got = S.quantiles(t("events"), "value", ["event_type"], {"p10": 0.1, "median": 0.5, "p90": 0.9, "p99": 0.99})
    return got.select("event_type", "n", F.round("mean", 6).alias("mean"), "min", *[F.round(c, 6).alias(c) for c in ("p10", "median", "p90", "p99")], "max")


@query("a9_a10_proportions", "select source, lang, n, round(n / sum(n) over (partition by source), 6) as share from (select source, lang, count(*) as n from documents group by 1, 2)")
def _(t):
    return R.nested_shares(t("documents"), "source", "lang").select("source", "lang", "n", F.round("share", 6).alias("share"))


@query("a12_first_row", "select user_id, arg_min(event_type, (ts, event_id)) as first_type, min(ts) as first_ts from events group by user_id")
def _(t):
    return t("events").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"), F.min("ts").alias("first_ts"))


@query("a15_grouping_sets", """
    select l_shipmode, a, b, n from (select l_linestatus as l_shipmode, l_returnflag as a, null::int as b, count(*) as n from lineitem group by 1, 2 union all select l_linestatus, null, l_linenumber, count(*) from lineitem group by 1, 3)""")
def _(t):
    rows = t("lineitem").select(F.col("l_linestatus").alias("l_shipmode"), F.col("l_returnflag").alias("a"), F.col("l_linenumber").alias("b"), F.lit(1).alias("one"))
    return rows.groupingSets([[F.col("l_shipmode"), F.col("a")], [F.col("l_shipmode"), F.col("b")]], "l_shipmode", "a", "b").agg(F.count("*").alias("n"))


@query("a16_summary_sets", """
    select 'overall' as by, null as source, null as lang, count(*) as n, round(avg(n_chars), 6) as mean from documents union all select 'source', source, null, count(*), round(avg(n_chars), 6) from documents group by source
      union all select 'lang', null, lang, count(*), round(avg(n_chars), 6) from documents group by lang""")
def _(t):
    got = R.summary_sets(t("documents").select("source", "lang", "n_chars"), ["source", "lang"], [F.count("*").alias("n"), F.avg("n_chars").alias("mean")])
    return got.select("by", "source", "lang", "n", F.round("mean", 6).alias("mean"))


@query("a17_a18_pivot", """
    with p as (select source, count(*) filter (where lang = 'en') as en, count(*) filter (where lang = 'de') as de, count(*) filter (where lang = 'fr') as fr from documents where lang in ('en', 'de', 'fr') group by source)
    select source, en, de, fr, en + de + fr as total from p union all select 'total', sum(en)::bigint, sum(de)::bigint, sum(fr)::bigint, sum(en + de + fr)::bigint from p""")
def _(t):
    return R.pivot_with_totals(t("documents"), "source", "lang", ["en", "de", "fr"])


@query("a18_pivot_statistics", f"""
    with r as (select source as source, lang, n_chars from documents where lang in ('en', 'de', 'es', 'fr') union all select 'total', lang, n_chars from documents where lang in ('en', 'de', 'es', 'fr'))
    select source, {', '.join(f"round(avg(n_chars) filter (where lang = '{v}'), 4) as {v}_mean, round(median(n_chars) filter (where lang = '{v}'), 4) as {v}_median" for v in ('de', 'en', 'es', 'fr'))} from r group by source""")
def _(t):
    """Mean and median length by source and language, with totals."""
    got = R.pivot_statistics(t("documents"), "source", "lang", ["de", "en", "es", "fr"], "n_chars")
    return got.select("source", *[F.round(c, 4).alias(c) for c in got.columns[1:]])


@query("a21_mean_of_means", """
    with p as (select event_type as m, user_id, avg(value) as x, avg(event_id % 7) as y from events group by 1, 2) select m, count(*) as n_prompts, round(avg(x), 6) as x, round(avg(y), 6) as y, round(stddev_pop(x), 6) as sx from p group by m""")
def _(t):
    e = t("events").select(F.col("event_type").alias("m"), "user_id", "value", (F.col("event_id") % 7).alias("y0"))
    return R.mean_of_means(e, "m", "user_id", "value", "y0").select("m", "n_prompts", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("sx", 6).alias("sx"))


@query("a22_pooling", """
    select c_nationkey, round(avg(c_acctbal), 4) as mean_balance, array_to_string(list_sort(list_distinct(list(c_mktsegment))), '|') as segments, count(*) as n from customer group by c_nationkey""")
def _(t):
    return t("customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 4).alias("mean_balance"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), "|").alias("segments"), F.count("*").alias("n"))


@query("a23_d17_win_rates", """
    with v as (select case event_id % 3 when 0 then 'A' when 1 then 'B' else 'tie' end as n1, case event_id % 4 when 0 then 'A' when 1 then 'B' else 'tie' end as n2, case when value > 50 then 'A' else 'B' end as c1, case when event_id % 2 = 0 then 'A' else 'B' end as c2 from events),
    l as (select 'neutrality' as criterion, case when n1 = n2 and n1 <> 'tie' then n1 else 'tie' end as w, n1 = n2 as s from v union all select 'coherence', case when c1 = c2 then c1 else 'tie' end, c1 = c2 from v)
    select criterion, count(*) as n, count(*) filter (where w = 'A') as wins_a, count(*) filter (where w = 'B') as wins_b, count(*) filter (where w = 'tie') as ties, round(avg((w = 'A')::int), 6) as rate_a, round(avg(s::int), 6) as consistent from l group by criterion""")
def _(t):
    e = F.col("event_id")
    pick = lambda k: F.when(e % k == 0, "A").when(e % k == 1, "B").otherwise("tie")
    v = t("events").select(pick(3).alias("neutrality_1"), pick(4).alias("neutrality_2"), F.when(F.col("value") > 50, "A").otherwise("B").alias("coherence_1"), F.when(e % 2 == 0, "A").otherwise("B").alias("coherence_2"))
    got = R.win_rates(v, ["neutrality", "coherence"])
    return got.select("criterion", "n", "wins_a", "wins_b", "ties", F.round("rate_a", 6).alias("rate_a"), F.round("consistent", 6).alias("consistent"))


@query("a26_expert_summary", """
    select l_returnflag, l_linestatus, count(*) as n, round(avg(l_discount), 6) as mean from lineitem group by grouping sets ((l_returnflag), (l_returnflag, l_linestatus))""")
def _(t):
    rows = t("lineitem").select("l_returnflag", "l_linestatus", "l_discount")
    got = rows.groupingSets([[F.col("l_returnflag")], [F.col("l_returnflag"), F.col("l_linestatus")]], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.avg("l_discount").alias("mean"))
    return got.select("l_returnflag", "l_linestatus", "n", F.round("mean", 6).alias("mean"))


@query("a27_flip_rate", """
    with b as (select user_id, arg_min(event_type, event_id) as base from events group by user_id) select event_type, count(*) as n, round(avg((event_type <> base)::int), 6) as flip_rate, round(1 - avg((event_type <> base)::int), 6) as resistance from events join b using (user_id) group by event_type""")
def _(t):
    e = t("events")
    base = e.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("base"))
    flip = F.avg((F.col("event_type") != F.col("base")).cast("double"))
    return e.join(base, "user_id").groupBy("event_type").agg(F.count("*").alias("n"), F.round(flip, 6).alias("flip_rate"), F.round(1 - flip, 6).alias("resistance"))


@query("a30_reason_histogram", "select reason, count(*) as n from (select unnest([case when value > 90 then 'high' end, case when value < 10 then 'low' end, case when event_type = 'error' then 'error' end]) as reason from events) where reason is not null group by reason")
def _(t):
    v = F.col("value")
    reasons = F.array_compact(F.array(F.when(v > 90, "high"), F.when(v < 10, "low"), F.when(F.col("event_type") == "error", "error")))
    return t("events").select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("a31_spread", "select round(max(m) - min(m), 6) as spread, round(max(m) / min(m), 6) as ratio from (select avg(value) as m from events group by event_type)")
def _(t):
    m = t("events").groupBy("event_type").agg(F.avg("value").alias("m"))
    return m.agg(F.round(F.max("m") - F.min("m"), 6).alias("spread"), F.round(F.max("m") / F.min("m"), 6).alias("ratio"))


@query("a32_weighted_loss", "select source, round(sum(toxic * n_chars) / sum(n_chars), 6) as loss from labels join documents using (doc_id) group by source")
def _(t):
    d = t("labels").join(t("documents").select("doc_id", "source", "n_chars"), "doc_id")
    return d.groupBy("source").agg(F.round(F.sum(F.col("toxic") * F.col("n_chars")) / F.sum("n_chars"), 6).alias("loss"))


@query("a34_stance", """
    with r as (select user_id, case when event_id % 2 = 0 then 'economic' else 'social' end as axis, event_id % 5 - 2 as stance, case when event_id % 3 = 0 then -1 else 1 end as polarity from events), a as (select user_id, axis, avg(stance * polarity) as m, count(*) as n from r group by 1, 2)
    select user_id, sum(n)::bigint as n_scored, round(sqrt(sum(m * m)), 6) as radius from a group by user_id""")
def _(t):
    e = F.col("event_id")
    rows = t("events").select("user_id", F.when(e % 2 == 0, "economic").otherwise("social").alias("axis"), (e % 5 - 2).alias("stance"), F.when(e % 3 == 0, -1).otherwise(1).alias("polarity"))
    return R.stance_summary(rows, "user_id").select("user_id", "n_scored", F.round("radius", 6).alias("radius"))


@query("a35_dominance", "with c as (select lang, source, count(*) as n from documents group by 1, 2) select lang, source, round(share, 6) as share from (select *, n / sum(n) over (partition by lang) as share from c) where share > 0.04 qualify row_number() over (partition by lang order by n desc, source) = 1")
def _(t):
    return R.dominance(t("documents"), ["lang"], "source", 0.04).select("lang", "source", F.round("share", 6).alias("share"))


@query("a36_pair_correlation", """
    select event_type, round(corr(value, k), 6) as c from (select event_type, value, (props::json ->> 'k')::double as k from events) group by event_type""")
def _(t):
    k = F.get_json_object("props", "$.k").cast("double")
    return t("events").select("event_type", "value", k.alias("k")).groupBy("event_type").agg(F.round(F.corr("value", "k"), 6).alias("c"))


@query("t2_label_auc", """
    with r as (select quality = 1 as p, n_chars, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2 as k from labels join documents using (doc_id))
    select 'all' as g, round((sum(k) filter (where p) - count(*) filter (where p) * (count(*) filter (where p) + 1) / 2) / (count(*) filter (where p) * count(*) filter (where not p)), 6) as auc from r""")
def _(t):
    d = t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id").select(F.lit("all").alias("g"), (F.col("quality") == 1).alias("p"), "n_chars")
    return S.auc(d, "n_chars", "p", ["g"]).select("g", F.round("auc", 6).alias("auc"))


@query("s18_manifest", """
    select source, n from (select source, count(*) as n from documents where doc_id % 2 = 0 group by source union all select 'gone', 1) where source not in (select source from documents where doc_id % 3 = 0)
    union all select source, count(*) from documents where doc_id % 3 = 0 group by source""")
def _(t):
    from textaxis.sources.normalize import upsert_manifest

    d = t("documents")
    old = d.where("doc_id % 2 = 0").groupBy("source").agg(F.count("*").alias("n"))
    old = old.unionByName(d.sparkSession.createDataFrame([("gone", 1)], "source string, n long"))
    return upsert_manifest(old, d.where("doc_id % 3 = 0").groupBy("source").agg(F.count("*").alias("n")))


_PEOPLE = f"""
    sp as (select doc_id, text, len({words_sql('text')}) as n, doc_id % 3 + 1 as congress, doc_id % 40 as k from documents),
    s as (select *, congress || '-' || k as speaker_id, 'L' || (k % 11) as last_name, case when k % 9 = 0 then '' else chr((65 + k % 5)::int) || 'X' end as first_name, case when k % 10 < 6 then 'H' when k % 10 < 9 then 'S' else 'E' end as chamber, 'S' || (k % 4) as state from sp where n >= 20),
    b as (select *, coalesce(sum(n) over (partition by congress, speaker_id order by doc_id rows between unbounded preceding and 1 preceding), 0) as before from s),
    kept as (select * from b where before < 3000),
    m as (select c_custkey % 3 + 1 as congress, case when c_custkey % 5 < 3 then 'House' else 'Senate' end as chamber, 'S' || (c_custkey % 4) as state, 'L' || (c_custkey // 3 % 23) as last_name, chr((65 + c_custkey % 7)::int) as f, c_custkey % 90 as icpsr, c_acctbal / 10000 as d
      from customer where c_custkey % 8 > 0),
    u as (select congress, speaker_id, arg_min(last_name, doc_id) as last_name, arg_min(first_name, doc_id) as first_name, arg_min(chamber, doc_id) as chamber, arg_min(state, doc_id) as state, min(doc_id) as start from kept group by 1, 2),
    c as (select u.*, m.icpsr, m.f from u left join m on u.congress = m.congress and m.chamber = case u.chamber when 'H' then 'House' when 'S' then 'Senate' end and u.state = m.state and u.last_name = m.last_name),
    g as (select congress, speaker_id, first_name, chamber, state, last_name, start, count(icpsr) as candidates, min(icpsr) as one, count(*) filter (where f = substr(first_name, 1, 1)) as same, min(icpsr) filter (where f = substr(first_name, 1, 1)) as two from c group by all),
    x as (select *, case when candidates = 1 then one when candidates > 1 and first_name <> '' and same = 1 then two end as icpsr, case when candidates = 1 then 'name' when candidates > 1 and first_name <> '' and same = 1 then 'initial' end as matched_by from g)"""


def _speeches(t):
    k, doc = F.col("doc_id") % 40, F.col("doc_id")
    return t("documents").select(
        "doc_id", "text", (doc % 3 + 1).alias("congress"), F.concat_ws("-", (doc % 3 + 1).cast("string"), k.cast("string")).alias("speaker_id"), F.concat(F.lit("L"), (k % 11).cast("string")).alias("last_name"),
        F.when(k % 9 == 0, "").otherwise(F.concat(F.char(65 + k % 5), F.lit("X"))).alias("first_name"), F.when(k % 10 < 6, "H").when(k % 10 < 9, "S").otherwise("E").alias("chamber"), F.concat(F.lit("S"), (k % 4).cast("string")).alias("state"))


def _members(t):
    c = F.col("c_custkey")
    return t("customer").select(
        (c % 3 + 1).alias("congress"), F.when(c % 5 < 3, "House").otherwise("Senate").alias("chamber"), F.concat(F.lit("S"), (c % 4).cast("string")).alias("state_abbrev"),
        F.concat(F.lit("L"), (F.expr("c_custkey div 3") % 23).cast("string"), F.lit(", "), F.char(65 + c % 7), F.lit("y")).alias("bioname"), (c % 90).alias("icpsr"), F.lit("100").alias("party_code"),
        F.when(c % 8 > 0, F.col("c_acctbal") / 10000).alias("nominate_dim1"), F.lit(None).cast("double").alias("nominate_dim2"))


@query("j2_match_speakers", f"""
    with {_PEOPLE} select congress, speaker_id, icpsr, matched_by, candidates from x""")
def _(t):
    """Speakers' units linked to members by block, last name and initial."""
    kept = PE.speaker_speeches(_speeches(t), "doc_id", "text", 20, 3000)
    units = kept.groupBy(*PE.UNIT).agg(*[F.min_by(c, "doc_id").alias(c) for c in ("last_name", "first_name", "chamber", "state")])
    return PE.match_speakers(units, _members(t)).select("congress", "speaker_id", "icpsr", "matched_by", "candidates")


@query("a22_pool_people", f"""
    with {_PEOPLE}, z as (select x.*, (select min(d) from m where m.congress = x.congress and m.chamber = case x.chamber when 'H' then 'House' else 'Senate' end and m.state = x.state and m.last_name = x.last_name and m.icpsr = x.icpsr) as d from x where icpsr is not null),
    p as (select icpsr, count(*) as n_units, round(avg(d), 6) as dim1, array_to_string(list_sort(list_distinct(list(congress)))::varchar[], '|') as congresses from z group by icpsr),
    w as (select z.icpsr, count(*) as n_speeches, sum(kept.n)::bigint as n_words, md5(string_agg({strip_sql('kept.text')}, ' ' order by z.congress, z.start, kept.doc_id)) as h from z join kept using (congress, speaker_id) group by z.icpsr)
    select p.icpsr, n_units, dim1, congresses, n_speeches, n_words, h from p join w using (icpsr)""")
def _(t):
    """One record for each person: mean scores, congresses, and all kept speeches as one text."""
    people, _unmatched = PE.pool_people(_speeches(t), _members(t), "doc_id", "text", 20, 3000)
    return people.select("icpsr", "n_units", F.round("nominate_dim1", 6).alias("dim1"), F.array_join(F.transform("congresses", lambda c: c.cast("string")), "|").alias("congresses"), "n_speeches", "n_words", F.md5("text").alias("h"))
