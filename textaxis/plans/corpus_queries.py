"""Queries of chunking, dedupe, sampling, splitting and the quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from textaxis.functions import text as X
from textaxis.operators import corpus as O
from textaxis.operators import reports as R
from textaxis.operators.matched import budgets_by_share, even_budgets, matched_sample
from textaxis.operators.ranking import numbered
from textaxis.plans.registry import Registry
from textaxis.plans.text_queries import words_sql

registry = Registry()
query = registry.query


def _chunks_sql(size: int, overlap: int, least: int) -> str:
    step = size - overlap
    return f"""w as (select doc_id, {words_sql('text')} as w from documents),
    st as (select doc_id, w, unnest(range(0, len(w), {step})) as s from w),
    ok as (select doc_id, s, w[s + 1 : least(s + {size}, len(w))] as c from st where (s = 0 or s - {step} + {size} < len(w)) and least({size}, len(w) - s) >= {least}),
    chunks as (select doc_id, row_number() over (partition by doc_id order by s) - 1 as chunk_index, len(c) as n_tokens, array_to_string(c, ' ') as chunk from ok)"""


@query("x1_chunks", f"with {_chunks_sql(128, 32, 20)} select doc_id, chunk_index, n_tokens, md5(chunk) as h from chunks")
def _(t):
    return O.chunk_windows(t("documents"), 128, 32, 20).select("doc_id", "chunk_index", "n_tokens", F.md5("chunk").alias("h"))


@query("x2_fixed_chunks", f"with {_chunks_sql(100, 0, 50)} select doc_id, count(*) as n, sum(n_tokens)::bigint as tokens from chunks group by doc_id")
def _(t):
    return O.chunk_windows(t("documents"), 100, 0, 50).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"))


@query("x3_equalize", f"""
    with w as (select source, doc_id, {words_sql('text')} as w from documents),
    b as (select *, len(w) as n, coalesce(sum(len(w)) over (partition by source order by md5('11:' || doc_id::varchar), doc_id rows between unbounded preceding and 1 preceding), 0) as before, sum(len(w)) over (partition by source) as total from w)
    select source, doc_id, least(n, 2000 - before)::bigint as kept_words, md5(array_to_string(w[1 : least(n, 2000 - before)::bigint], ' ')) as h from b where total >= 2000 and before < 2000 and n > 0""")
def _(t):
    return O.equalize(t("documents"), "source", "doc_id", "text", 2000, 11).select("source", "doc_id", "kept_words", F.md5("kept").alias("h"))


@query("x3_equalized_texts", f"""
    with w as (select source, doc_id, {words_sql('text')} as w from documents),
    b as (select *, len(w) as n, coalesce(sum(len(w)) over (partition by source order by md5('11:' || doc_id::varchar), doc_id rows between unbounded preceding and 1 preceding), 0) as before, sum(len(w)) over (partition by source) as total from w),
    k as (select source, before, w[1 : least(n, 2000 - before)::bigint] as w from b where total >= 2000 and before < 2000 and n > 0)
    select source, count(*) as n_rows, sum(len(w))::bigint as n_words, md5(string_agg(array_to_string(w, ' '), ' ' order by before)) as h from k group by source""")
def _(t):
    """One text of 2,000 words for each source."""
    got = O.equalized_texts(t("documents"), "source", "doc_id", "text", 2000, 11)
    return got.select("source", "n_rows", "n_words", F.md5("text").alias("h"))


@query("x4_running_cap", f"""
    select source, doc_id, words_before from (select source, doc_id, coalesce(sum(len({words_sql('text')})) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as words_before from documents) where words_before < 15000""")
def _(t):
    rows = t("documents").select("source", "doc_id", X.word_count(F.col("text")).alias("n"))
    return O.running_cap(rows, "source", ["doc_id"], "n", 15000).select("source", "doc_id", "words_before")


@query("f1_f2_reasons", f"""
    select source, case when not contains(lang, 'e') then 'no_speaker' when n < 100 then 'short' when n > 800 then 'long' else 'ok' end as reason, count(*) as n from (select source, lang, len({words_sql('text')}) as n from documents) group by 1, 2""")
def _(t):
    d = t("documents").select("source", "lang", X.word_count(F.col("text")).alias("n"))
    reason = F.when(~F.col("lang").contains("e"), "no_speaker").when(F.col("n") < 100, "short").when(F.col("n") > 800, "long").otherwise("ok")
    return d.groupBy("source", reason.alias("reason")).agg(F.count("*").alias("n"))


@query("f3_f4_f6_filters", f"select lang, count(*) as n from documents where lang in ('en', 'de') and len({words_sql('text')}) between 50 and 700 group by lang")
def _(t):
    return t("documents").where(F.col("lang").isin("en", "de") & X.word_count(F.col("text")).between(50, 700)).groupBy("lang").agg(F.count("*").alias("n"))


@query("f7_pair_reasons", """
    with p as (select o_orderkey as k, case when o_orderkey % 7 = 0 then null else 'I think ' || o_orderpriority end as a,
      case o_orderkey % 5 when 0 then 'I think ' || o_orderpriority when 1 then 'i THINK ' || o_orderpriority || '!' when 2 then '  ' when 3 then 'one two three four five six seven eight nine ten' else 'You think otherwise' end as b,
      case when o_orderkey % 11 = 0 then 'other' else 'social' end as axis from orders),
    r as (select k, list_filter([case when a is null then 'missing_field' end, case when a is not null and axis = 'other' then 'invalid_axis' end, case when a is not null and trim(b) = '' then 'empty_text' end,
      case when a = b then 'identical_exact' end, case when a <> b and k % 5 = 1 then 'identical_normalized' end,
      case when a is not null and greatest(len(string_split(a, ' ')), case when trim(b) = '' then 0 else len(string_split(b, ' ')) end) / greatest(least(len(string_split(a, ' ')), case when trim(b) = '' then 0 else len(string_split(b, ' ')) end), 1) > 2 then 'length_ratio' end], lambda x: x is not null) as r from p)
    select reason, count(*) as n from (select unnest(r) as reason from r) group by reason""")
def _(t):
    k = F.col("o_orderkey")
    a = F.when(k % 7 == 0, None).otherwise(F.concat(F.lit("I think "), "o_orderpriority"))
    b = F.when(k % 5 == 0, F.concat(F.lit("I think "), "o_orderpriority")).when(k % 5 == 1, F.concat(F.lit("i THINK "), "o_orderpriority", F.lit("!"))).when(k % 5 == 2, "  ").when(k % 5 == 3, "one two three four five six seven eight nine ten").otherwise("You think otherwise")
    axis = F.when(k % 11 == 0, "other").otherwise("social")
    return t("orders").select(F.explode(R.pair_reasons(a, b, axis)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("f13_carve", """
    select case when lang = 'de' then 'val_topic' when source = 'src3' then 'val_source' else 'work' end as pool, count(*) as n from documents group by 1""")
def _(t):
    rest, topic = O.carve(t("documents"), "lang", "de")
    work, source = O.carve(rest, "source", "src3")
    parts = [work.select(F.lit("work").alias("pool")), source.select(F.lit("val_source").alias("pool")), topic.select(F.lit("val_topic").alias("pool"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("pool").agg(F.count("*").alias("n"))


@query("w1_min_gap", """
    with recursive s as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as r from events),
    k as (select user_id, min(event_id) as e from events group by user_id union all select k.user_id, (select min(s.event_id) from s where s.user_id = k.user_id and s.event_id >= k.e + 500) from k where k.e is not null)
    select user_id, count(*) as n, sum(e)::bigint as total from k where e is not null group by user_id""")
def _(t):
    kept = O.gap_dedupe(t("events").select("user_id", "event_id"), "user_id", "event_id", 500)
    return kept.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


@query("w2_confidence_pool", """
    select event_type, count(*) as n, max(rank) as last_rank from (select event_type, row_number() over (partition by event_type order by value desc, event_id) as rank, count(*) over (partition by event_type) as n from events)
    where rank <= greatest(100, ceil(n * 0.25)) group by event_type""")
def _(t):
    return O.confidence_pool(t("events"), ["event_type"], "value", "event_id", 100, 0.25).groupBy("event_type").agg(F.count("*").alias("n"), F.max("rank").alias("last_rank"))


@query("w3_cell_caps", """
    select lang, source, doc_id from (select *, row_number() over (partition by lang, source order by md5('42:' || doc_id::varchar), doc_id) as r from documents) where r <= 5""")
def _(t):
    return O.cap_cells(t("documents"), ["lang", "source"], "doc_id", 5, 42).select("lang", "source", "doc_id")


@query("w6_topk", "select event_type, event_id, rank from (select event_type, event_id, row_number() over (partition by event_type order by value desc, event_id) as rank from events) where rank <= 5")
def _(t):
    from textaxis.operators.axes import top_examples

    return top_examples(t("events"), "event_type", "value", "event_id", 5).select("event_type", "event_id", "rank")


@query("w7_w8_keep_first", """
    select 'p_' || lpad((row_number() over (order by doc_id) - 1)::varchar, 6, '0') as id, doc_id from (select doc_id, row_number() over (partition by text order by doc_id) as r from documents) where r = 1""")
def _(t):
    first = O.keep_first(t("documents").select("doc_id", F.md5("text").alias("k")), ["k"], ["doc_id"])
    placed = numbered(first.select("doc_id"), "doc_id")
    return placed.select(F.concat(F.lit("p_"), F.lpad(F.col("slot").cast("string"), 6, "0")).alias("id"), "doc_id")


@query("w9_w10_shares", """
    with c as (select source, lang, count(*) as n from documents group by 1, 2), s as (select *, n / sum(n) over (partition by source) as share, row_number() over (partition by source order by n desc, lang) as r from c)
    select source, lang, round(share, 6) as share from s where r = 1 and share > 0.5""")
def _(t):
    return R.dominance(t("documents"), ["source"], "lang", 0.5).select("source", "lang", F.round("share", 6).alias("share"))


@query("w14_best_so_far", "select user_id, event_id, min(value) over (partition by user_id order by ts, event_id rows unbounded preceding) as best from events")
def _(t):
    from pyspark.sql import Window

    return t("events").select("user_id", "event_id", F.min("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)).alias("best"))


@query("w16_nucleus", """
    with p as (select user_id, event_id, value / sum(value) over (partition by user_id) as p from events), c as (select *, sum(p) over (partition by user_id order by p desc, event_id rows unbounded preceding) as c from p)
    select user_id, count(*) as n from c where round(c - p, 9) <= 0.9 group by user_id""")
def _(t):
    from pyspark.sql import Window

    p = t("events").select("user_id", "event_id", (F.col("value") / F.sum("value").over(Window.partitionBy("user_id"))).alias("p"))
    c = p.withColumn("c", F.sum("p").over(Window.partitionBy("user_id").orderBy(F.desc("p"), "event_id").rowsBetween(Window.unboundedPreceding, 0)))
    return c.where(F.round(F.col("c") - F.col("p"), 9) <= 0.9).groupBy("user_id").agg(F.count("*").alias("n"))


@query("w17_a33_argmin", "select user_id, arg_min(event_type, (value, event_id)) as best from events group by user_id")
def _(t):
    return t("events").groupBy("user_id").agg(F.min_by("event_type", F.struct("value", "event_id")).alias("best"))


@query("l3_stratified", """
    with s as (select source, lang, count(*) as n_rows from documents group by 1, 2), t as (select sum(n_rows) as t from s)
    select source, lang, n_rows, (case when t <= 300 then n_rows else least(greatest(1, round_even(300 * n_rows / t, 0)::bigint), n_rows) end)::bigint as n_sample from s, t""")
def _(t):
    return O.stratified_sizes(t("documents"), ["source", "lang"], 300)


@query("l3_stratified_rows", """
    with s as (select source, count(*) as c from documents group by 1), t as (select sum(c) as t from s),
    z as (select source, case when t <= 300 then c else least(greatest(1, round_even(300 * c / t, 0)::bigint), c) end as k from s, t),
    r as (select doc_id, source, row_number() over (partition by source order by md5('8:' || doc_id::varchar), doc_id) as r from documents) select doc_id, source from r join z using (source) where r <= k""")
def _(t):
    return O.stratified_sample(t("documents"), ["source"], "doc_id", 300, 8).select("doc_id", "source")


@query("l5_document_split", """
    with d as (select distinct conv_id from conversations), r as (select conv_id, row_number() over (order by md5('1:' || conv_id::varchar), conv_id) as r, count(*) over () as n from d)
    select split, count(*) as n_rows, count(distinct conv_id) as n_docs from (select c.conv_id, case when r <= greatest(1, ceil(n * 0.1)) then 'val' else 'train' end as split from conversations c join r using (conv_id)) group by split""")
def _(t):
    return O.document_split(t("conversations"), "conv_id", 0.1, 1).groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct("conv_id").alias("n_docs"))


@query("l6_allocation", """
    with n as (select range as n from range(0, 60)), f as (select n, floor(n * 0.8) as a, floor(n * 0.1) as b, round(n * 0.8 - floor(n * 0.8), 9) as ra, round(n * 0.1 - floor(n * 0.1), 9) as rb from n),
    g as (select *, n - a - 2 * b as l from f),
    h as (select n, a + ((rb > ra)::int * 2 < l)::int as a, b + ((ra >= rb)::int < l)::int as v, b + ((ra >= rb)::int + 1 < l)::int as t from g),
    k as (select n, a - (v = 0)::int - (t = 0)::int as a, greatest(v, 1) as v, greatest(t, 1) as t from h)
    select n, (case n when 0 then 0 when 1 then 1 when 2 then 1 else a end)::bigint as train, (case n when 0 then 0 when 1 then 0 when 2 then 1 else v end)::bigint as val, (case when n < 3 then 0 else t end)::bigint as test from k""")
def _(t):
    n = t("orders").sparkSession.range(60).select(F.col("id").alias("n"))
    return n.select("n", O.three_way_counts(F.col("n").cast("double")).alias("c")).select("n", "c.*")


@query("l7_largest_remainder", """
    with c as (select l_returnflag as g, l_linestatus as k, count(*) as n from lineitem group by 1, 2), x as (select g, k, n * 101.0::double / sum(n) over (partition by g) as x from c),
    f as (select *, floor(x) as f, row_number() over (partition by g order by round(x - floor(x), 9) desc, k) as r, 101 - sum(floor(x)) over (partition by g) as left_over from x) select g, k, (f + (r <= left_over)::int)::bigint as allocated from f""")
def _(t):
    by = t("lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_linestatus").alias("k")).agg(F.count("*").alias("n"))
    return O.allocate(by, ["g"], "n", "k", 101).select("g", "k", "allocated")


@query("l8_three_way_split", """
    with r as (select doc_id, source, row_number() over (partition by source order by md5('4:' || doc_id::varchar), doc_id) as r, count(*) over (partition by source) as n from documents),
    s as (select source, doc_id, r, n, floor(n * 0.8) as a, floor(n * 0.1) as b, round(n * 0.8 - floor(n * 0.8), 9) as ra, round(n * 0.1 - floor(n * 0.1), 9) as rb from r),
    g as (select *, n - a - 2 * b as l from s), h as (select source, doc_id, r, n, a + ((rb > ra)::int * 2 < l)::int as a, b + ((ra >= rb)::int < l)::int as v from g)
    select source, split, count(*) as n, sum(doc_id)::bigint as ids from (select source, doc_id, case when r <= a then 'train' when r <= a + v then 'val' else 'test' end as split from h) group by source, split""")
def _(t):
    got = O.three_way_split(t("documents"), ["source"], "doc_id", 4)
    return got.groupBy("source", "split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("l9_balanced_capped")
def _(t):
    """At most 40 rows a quadrant under three caps; order-dependent, so the tests hold it against a plain loop."""
    d = t("documents").select("doc_id", F.col("lang").alias("quadrant"), "source", (F.substring("source", -1, 1)).alias("grp"), (F.col("doc_id") % 7).cast("string").alias("topic"), F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(1000)).alias("score"))
    return O.balanced_capped_sample(d, "quadrant", "source", "grp", "topic", "score", "doc_id", 40, 0.2, 0.4, 0.5)


def matched_sql(target: int, shares: dict[str, float], topics: list[str], seed: int, caps: tuple[float, float, float], share: float, least: int) -> str:
    """The matched sampler as one scan after another, each a recursion over its candidates in order; sources, groups and
    topics are numbers at the ends of their names."""
    source_cap, group_cap, topic_cap = (max(1, int(target * c)) for c in caps)
    hashes = ", ".join(f"md5('{seed + i}:' || doc_id::varchar) as h{i}" for i in range(3))
    parts = [f"""base as (select doc_id, lang as q, substr(source, 4)::int as s, substr(source, 4)::int % 4 as g, doc_id % 4 as t, (doc_id * 7919) % 97 as x, {hashes} from documents where doc_id % 4 in ({', '.join(t[1:] for t in topics)})),
    r as (select *, row_number() over (partition by q, g, t order by x desc, doc_id) as rc, count(*) over (partition by q, g, t) as nc from base),
    st0 as (select q, [0 for i in range(64)] as src, [0 for i in range(4)] as top, [0 for i in range(4)] as grp, 0 as n from (select distinct q from base))"""]
    steps, chosen = 0, "select null::bigint as doc_id where false"
    pool = lambda n, need: f"case when {n} <= {need} then {n} else greatest({need}, ceil({n} * {share}::double)) end"

    def scan(candidates: str, order: str, room: str, caps_of: str) -> None:
        nonlocal steps, chosen
        k, steps = steps, steps + 1
        parts.append(f"""
    c{k} as (select q, doc_id, s, g, t, row_number() over (partition by q order by {order}, doc_id) as rn from ({candidates})),
    w{k} as (select q, 0::bigint as rn, null::bigint as doc_id, false as ok, src, top, grp, n, 0 as added from st{k}
      union all select q, rn, doc_id, ok, list_transform(src, lambda v, i: v + (ok and i = s + 1)::int), list_transform(top, lambda v, i: v + (ok and i = t + 1)::int), list_transform(grp, lambda v, i: v + (ok and i = g + 1)::int), n + ok::int, added + ok::int
        from (select w.q, c.rn, c.doc_id, s, g, t, src, top, grp, n, added, src[s + 1] < {source_cap} and top[t + 1] < {topic_cap} and {caps_of} and {room} as ok from w{k} w join c{k} c on c.q = w.q and c.rn = w.rn + 1)),
    st{k + 1} as (select q, arg_max(src, rn) as src, arg_max(top, rn) as top, arg_max(grp, rn) as grp, arg_max(n, rn) as n from w{k} group by q)""")
        chosen += f" union all select doc_id from w{k} where ok"

    for g, budget in budgets_by_share(target, shares).items():
        grouped, i = f"grp[g + 1] < {group_cap} and grp[g + 1] < {budget}", g[1:]
        for t, want in even_budgets(budget, topics).items():
            scan(f"select * from r where g = {i} and t = {t[1:]} and nc >= {least} and rc <= {pool('nc', want)}", "h0", f"added < {want}", grouped)
        left = f"(select r.*, row_number() over (partition by r.q order by x desc, doc_id) as rk, count(*) over (partition by r.q) as nk from r where g = {i} and doc_id not in ({chosen}))"
        scan(f"select z.* from {left} z join st{steps} on z.q = st{steps}.q where rk <= {pool('nk', f'({budget} - grp[{i} + 1])')}", "h1", "true", grouped)
    left = f"(select r.*, row_number() over (partition by r.q order by x desc, doc_id) as rk, count(*) over (partition by r.q) as nk from r where doc_id not in ({chosen}))"
    scan(f"select z.* from {left} z join st{steps} on z.q = st{steps}.q where rk <= {pool('nk', f'({target} - n)')}", "h2", f"n < {target}", "true")
    stage = lambda k: "final" if k == steps - 1 else ("group" if k % (len(topics) + 1) == len(topics) else "topic")
    found = " union all ".join(f"select q, doc_id, '{stage(k)}' as stage, {k} as k, rn from w{k} where ok" for k in range(steps))
    return f"with recursive {', '.join(parts)}, found as ({found}) select doc_id, q as quadrant, stage, (row_number() over (partition by q order by k, rn) - 1)::int as place from found"


_MATCHED = (60, {"g1": 0.5, "g0": 0.3, "g2": 0.2}, ["t1", "t2", "t0"], 21, (0.3, 0.45, 0.4), 0.4, 2)


@query("l9_matched_sample", matched_sql(*_MATCHED))
def _(t):
    """Budgets of groups and topics, top-ups and three caps at once, in each language."""
    number = F.substring("source", 4, 9).cast("int")
    d = t("documents").select("doc_id", F.col("lang").alias("quadrant"), "source", F.concat(F.lit("g"), (number % 4).cast("string")).alias("grp"),
                              F.concat(F.lit("t"), (F.col("doc_id") % 4).cast("string")).alias("topic"), (F.col("doc_id") * 7919 % 97).alias("score"))
    target, shares, topics, seed, caps, share, least = _MATCHED
    return matched_sample(d, "quadrant", "source", "grp", "topic", "score", "doc_id", target, shares, topics, seed, *caps, share, least).select("doc_id", "quadrant", "stage", "place")


@query("l11_weights", "select source, count(*) as n_rows, round(least(3.0, (select count(*) from documents) / ((select count(distinct source) from documents) * count(*)))::double, 6) as weight from documents group by source")
def _(t):
    return O.group_weights(t("documents"), "source").select("source", "n_rows", F.round("weight", 6).alias("weight"))


@query("l12_folds", "select fold, count(*) as n, sum(doc_id)::bigint as ids from (select doc_id, ((row_number() over (order by md5('6:' || doc_id::varchar), doc_id) - 1) % 5)::int as fold from documents) group by fold")
def _(t):
    return O.folds(t("documents"), "doc_id", 5, 6).groupBy("fold").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


_POOL = f"""pool as (select doc_id as document_id, case lang when 'en' then 'left_lib' when 'de' then 'left_auth' when 'fr' then 'right_lib' else 'right_auth' end as quadrant, source, (doc_id % 5)::varchar as topic,
      len({words_sql('text')}) as n_tokens, (doc_id % 97) / 97 as margin, doc_id % 10 < 8 as is_train from documents)"""


def _pool(t):
    lang = F.col("lang")
    quadrant = F.when(lang == "en", "left_lib").when(lang == "de", "left_auth").when(lang == "fr", "right_lib").otherwise("right_auth")
    return t("documents").select(F.col("doc_id").alias("document_id"), quadrant.alias("quadrant"), "source", (F.col("doc_id") % 5).cast("string").alias("topic"), X.word_count(F.col("text")).alias("n_tokens"), ((F.col("doc_id") % 97) / 97).alias("margin"), (F.col("doc_id") % 10 < 8).alias("is_train"))


@query("q1_q13_checks", f"""
    with {_POOL}, tr as (select * from pool where is_train), va as (select * from pool where not is_train), c as (select quadrant, source, topic, count(*) as x from tr group by all),
    sh as (select count(*) / sum(count(*)) over (partition by quadrant) as x from tr group by quadrant, source), th as (select quadrant, topic, count(*) as n, count(*) / sum(count(*)) over (partition by quadrant) as p from tr group by quadrant, topic),
    gr as (select g.quadrant, g.topic, coalesce(th.p, 0) as p from (select * from (select distinct quadrant from tr), (select distinct topic from tr)) g left join th on th.quadrant = g.quadrant and th.topic = g.topic),
    kl as (select sum(a.p * ln((a.p + 1e-9) / (b.p + 1e-9))) as kl from gr a join gr b using (topic) where a.quadrant < b.quadrant group by a.quadrant, b.quadrant), m as (select avg(n_tokens) as l, avg(margin) as g from tr group by quadrant),
    r as (select 'MAX_CELL_SIZE' as check_name, max(x)::double as value, 250.0 as bound from c union all select 'SOURCE_CAP', max(x), 0.7 from sh union all select 'TOPIC_CAP', max(p), 0.5 from th union all select 'TOPIC_KL', max(kl), 8.0 from kl
      union all select 'LENGTH_RATIO', max(l) / min(l), 3.0 from m union all select 'CONF_MARGIN_RATIO', max(g) / min(g), 2.5 from m union all select 'NO_DOC_LEAKAGE:val_indist', (select count(distinct document_id) from va where document_id in (select document_id from tr)), 0.0)
    select check_name, round(value, 6) as value, bound::double as bound, value <= bound as passed from r
    union all select 'NON_EMPTY:train', min(n), 15.0, min(n) >= 15 from (select count(*) as n from tr group by quadrant) union all select 'NON_EMPTY:val_indist', min(n), 15.0, min(n) >= 15 from (select count(*) as n from va group by quadrant)""")
def _(t):
    pool = _pool(t)
    got = R.checks(pool.where("is_train"), {"val_indist": pool.where("not is_train")}, ["left_lib", "left_auth", "right_lib", "right_auth"])
    return got.select("check_name", F.round("value", 6).alias("value"), "bound", "passed")


@query("j17_leak_anti", "select count(*) as n from documents where source = 'src1' and text not in (select text from documents where source = 'src0')")
def _(t):
    d = t("documents").select("source", F.md5("text").alias("k"))
    return O.without_leaks(d.where("source = 'src1'"), d.where("source = 'src0'"), "k").agg(F.count("*").alias("n"))


@query("u1_u5_sets", """
    select (select count(*) from (select text from documents where source = 'src0' intersect select text from documents where source <> 'src0')) as shared,
      (select count(*) from (select text from documents where source = 'src0' except select text from documents where source <> 'src0')) as own, (select count(distinct text) from documents) as texts,
      (select count(*) from (select text from documents group by text having count(*) > 1)) as repeated""")
def _(t):
    d = t("documents").select("source", F.md5("text").alias("k"))
    by = d.groupBy("k").agg(F.count("*").alias("n"), F.count_if(F.col("source") == "src0").alias("a"))
    # All four set operations are one grouping of keys.
    return by.agg(F.count_if(F.expr("a > 0 and n > a")).alias("shared"), F.count_if(F.expr("a > 0 and n = a")).alias("own"), F.count("*").alias("texts"), F.count_if(F.expr("n > 1")).alias("repeated"))
