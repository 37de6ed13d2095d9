"""Queries of the text operators over ``documents``, ``conversations``, ``pages`` and others."""

from __future__ import annotations

from pyspark.sql import functions as F

from textaxis.functions import text as X
from textaxis.plans.registry import Registry
from textaxis.sources import normalize as N

registry = Registry()
query = registry.query
C = X.SPACE_CLASS


def words_sql(x: str) -> str:
    return f"list_filter(string_split_regex(coalesce({x}, ''), '[{C}]+'), lambda w: w <> '')"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{C}]+|[{C}]+$', '', 'g')"


def hits_sql(x: str, phrases) -> str:
    low = f"regexp_replace(lower(coalesce({x}, '')), '’', '''', 'g')"
    quoted = [p.replace("'", "''") for p in phrases]
    return "(" + " + ".join(f"contains({low}, '{p}')::int" for p in quoted) + ")"


def opener_sql(x: str) -> str:
    low = f"regexp_replace(lower({strip_sql(x)}), '’', '''', 'g')"
    quoted = [p.replace("'", "''") for p in X.REFUSAL_OPENERS]
    return "(" + " or ".join(f"starts_with({low}, '{p}')" for p in quoted) + ")"


@query("p2_normalize_whitespace", f"""
    select doc_id, md5({strip_sql("regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")}) as h from documents""")
def _(t):
    return t("documents").select("doc_id", F.md5(X.normalize_whitespace(F.col("text"))).alias("h"))


@query("p3_collapse", f"select doc_id, md5(array_to_string({words_sql('text')}, ' ')) as h from documents")
def _(t):
    return t("documents").select("doc_id", F.md5(X.collapse(F.col("text"))).alias("h"))


@query("p4_match_key", f"""
    select doc_id, md5(array_to_string({words_sql("regexp_replace(lower(text), '[^\\p{L}\\p{N}_" + C + "]', '', 'g')")}, ' ')) as h from documents""")
def _(t):
    return t("documents").select("doc_id", F.md5(X.match_key(F.col("text"))).alias("h"))


@query("p5_coerce_text", f"""
    select event_id, case when lower({strip_sql('x')}) in ('nan','none','nat','') then null else {strip_sql('x')} end as v
    from (select event_id, case event_id % 5 when 0 then ' NaN ' when 1 then 'None' when 2 then event_type || ' ' when 3 then '' else event_type end as x from events)""")
def _(t):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, " NaN ").when(k == 1, "None").when(k == 2, F.concat("event_type", F.lit(" "))).when(k == 3, "").otherwise(F.col("event_type"))
    return t("events").select("event_id", X.coerce_text(raw).alias("v"))


@query("p6_p8_dates", """
    select o_orderkey, nullif(regexp_extract(d, '^(\\d{4}-\\d{2}-\\d{2})', 1), '') as iso, case when length(d) >= 4 then substr(d, 1, 3) || '0' else 'unknown' end as decade
    from (select o_orderkey, case when o_orderkey % 7 = 0 then 'n/a' else strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') end as d from orders)""")
def _(t):
    d = F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return t("orders").select("o_orderkey", X.iso_date(d).alias("iso"), X.decade(d).alias("decade"))


@query("p7_epoch_date", """
    select event_id, case when event_id % 9 = 0 then null else strftime(to_timestamp(1000000000 + event_id * 86413) at time zone 'UTC', '%Y-%m-%d') end as d from events""")
def _(t):
    raw = F.when(F.col("event_id") % 9 == 0, "soon").otherwise((F.lit(1000000000) + F.col("event_id") * 86413).cast("string"))
    return t("events").select("event_id", X.epoch_date(raw).alias("d"))


@query("p9_tag_list", """
    select doc_id, len(l) as n, array_to_string(l, '|') as tags from (
      select doc_id, list_filter([lang, source, case when doc_id % 3 = 0 then '' else 'x' end], lambda v: v <> '') as l from documents)""")
def _(t):
    last = F.when(F.col("doc_id") % 3 == 0, "").otherwise("x")
    literal = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("['"), F.col("lang"), F.lit("', \""), F.col("source"), F.lit("\", '"), last, F.lit("']"))).otherwise(F.concat_ws(", ", "lang", "source", last))
    tags = X.tag_list(literal)
    return t("documents").select("doc_id", F.size(tags).cast("long").alias("n"), F.array_join(tags, "|").alias("tags"))


@query("p10_word_count", f"select doc_id, len({words_sql('text')}) as n_words from documents")
def _(t):
    return t("documents").select("doc_id", X.word_count(F.col("text")).alias("n_words"))


@query("p11_p12_ids", """
    select doc_id, substr(md5(text), 1, 8) as short, 'doc_' || substr(md5(text), 1, 8) || '_' || lpad(doc_id::varchar, 7, '0') as synthetic from documents""")
def _(t):
    return t("documents").select("doc_id", X.short_hash(F.col("text")).alias("short"), X.synthetic_id("doc", F.col("text"), F.col("doc_id")).alias("synthetic"))


@query("p13_case_maps", """
    select c_custkey, case c_mktsegment when 'BUILDING' then 'house' when 'MACHINERY' then 'senate' else 'other' end as chamber,
      case when c_nationkey % 2 = 0 then 'D' else 'R' end as party from customer""")
def _(t):
    chamber = F.coalesce(F.create_map(F.lit("BUILDING"), F.lit("house"), F.lit("MACHINERY"), F.lit("senate"))[F.col("c_mktsegment")], F.lit("other"))
    return t("customer").select("c_custkey", chamber.alias("chamber"), F.when(F.col("c_nationkey") % 2 == 0, "D").otherwise("R").alias("party"))


@query("p14_templates", """
    select r_regionkey, n_nationkey, replace(replace('As {name}, I say that {statement}.', '{name}', n_name), '{statement}', lower(r_name)) as pos from nation, region""")
def _(t):
    made = F.replace(F.replace(F.lit("As {name}, I say that {statement}."), F.lit("{name}"), F.col("n_name")), F.lit("{statement}"), F.lower("r_name"))
    return t("nation").crossJoin(F.broadcast(t("region"))).select("r_regionkey", "n_nationkey", made.alias("pos"))


@query("p15_render_options", """
    select conv_id, array_to_string(list_transform(list_filter(l, lambda o: o <> 'Refused'), lambda o, i: chr((64 + i)::int) || '. ' || o), chr(10)) as body
    from (select conv_id, list(role || turn::varchar order by turn) || ['Refused'] as l from conversations where turn < 26 group by conv_id)""")
def _(t):
    by = t("conversations").where("turn < 26").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.col("turn").cast("string")).alias("o")))).alias("l"))
    return by.select("conv_id", X.render_options(F.concat(F.col("l.o"), F.array(F.lit("Refused")))).alias("body"))


@query("p16_p17_sanitize", f"""
    select page_id, regexp_replace(regexp_replace(url, '/', '__', 'g'), '[^A-Za-z0-9._\\-]', '_', 'g') as k,
      {strip_sql("regexp_replace('Be fair. Answer on the following scale: 1 to ' || page_id::varchar || '. Go.', '(?i)[ \\t\\n]*Answer on the following scale[^.]*\\.', '', 'g')")} as persona from pages""")
def _(t):
    persona = F.concat(F.lit("Be fair. Answer on the following scale: 1 to "), F.col("page_id").cast("string"), F.lit(". Go."))
    return t("pages").select("page_id", X.sanitize_key(F.col("url")).alias("k"), X.strip_scale_instruction(persona).alias("persona"))


@query("p18_p19_references", """
    select event_id, (event_id % 50)::int as chunk, event_id * 3 as row_index from events""")
def _(t):
    e = F.col("event_id")
    chunk = F.concat(F.lit("d_chunky_"), e.cast("string"), F.lit("_chunk"), (e % 50).cast("string"))
    return t("events").select("event_id", X.chunk_number(chunk).alias("chunk"), X.row_reference(F.concat(F.lit("a:b:"), (e * 3).cast("string"))).alias("row_index"))


@query("p20_p22_names", """
    select c_custkey, upper(split_part(c_name, '#', 1)) as last, split_part(c_name, '#', 2) as first,
      coalesce(nullif(case when c_custkey % 2 = 0 then '' else c_mktsegment end, ''), nullif(case when c_custkey % 3 = 0 then '' else c_name end, ''), 'unknown') as source from customer""")
def _(t):
    parts = F.split("c_name", "#", 2)
    a, b = F.when(F.col("c_custkey") % 2 == 0, " ").otherwise(F.col("c_mktsegment")), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name"))
    return t("customer").select("c_custkey", F.upper(parts[0]).alias("last"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("first"), X.first_filled(a, b).alias("source"))


@query("p21_preview", "select doc_id, md5(substr(text, 1, 300)) as preview from documents")
def _(t):
    """A preview of 300 characters is the operator itself; its hash is compared."""
    return t("documents").select("doc_id", F.md5(F.substring("text", 1, 300)).alias("preview"))


@query("p25_half_even", "select l_orderkey, l_linenumber, (round_even(l_quantity * 25, -1))::double as q from lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", X.half_even(F.col("l_quantity") * 25, -1).cast("double").alias("q"))


@query("p26_duplicate_key", f"""
    select k, count(*) as n from (select array_to_string({words_sql("regexp_replace(lower(c_name), '[^\\p{L}\\p{N}_" + C + "]', '', 'g')")}, ' ') || '||' ||
      array_to_string({words_sql("regexp_replace(lower(c_mktsegment), '[^\\p{L}\\p{N}_" + C + "]', '', 'g')")}, ' ') as k from customer) group by k""")
def _(t):
    return t("customer").groupBy(X.duplicate_key(F.col("c_name"), F.col("c_mktsegment")).alias("k")).agg(F.count("*").alias("n"))


@query("x5_distinct_n", f"""
    with w as (select conv_id, turn, {words_sql('lower(text)')} as w from conversations),
    g as (select conv_id, turn, w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) as b from w)
    select conv_id, turn, len(w) as n_words, case when len(w) > 0 then round(len(list_distinct(w)) / len(w), 9) else 0.0 end as distinct_1,
      case when len(w) > 1 then round(len(list_distinct(b)) / len(b), 9) else 0.0 end as distinct_2,
      case when len(w) > 0 then round(list_max(map_values(list_histogram(w))) / len(w), 9) else 0.0 end as max_word, len(w) < 5 as short from g""")
def _(t):
    c = F.col("text")
    return t("conversations").select(
        "conv_id", "turn", X.word_count(c).alias("n_words"), F.round(X.distinct_ratio(c, 1), 9).alias("distinct_1"), F.round(X.distinct_ratio(c, 2), 9).alias("distinct_2"),
        F.round(X.max_word_share(c), 9).alias("max_word"), (X.word_count(c) < 5).alias("short"))


@query("x6_x8_heuristics", f"""
    select doc_id, ((len({words_sql('text')}) > 0)::int + (len({words_sql('text')}) between 20 and 220)::int + (len(regexp_extract_all(text, '[.?!]')) >= 2)::int
      + (not {opener_sql('text')})::int + (len(list_filter({words_sql('text')}, lambda v: length(v) > 7)) > 0)::int) / 5 as quality,
      {hits_sql('text', X.REFUSAL_PHRASES)} > 0 as refusal, round(least(1.0, {hits_sql('text', X.VAGUE_PHRASES)} * 0.2 + case when len({words_sql('text')}) < 30 then 0.3 else 0.0 end)::double, 6) as vague from documents""")
def _(t):
    c = F.col("text")
    return t("documents").select("doc_id", X.quality_score(c).alias("quality"), X.contains_any(c, X.REFUSAL_PHRASES).alias("refusal"), F.round(X.vagueness_score(c), 6).alias("vague"))


def _boilerplate_sql(x: str) -> str:
    return "coalesce(" + ", ".join(f"case when regexp_matches({x}, '(?i){p}') then '{p}' end" for p in X.BOILERPLATE_PATTERNS) + ")"


@query("x9_boilerplate", f"select pattern, count(*) as n from (select {_boilerplate_sql('html')} as pattern from pages) group by pattern")
def _(t):
    return t("pages").groupBy(X.first_boilerplate(F.col("html")).alias("pattern")).agg(F.count("*").alias("n"))


@query("x10_procedural", f"select doc_id, {hits_sql('text', X.PROCEDURAL_PHRASES)} > 0 as procedural from documents")
def _(t):
    return t("documents").select("doc_id", X.contains_any(F.col("text"), X.PROCEDURAL_PHRASES).alias("procedural"))


@query("x11_verdicts", """
    select event_id, case when event_id % 4 <> 0 then case event_id % 3 when 0 then 'A' when 1 then 'B' else 'tie' end end as neutrality from events""")
def _(t):
    e = F.col("event_id")
    winner = F.when(e % 3 == 0, "A").when(e % 3 == 1, "B").otherwise("tie")
    body = F.concat(F.lit('Sure: {"neutrality": "'), winner, F.lit('", "coherence": "A", "relevance": "'), F.when(e % 4 == 0, "C").otherwise("tie"), F.lit('"}\nDone.'))
    return t("events").select("event_id", X.verdict(body)["neutrality"].alias("neutrality"))


@query("x12_ordinal", """
    select conv_id, n between 2 and 6 and contains(roles, 'user') as ordinal from (select conv_id, count(*) as n, string_agg(role, ' ') as roles from conversations group by conv_id)""")
def _(t):
    by = t("conversations").groupBy("conv_id").agg(F.collect_list("role").alias("o"))
    return by.select("conv_id", X.is_ordinal(F.lit("How often?"), F.concat("o", F.array(F.lit("Refused"))), ("user",)).alias("ordinal"))


@query("p1_normalize_sources", f"""
    select document_id, source_name, source_family, language, date, n_words from (
      select 'documents_' || substr(md5(text), 1, 8) || '_' || lpad(doc_id::varchar, 7, '0') as document_id, source as source_name, 'documents' as source_family, lang as language, null::varchar as date,
        len({words_sql('text')}) as n_words from documents
      union all select 'pages_' || substr(md5(html), 1, 8) || '_' || lpad(page_id::varchar, 7, '0'), split_part(split_part(url, '//', 2), '/', 1), 'pages',
        coalesce(nullif(regexp_extract(url, 'example\\.[a-z]+/([a-z][a-z])/', 1), ''), 'und'), null, len({words_sql("regexp_replace(html, '<[^>]*>', ' ', 'g')")}) from pages
      union all select 'conversations_' || substr(md5(text), 1, 8) || '_' || lpad((conv_id * 1000 + turn)::varchar, 7, '0'), role, 'conversations', 'und', null, len({words_sql('text')}) from conversations) where n_words >= 3""")
def _(t):
    docs = N.normalize_documents(t("documents")).unionByName(N.normalize_pages(t("pages"))).unionByName(N.normalize_conversations(t("conversations")))
    return N.at_least_words(docs, {}, 3).select("document_id", "source_name", "source_family", "language", "date", "n_words")
