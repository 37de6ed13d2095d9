"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({x}, '[^\x20\x09-\x0D]+')"

OP2 = rf"""
    with w as (select doc_id, coalesce(text, '') as text, {_WORDS.format(x="coalesce(text, '')")} as w from documents),
    m as (select doc_id, w, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
      list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines, len(regexp_extract_all(text, '[A-Z]')) as n_upper from w),
    t as (select doc_id, i, count(*) over (partition by doc_id, g) as c from (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w))),
    r as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from t where c > 1) group by doc_id),
    a as (select m.doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(lines) as n_lines, n_upper from m left join r on m.doc_id = r.doc_id),
    f as (select *, ((n_words < 50)::int + 2 * (100 * n_repeat_words > 50 * n_words)::int + 4 * (100 * n_symbols > 40 * n_words)::int + 8 * (n_dup_lines >= 3 and 100 * n_dup_lines > 50 * n_lines)::int
      + 16 * (word_chars > 25 * n_words)::int + 32 * (word_chars < 2 * n_words)::int + 64 * (100 * n_upper > 50 * word_chars)::int)::bigint as failed from a)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 as base_failed, failed & 71 = 0 as kept, failed from f"""

OP5 = rf"""
    with w as (select doc_id, {_WORDS.format(x="coalesce(text, '')")} as w from documents),
    win as (select doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from w where len(w) >= 50)),
    f as (select h, min(doc_id) as f from win group by h),
    cov as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 50)) as p from win join f using (h) where doc_id > f)),
    pos as (select doc_id, unnest(range(1, len(w) + 1)) as p, unnest(w) as x from w),
    kept as (select doc_id, list(x order by p) as l from pos anti join cov using (doc_id, p) group by doc_id)
    select w.doc_id, len(w) as n_words, len(w) - coalesce(len(l), 0) as n_removed, sha256(coalesce(array_to_string(l, ' '), '')) as kept_sha256 from w left join kept on w.doc_id = kept.doc_id"""

OP8 = rf"""
    with recursive w as (select doc_id, {_WORDS.format(x=_LOWER)} as w from documents),
    s as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)),
    n as (select doc_id, count(*) as n from s group by doc_id),
    c as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
    l as (select c.a, c.b from c join n x on c.a = x.doc_id join n y on c.b = y.doc_id where 100 * i >= 75 * (x.n + y.n - i)),
    reach as (select doc_id, doc_id as r from documents union select reach.doc_id, l.b from reach join l on reach.r = l.a)
    select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, r.c as component_id from documents d left join n on d.doc_id = n.doc_id join (select doc_id, min(r) as c from reach group by doc_id) r on r.doc_id = d.doc_id"""

OP10 = r"""
    with b as (select page_id, md5(coalesce(html, '')) as tag, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '(?i)^https?://', '') as bare from pages),
    p as (select page_id, tag, regexp_extract(bare, '^([^?]*)', 1) as place, regexp_replace(regexp_replace(regexp_extract(bare, '\?(.*)$', 1), '(?i)(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&+', '') as kept from b),
    u as (select page_id, tag, regexp_replace(lower(regexp_extract(place, '^([^/]*)', 1)), '^www\.|:(80|443)$', '', 'g') || regexp_replace(regexp_replace(place, '^[^/]*', ''), '/+$', '')
      || case when kept = '' then '' else '?' || array_to_string(list_sort(string_split(kept, '&')), '&') end as url_key from p),
    t as (select *, ('0x' || substr(md5('full' || page_id), 1, 8))::bigint as t1, ('0x' || substr(md5('again' || page_id), 1, 8))::bigint as t2 from u),
    a as (select r.page_id, r.url_key, r.tag, arg_max(s.page_id, (s.t1, s.page_id)) as ref, arg_max(s.tag, (s.t1, s.page_id)) as ref_tag
      from t r left join t s on r.url_key = s.url_key and (s.t1 < r.t2 or (s.t1 = r.t2 and s.page_id <= r.page_id)) group by r.page_id, r.url_key, r.tag),
    v as (select *, case when ref is null then 'orphan' when case page_id % 3 when 1 then substr(tag, 1, 2) = substr(ref_tag, 1, 2) else tag = ref_tag end then 'resolved' else 'mismatch' end as resolution from a)
    select page_id, url_key, ref as refers_to_page, resolution, case when resolution = 'resolved' then ref_tag end as etag, case when resolution = 'resolved' then 'text/html' end as content_type from v"""

OP11 = rf"""
    with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source, {_LOWER} as t from documents),
    w as (select rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
    kept as (select lang, term, count(*)::hugeint as ln from w group by all having count(distinct rid) >= 30),
    v as (select lang, count(*)::hugeint as v, sum(ln)::hugeint as n from kept group by lang),
    g as (select distinct lang, source from d),
    c as (select lang, source, term, count(*)::hugeint as n from w semi join kept using (lang, term) group by all),
    gn as (select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as n from g left join c on g.lang = c.lang and g.source = c.source group by all),
    p as (select gn.lang, gn.source, kept.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (gn.n + 5 * v.v) as p,
        1 + (1000000000::hugeint * (kept.ln + 5)) // (v.n + 5 * v.v) as q
      from gn join kept on gn.lang = kept.lang join v on v.lang = gn.lang left join c on c.lang = gn.lang and c.source = gn.source and c.term = kept.term),
    s as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
    pair as (select x.lang, x.source, 'pair' as part, y.source as item, coalesce(s.value, 0)::bigint as value from g x join g y on x.lang = y.lang and x.source <> y.source
      left join s on s.lang = x.lang and s.source = x.source and s.item = y.source),
    term as (select lang, source, 'term' as part, term as item, (p - q)::bigint as value from p where n > 0 and p > q),
    ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pair union all select * from term))
    select * from ranked where part = 'pair' or rank <= 50"""

OP12 = OP8.replace("w[i : i + 4]", "w[i : i + 2]").replace("len(w) - 4", "len(w) - 2").replace(">= 75 *", ">= 85 *").replace(
    "r.c as component_id from", "r.c as component_id, d.doc_id = r.c as kept from")

OP13 = rf"""
    with d as (select row_number() over () as rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
    g as (select count(*) filter (where len(w) > 0)::bigint as n, sum(len(w))::bigint as l from d),
    tf as (select rid, term, count(*) as tf from (select rid, unnest(w) as term from d) group by all),
    q as (select item_id, term, count(*) as times from (select item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all),
    wt as (select term, floor(1000 * ln((2 * max(g.n)::double + 2) / (2 * count(*)::double + 1)))::bigint as w from tf, g where term in (select term from q) group by term),
    s as (select q.item_id, tf.rid, sum(q.times * wt.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * len(d.w) * g.n) // g.l))))::bigint as score
      from q join tf on q.term = tf.term join wt on wt.term = q.term join d on d.rid = tf.rid, g group by all),
    r as (select item_id, d.doc_id, score, row_number() over (partition by item_id order by score desc, d.doc_id)::int as rank from s join d on d.rid = s.rid where score > 0)
    select item_id, rank, doc_id, score from r where rank <= 10"""

_LEDGER = OP2[:OP2.rindex("select doc_id")] + "select failed from f"
_RULES = ("few_words", "repeated_phrases", "symbols", "repeated_lines", "long_words", "short_words", "shouting")


def ablations(policies: dict[str, tuple[str, ...]]) -> str:
    """SQL for the ablations of all policies."""
    parts = []
    for policy, rules in policies.items():
        mask = sum(1 << _RULES.index(r) for r in rules)
        for rule in rules:
            bit = 1 << _RULES.index(rule)
            parts.append(f"""select '{policy}' as policy, '{rule}' as rule, count(*) filter (where failed & {bit} <> 0) as failed,
      count(*) filter (where failed & {mask} = {bit}) as failed_alone, count(*) filter (where failed & {mask & ~bit} <> 0) as rejected_without from led""")
    return f"with led as ({_LEDGER}) " + " union all ".join(parts)
