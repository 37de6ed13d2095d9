"""Queries of record validation: JSON lines made of ``events`` rows, most of them with some fault."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from textaxis.operators import records as V
from textaxis.plans.registry import Registry

registry = Registry()
query = registry.query

_FOUR, _POLICY = dict.fromkeys(V.QUADRANTS, 0.5), {"left_lib": 0.25, "left_auth": 0.25, "right_lib": 0.125, "right_auth": 0.375}
_GOOD = {"example_id": "e{id}", "prompt_text": "say {id}", "quadrant_scores": _FOUR, "bias_magnitude": 1.5, "target_policy": _POLICY, "hidden_representation_ref": "h.pt:{row}"}
_LINES = [json.dumps(x) for x in (
    _GOOD, _GOOD | {"metadata": {"a": 1}}, _GOOD | {"metadata": "a"}, {k: v for k, v in _GOOD.items() if k != "target_policy"}, _GOOD | {"example_id": 7}, _GOOD | {"prompt_text": "  "}, _GOOD | {"bias_magnitude": True},
    _GOOD | {"bias_magnitude": None}, _GOOD | {"quadrant_scores": _FOUR | {"left_lib": "1"}}, _GOOD | {"quadrant_scores": {"left_lib": 1}}, _GOOD | {"quadrant_scores": _FOUR | {"up": 1}}, _GOOD | {"target_policy": [1]},
    _GOOD | {"target_policy": _POLICY | {"left_lib": 0}}, _GOOD | {"target_policy": _POLICY | {"left_lib": 0.3}}, _GOOD | {"target_policy": _POLICY | {"left_lib": False}}, _GOOD | {"hidden_representation_ref": "h.pt"},
    _GOOD | {"hidden_representation_ref": ":{row}"}, _GOOD | {"hidden_representation_ref": "h.pt:x{row}"}, _GOOD | {"hidden_representation_ref": "h.pt:-{row}"}, _GOOD | {"hidden_representation_ref": "g.pt:{row}"}, [1], "text")] + ["{broken {id}", ""]


def _rules_sql() -> list[tuple[str, str, tuple[str, ...]]]:
    """Each rule's name, what is wrong as SQL over the column ``j``, and the rules that make it moot."""
    kind = lambda f: f"coalesce(json_type(j, '$.{f}'), 'none')"
    text = lambda f: f"(j ->> '$.{f}')"
    number = "('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE')"
    rules = [("not_an_object", "json_type(j) <> 'OBJECT'", ())]
    rules += [(f"{f}:missing", f"{kind(f)} = 'none'", ("not_an_object",)) for f in V.REQUIRED]
    for f in ("example_id", "prompt_text"):
        rules += [(f"{f}:not_a_string", f"{kind(f)} <> 'VARCHAR'", (f"{f}:missing",)), (f"{f}:empty", f"trim({text(f)}) = ''", (f"{f}:missing", f"{f}:not_a_string"))]
    rules.append(("bias_magnitude:not_a_number", f"{kind('bias_magnitude')} not in {number}", ("bias_magnitude:missing",)))
    wanted = "[" + ", ".join(f"'{q}'" for q in V.QUADRANTS) + "]"
    for f in ("quadrant_scores", "target_policy"):
        moot = (f"{f}:missing", f"{f}:not_an_object")
        any_of = lambda cond, f=f: " or ".join(f"coalesce({cond.format(k=kind(f'{f}.{q}'), t=text(f'{f}.{q}'))}, false)" for q in V.QUADRANTS)
        rules += [(moot[1], f"{kind(f)} <> 'OBJECT'", moot[:1]), (f"{f}:missing_keys", f"len(list_filter({wanted}, lambda q: not list_contains(json_keys(j, '$.{f}'), q))) > 0", moot),
                  (f"{f}:unexpected_keys", f"len(list_filter(json_keys(j, '$.{f}'), lambda q: not list_contains({wanted}, q))) > 0", moot), (f"{f}:not_numbers", any_of("{k} <> 'none' and {k} not in " + number), moot)]
        if f == "target_policy":
            moot = (*moot, f"{f}:missing_keys", f"{f}:not_numbers")
            total = " + ".join(f"try_cast({text(f'{f}.{q}')} as double)" for q in V.QUADRANTS)
            rules += [(f"{f}:not_positive", any_of("try_cast({t} as double) <= 0"), moot), (f"{f}:sum", f"abs({total} - 1) > 1e-6", moot)]
    f = "hidden_representation_ref"
    r, at, before = text(f), f"regexp_extract({text(f)}, '^(.*):([^:]*)$', 2)", f"regexp_extract({text(f)}, '^(.*):([^:]*)$', 1)"
    m = tuple(f"{f}:{x}" for x in ("missing", "not_a_string", "no_colon", "no_file", "no_row"))
    rules += [(m[1], f"{kind(f)} <> 'VARCHAR' or {r} = ''", m[:1]), ("metadata:not_an_object", f"{kind('metadata')} not in ('none', 'OBJECT')", ()), (m[2], f"not contains({r}, ':')", m[:2]), (m[3], f"{before} = ''", m[:3]),
              (m[4], f"try_cast({at} as bigint) is null", m[:4]), (f"{f}:negative", f"try_cast({at} as bigint) < 0", (*m[:3], m[4])), (f"{f}:other_file", f"{before} <> 'h.pt'", m[:4]), (f"{f}:out_of_range", f"try_cast({at} as bigint) >= 1000", (*m[:3], m[4]))]
    return rules


def _sql() -> str:
    line = "case event_id % {n} {whens} end".format(n=len(_LINES), whens=" ".join(f"when {i} then '{x}'" for i, x in enumerate(_LINES)))
    names, columns = ["invalid_json"], ["j is null as b0"]
    for name, wrong, after in _rules_sql():
        moot = [f"b{names.index(x)}" for x in ("invalid_json", "not_an_object", *after) if x in names and x != name]
        columns.append(f"not ({' or '.join(moot)}) and coalesce({wrong}, false) as b{len(names)}")
        names.append(name)
    reasons = ", ".join(f"case when b{i} then '{n}' end" for i, n in enumerate(names))
    return f"""
    with l as (select event_id, replace(replace({line}, '{{id}}', (event_id % 9000)::varchar), '{{row}}', (event_id % 1200)::varchar) as line from events),
    v as (select event_id, case when json_valid(line) then line::json end as j from l where trim(line) <> ''),
    b as (select event_id, case when json_type(j, '$.example_id') = 'VARCHAR' then j ->> '$.example_id' end as eid, {', '.join(columns)} from v),
    r as (select event_id, list_filter([{reasons}, case when eid is not null and event_id > min(event_id) over (partition by eid) then 'repeated_id' end], lambda x: x is not null) as reasons from b)
    select reason, count(*) as n, sum(event_id)::bigint as ids, sum((reasons[1] = reason)::int)::bigint as n_first from (select event_id, reasons, unnest(case when len(reasons) = 0 then ['ok'] else reasons end) as reason from r) group by reason"""


@query("q14_q15_record_rules", _sql().replace("sum((reasons[1] = reason)::int)::bigint", "sum(coalesce(reasons[1] = reason, false)::int)::bigint"))
def _(t):
    """How many lines break each rule, and for how many it is the first."""
    e, line = F.col("event_id"), F.lit(None).cast("string")
    for i, x in enumerate(_LINES):
        line = F.when(e % len(_LINES) == i, x).otherwise(line)
    line = F.replace(F.replace(line, F.lit("{id}"), (e % 9000).cast("string")), F.lit("{row}"), (e % 1200).cast("string"))
    got = V.validate_records(t("events").select("event_id", line.alias("line")), "line", "event_id", "h.pt", 1000)
    reason = F.explode(F.when(F.size("reasons") == 0, F.array(F.lit("ok"))).otherwise(F.col("reasons")))
    return got.select("event_id", "first_reason", reason.alias("reason")).groupBy("reason").agg(
        F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.sum(F.coalesce(F.col("first_reason") == F.col("reason"), F.lit(False)).cast("long")).alias("n_first"))
