"""Validation of JSON records by rules as data: every line is parsed once, and each rule is one bit.

Types are those of the raw JSON, as a variant keeps them, so ``true`` isn't a number and ``"1"`` neither. A rule is a name
and a condition that says what is wrong; conditions are Spark expressions over the parsed record, evaluated in one pass.
The rules' order is that of a strict reader: the first one that holds is the reason it would stop with.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textaxis.functions.text import strip

#: Fixed values of the record format.
QUADRANTS = ("left_lib", "left_auth", "right_lib", "right_auth")
REQUIRED = ("example_id", "prompt_text", "quadrant_scores", "bias_magnitude", "target_policy", "hidden_representation_ref")
SUM_TOLERANCE = 1e-6


class RecordError(ValueError):
    """A strict reader met a record that breaks a rule, or a table without records."""


@dataclass(frozen=True)
class Rule:
    """``wrong`` holds where a record breaks the rule; null counts as no. ``after`` names rules that make it moot."""

    name: str
    wrong: Column
    after: tuple[str, ...] = ()


def kind(v: Column) -> Column:
    """object, array, string, number, boolean or null; SQL null where the field is absent."""
    s = F.schema_of_variant(v)
    return F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").when(s.isNotNull(), "number")


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _number(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def _string_rules(v: Column, name: str) -> list[Rule]:
    missing, bad = f"{name}:missing", f"{name}:not_a_string"
    return [Rule(bad, kind(v) != "string", (missing,)), Rule(f"{name}:empty", strip(_text(v)) == "", (missing, bad))]


def _number_rules(v: Column, name: str) -> list[Rule]:
    missing, bad = f"{name}:missing", f"{name}:not_a_number"
    return [Rule(bad, kind(v) != "number", (missing,)), Rule(f"{name}:not_finite", ~_finite(_number(v)), (missing, bad))]


def _quadrant_rules(v: Column, name: str, probability: bool) -> list[Rule]:
    """A record of four finite numbers; of a probability also positive and with sum 1."""
    missing, no_object, few, more, bad, endless, low = (f"{name}:{x}" for x in ("missing", "not_an_object", "missing_keys", "unexpected_keys", "not_numbers", "not_finite", "not_positive"))
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string, variant>"))
    values = [_field(v, q) for q in QUADRANTS]
    any_of = lambda f: F.greatest(*[F.coalesce(f(x), F.lit(False)) for x in values])
    wanted = F.array(*[F.lit(q) for q in QUADRANTS])
    rules = [Rule(no_object, kind(v) != "object", (missing,)), Rule(few, F.size(F.array_except(wanted, keys)) > 0, (missing, no_object)), Rule(more, F.size(F.array_except(keys, wanted)) > 0, (missing, no_object)),
             Rule(bad, any_of(lambda x: kind(x) != "number"), (missing, no_object)), Rule(endless, any_of(lambda x: ~_finite(_number(x))), (missing, no_object, bad))]
    if probability:
        total = sum((_number(x) for x in values[1:]), _number(values[0]))
        rules += [Rule(low, any_of(lambda x: _number(x) <= 0), (missing, no_object, few, bad)), Rule(f"{name}:sum", F.abs(total - 1) > SUM_TOLERANCE, (missing, no_object, few, bad, endless))]
    return rules


def record_rules(v: Column, file: str | None = None, rows: int | None = None) -> list[Rule]:
    """The rules of a training record in the order in which a strict reader checks them.

    ``file`` is the name that every reference must have before its colon, ``rows`` the number of rows it may point to.
    """
    rules = [Rule("not_an_object", kind(v) != "object")]
    rules += [Rule(f"{f}:missing", _field(v, f).isNull(), ("not_an_object",)) for f in REQUIRED]
    rules += _string_rules(_field(v, "example_id"), "example_id") + _string_rules(_field(v, "prompt_text"), "prompt_text") + _number_rules(_field(v, "bias_magnitude"), "bias_magnitude")
    rules += _quadrant_rules(_field(v, "quadrant_scores"), "quadrant_scores", False) + _quadrant_rules(_field(v, "target_policy"), "target_policy", True)
    ref, name = _field(v, "hidden_representation_ref"), "hidden_representation_ref"
    text = _text(ref)
    gone, bad, bare, nameless, odd = (f"{name}:{x}" for x in ("missing", "not_a_string", "no_colon", "no_file", "no_row"))
    at = F.regexp_extract(text, r"(?s)^(.*):([^:]*)$", 2)
    number = F.when(at.rlike(r"^\s*[+-]?\d+(_\d+)*\s*$"), F.regexp_replace(at, r"[\s_]", "")).try_cast("decimal(38,0)")
    before = F.regexp_extract(text, r"(?s)^(.*):([^:]*)$", 1)
    rules += [Rule(bad, (kind(ref) != "string") | (text == ""), (gone,)), Rule("metadata:not_an_object", kind(_field(v, "metadata")) != "object"), Rule(bare, ~text.contains(":"), (gone, bad)),
              Rule(nameless, before == "", (gone, bad, bare)), Rule(odd, number.isNull(), (gone, bad, bare, nameless)), Rule(f"{name}:negative", number < 0, (gone, bad, bare, odd))]
    if file is not None:
        rules.append(Rule(f"{name}:other_file", before != file, (gone, bad, bare, nameless)))
    if rows is not None:
        rules.append(Rule(f"{name}:out_of_range", number >= rows, (gone, bad, bare, odd)))
    return rules


def validate_records(lines: DataFrame, line: str, order: str, file: str | None = None, rows: int | None = None) -> DataFrame:
    """``(order, example_id, failed, reasons, first_reason)`` of each line that isn't blank.

    ``failed`` has a bit for each rule of ``rule_names``; ``reasons`` names them in that order; ``first_reason`` is what a strict
    reader would stop with, null if the record is fine. A line that isn't JSON (also one with a key twice, or NaN) has
    the one reason ``invalid_json``. ``repeated_id``: an earlier line by ``order``, which tells lines apart, has the same example_id;
    of a hot id no task gathers the lines. An empty table gives no rows.
    """
    parsed = lines.where(F.trim(F.coalesce(line, F.lit(""))) != "").select(F.col(order).alias("__o"), F.try_parse_json(line).alias("__v"))
    rules = record_rules(F.col("__v"), file, rows)
    bits: dict[str, Column] = {"invalid_json": F.col("__v").isNull()}
    out = parsed.withColumn("__b0", bits["invalid_json"])
    names = ["invalid_json"]
    for rule in rules:  # a rule's condition is a column of its own, so moot ones look it up instead of repeating it
        moot = F.lit(False)
        for other in ("invalid_json", "not_an_object", *rule.after):
            if other in names and other != rule.name:
                moot = moot | F.col(f"__b{names.index(other)}")
        out = out.withColumn(f"__b{len(names)}", ~moot & F.coalesce(rule.wrong, F.lit(False)))
        names.append(rule.name)
    text = _field(F.col("__v"), "example_id")
    out = out.withColumn("example_id", F.when(kind(text) == "string", _text(text)))
    first = out.where("example_id is not null").groupBy("example_id").agg(F.min("__o").alias("__first"), F.count("*").alias("__c")).where("__c > 1")
    out = out.join(first.select("example_id", "__first"), "example_id", "left")
    names.append("repeated_id")
    out = out.withColumn(f"__b{len(names) - 1}", F.coalesce(F.col("__o") > F.col("__first"), F.lit(False)))
    failed = F.lit(0).cast("long")
    for i in range(len(names)):
        failed = failed + F.when(F.col(f"__b{i}"), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    reasons = F.array_compact(F.array(*[F.when(F.col(f"__b{i}"), n) for i, n in enumerate(names)]))
    return out.select(F.col("__o").alias(order), "example_id", failed.alias("failed"), reasons.alias("reasons")).withColumn("first_reason", F.get("reasons", F.lit(0)))


def rule_names(file: str | None = None, rows: int | None = None) -> list[str]:
    """The names of the bits of ``failed``, from the lowest."""
    return ["invalid_json", *[r.name for r in record_rules(F.lit(None), file, rows)], "repeated_id"]


def require_valid(report: DataFrame, order: str, rows: int | None = None, width: int | None = None, expected_width: int | None = None) -> None:
    """Raise ``RecordError`` with the first bad record by ``order`` and its first reason; also if there are no records, more than
    ``rows``, or the referenced vectors are ``width`` wide and not ``expected_width``. The report is read once."""
    got = report.agg(F.count("*").alias("n"), F.min_by(F.struct(order, "example_id", "first_reason"), F.when(F.col("first_reason").isNotNull(), F.col(order))).alias("bad")).first()
    if not got["n"]:
        raise RecordError("there are no records")
    if got["bad"] is not None:
        raise RecordError(f"[{got['bad']['example_id']}] {got['bad']['first_reason']} ({order} {got['bad'][order]})")
    if rows is not None and got["n"] > rows:
        raise RecordError(f"{got['n']} records for {rows} rows")
    if width is not None and expected_width is not None and width != expected_width:
        raise RecordError(f"vectors are {width} wide, not {expected_width}")
