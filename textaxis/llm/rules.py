"""Quality rules as a bitmask ledger: each rule is evaluated once, verdicts are read off the stored bits.

The ledger holds the measurements and, per document, one long in which bit i says that rule i failed. A policy is a
versioned set of rules; applying one is a bitwise AND, and ablations (what a policy rejects only because of one rule,
what it would reject without it) are sums over the same bits. No rule looks at the text a second time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textaxis.llm.words import give_back
from textaxis.session import materialize, scratch

_SYMBOLS = "#*$%&|<>"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))

#: The rules, in bit order: never reorder, only append, so that stored ledgers stay readable. Each is true on failure.
#: All ratios are in whole numbers, so that every engine decides alike.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_phrases": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 40 * n_words",
    "repeated_lines": "n_dup_lines >= 3 and 100 * n_dup_lines > 50 * n_lines",
    "long_words": "word_chars > 25 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "shouting": "100 * n_upper > 50 * word_chars",
}
#: Versioned policies: name -> rules.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_phrases"),
    "v1": ("few_words", "repeated_phrases", "symbols", "shouting"),
    "v2": tuple(RULES),
}


def measure(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word), n_upper (A-Z) of a text."""
    if not text:
        return (0,) * len(_COUNTS)
    raw = text.encode()
    words = raw.split()  # of bytes: white space is exactly 0x20 and 0x09 to 0x0D
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    triples = list(zip(words, words[1:], words[2:], strict=False))
    repeat = 0
    if len(set(triples)) < len(triples):
        often, at = Counter(triples), 0
        for i, t in enumerate(triples):
            if often[t] > 1:
                repeat += i + 3 - max(at, i)
                at = i + 3
    upper = len(raw) - len(raw.translate(None, _CAPITALS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat, len(lines), upper


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = list(zip(*map(measure, batch.column("text").to_pylist()), strict=True)) or [[]] * len(_COUNTS)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in got)],
                                         names=["doc_id", *_COUNTS])


def mask_of(rules: tuple[str, ...]) -> int:
    """The bits of a set of rules."""
    return sum(1 << i for i, name in enumerate(RULES) if name in rules)


def ledger(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the measurements and ``failed``, the bits of the failed rules.

    A null or empty text has zero everywhere and fails ``few_words``. Repeated rows and rows without doc_id have an
    entry each; an empty table has none; texts of any length are measured whole; other columns are ignored. One scan,
    no shuffle.
    """
    shape = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_measures, shape).withColumn("failed", failure_bits())


def failure_bits(of: str = "") -> Column:
    """Every rule once, bit i for rule i; measurements are columns, or fields of the struct column ``of``."""
    inner = rf"{of}.\1" if of else r"\1"
    failed = F.lit(0)
    for i, rule in enumerate(RULES.values()):
        rule = re.sub(r"\b(n_\w+|word_chars)\b", inner, rule)
        failed = failed.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)))
    return failed.cast("long")


def passes(failed: Column, policy: str) -> Column:
    """Whether a policy keeps a document with these failure bits."""
    return failed.bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0


def ablation(led: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents failing it, failing it alone, and rejected by the policy without it.

    One aggregate over the stored bits; the rule rows are unpivoted from its single result row.
    """
    rules = POLICIES[policy]
    mine = F.col("failed").bitwiseAND(F.lit(mask_of(rules)))
    sums = []
    for name in rules:
        bit = mask_of((name,))
        sums.append(F.struct(
            F.lit(name).alias("rule"), F.count_if(mine.bitwiseAND(F.lit(bit)) != 0).alias("failed"),
            F.count_if(mine == bit).alias("failed_alone"), F.count_if(mine.bitwiseAND(F.lit(~bit)) != 0).alias("rejected_without"),
        ))
    return led.agg(F.array(*sums).alias("rows")).select(F.inline("rows"))


def ablations(docs: DataFrame) -> DataFrame:
    """``(policy, rule, failed, failed_alone, rejected_without)`` for every policy, from one stored ledger of ``docs``."""
    with scratch(docs.sparkSession) as keep:
        led = materialize(ledger(docs).select("failed"), "ledger")
        parts = [ablation(led, policy).select(F.lit(policy).alias("policy"), "*") for policy in POLICIES]
        return keep(materialize(reduce(DataFrame.unionByName, parts), "ablations"))


def verdicts(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` (the policy's verdict; false wherever the base fails), row for row."""
    base = ~passes(F.col("failed"), "base")
    led = ledger(docs).withColumn("base_failed", base)
    return led.withColumn("kept", ~F.col("base_failed") & passes(F.col("failed"), policy))


def filter_quality(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all their columns and no shuffle.

    Each row gets its ledger entry in the same scan, and the verdict is read off its bits, so rows need no key. A row
    without text goes; repeated rows are judged alike; an empty table stays empty; texts are measured whole.
    """

    @F.pandas_udf("struct<" + ", ".join(f"{c} long" for c in _COUNTS) + ">")
    def counts(text):
        import pandas as pd

        out = pd.DataFrame([measure(t) for t in text], columns=list(_COUNTS))
        give_back()
        return out

    led = docs.withColumn("__m", counts(F.col("text").cast("string"))).withColumn("__failed", failure_bits("__m"))
    return led.where(passes(F.col("__failed"), "base") & passes(F.col("__failed"), policy)).select(*docs.columns)
