"""Column builders for text: normalising, coercing, counting, quality and phrase rules.

White space means what ``str.split`` means by it. Patterns name the characters, so that every engine agrees.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, null sentinels and phrase lists.
SPACE_CLASS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
NULL_SENTINELS = ("nan", "none", "nat", "")
REFUSAL_PHRASES = (
    "i can't help", "i cannot help", "i'm unable to", "i am unable to", "i cannot provide", "i can't provide", "i won't", "i will not", "not appropriate", "cannot assist",
)
REFUSAL_OPENERS = ("i can't", "i cannot", "i'm unable", "i am unable", "i won't", "i will not", "as an ai", "as a language model", "i'm sorry", "i am sorry")
VAGUE_PHRASES = (
    "it depends", "on the one hand", "on the other hand", "there are many perspectives", "complex issue", "cannot be answered simply", "both sides", "balanced approach", "nuanced",
)
BOILERPLATE_PATTERNS = (
    r"\bAPA style\b", r"\breference page\b", r"\byour paper\b", r"\bassignment guidelines\b", r"\bwrite a short argument\b", r"\bcomplete the survey\b",
    r"\bsubmit your ideas\b", r"\bwe want to hear from you\b", r"\bdownload the submission form\b", r"\brelated policy papers\b", r"\bnewsletter\b", r"\bsubscribe\b",
)
ORDINAL_KEYWORDS = (
    "agree", "important", "likely", "often", "good", "safe", "worry", "confident", "approve", "support", "positive", "favorable", "concern", "problem", "difficult", "easy",
    "better", "worse", "much", "lot", "satisfied", "priority", "responsibility", "favor", "oppose", "should", "would",
)
# Examples; the real list comes with the speeches and is a parameter.
PROCEDURAL_PHRASES = ("point of order", "i yield", "the question is", "order, order", "madam speaker", "mr. speaker")

_EDGE = f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$"


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, _EDGE, "")


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once per row, also where it stands inside lambdas."""
    return F.element_at(F.transform(F.array(value), then), 1)


def words(x: Column) -> Column:
    """Words between white space; none for null or blank."""
    return F.filter(F.split(F.coalesce(x, F.lit("")), f"[{SPACE_CLASS}]+"), lambda w: w != "")


def word_count(x: Column) -> Column:
    """Number of words; 0 for null."""
    return F.size(words(x)).cast("long")


def collapse(x: Column) -> Column:
    """All white space, no-break and zero-width spaces to single spaces; stripped."""
    spaced = F.regexp_replace(x, r"\x{200B}", " ")
    return F.when(x.isNotNull(), F.array_join(words(spaced), " "))


def normalize_whitespace(x: Column) -> Column:
    """Line ends to LF, blanks and tabs to one blank, three or more line ends to two; stripped."""
    y = F.regexp_replace(F.regexp_replace(x, r"\r\n?", "\n"), r"[ \t]+", " ")
    return strip(F.regexp_replace(y, r"\n{3,}", "\n\n"))


def word_count_in_batches(x: Column) -> Column:
    """As ``word_count``, for whole columns of long texts: Python's own split knows the same white space and makes no arrays."""

    @F.arrow_udf("bigint")
    def count(x):
        import pyarrow as pa

        return pa.array([len(t.split()) if t is not None else 0 for t in x.to_pylist()], pa.int64())

    return count(x)


def match_key(x: Column) -> Column:
    """Lower case, letters, digits, underscores and single spaces only."""
    kept = F.regexp_replace(strip(F.lower(x)), rf"[^\p{{L}}\p{{N}}_{SPACE_CLASS}]", "")
    return F.when(x.isNotNull(), F.array_join(words(kept), " "))


def duplicate_key(*parts: Column) -> Column:
    """Match keys joined by a double bar; null counts as empty."""
    return F.concat_ws("||", *[F.coalesce(match_key(p), F.lit("")) for p in parts])


def coerce_text(x: Column) -> Column:
    """Stripped text; null for the sentinels of missing values."""
    y = strip(x)
    return F.when(F.lower(y).isin(*NULL_SENTINELS), None).otherwise(y)


def iso_date(x: Column) -> Column:
    """The leading YYYY-MM-DD, else null."""
    return F.nullif(F.regexp_extract(x, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def epoch_date(x: Column) -> Column:
    """UTC date of epoch seconds given as text or number, null if it isn't one; years of five digits bear no sign."""
    seconds = F.floor(x.try_cast("double"))
    return F.ltrim(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd"), F.lit("+"))


def decade(date: Column) -> Column:
    """Decade of an ISO date, 'unknown' without one."""
    return F.when(F.length(date) >= 4, F.concat(F.substring(date, 1, 3), F.lit("0"))).otherwise("unknown")


def tag_list(x: Column) -> Column:
    """A list literal in either kind of quotes, else a comma-separated list; empty items go."""
    bare = F.regexp_replace(strip(x), r"^\[|\]$", "")
    items = F.transform(F.split(bare, ","), lambda t: F.regexp_replace(strip(t), "^['\"]|['\"]$", ""))
    return F.filter(items, lambda t: t != "")


def short_hash(x: Column, length: int = 8) -> Column:
    """The first hexadecimal digits of the MD5."""
    return F.substring(F.md5(x), 1, length)


def synthetic_id(prefix: str, x: Column, row: Column) -> Column:
    """Prefix, short hash and row number in seven digits."""
    return F.concat(F.lit(prefix + "_"), short_hash(x), F.lit("_"), F.lpad(row.cast("string"), 7, "0"))


def sanitize_key(x: Column) -> Column:
    """Slashes doubled to underscores, everything but letters, digits, dot, dash and underscore to an underscore."""
    return F.regexp_replace(F.regexp_replace(x, "/", "__"), r"[^A-Za-z0-9._\-]", "_")


def strip_scale_instruction(x: Column) -> Column:
    """Without the sentence that asks for an answer on a scale."""
    return strip(F.regexp_replace(x, r"(?i)[ \t\n]*Answer on the following scale[^.]*\.", ""))


def chunk_number(chunk_id: Column) -> Column:
    """The number behind the last ``_chunk``; anything else raises."""
    return F.substring_index(chunk_id, "_chunk", -1).cast("int")


def row_reference(ref: Column) -> Column:
    """The row number behind the last colon, null if there is none."""
    return F.substring_index(ref, ":", -1).try_cast("long")


def first_filled(*candidates: Column, default: str = "unknown") -> Column:
    """The first candidate that isn't null or blank."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in candidates], F.lit(default))


def without_refused(options: Column, refused: str = "Refused", within: bool = False) -> Column:
    """Options other than the refusal; with ``within`` also without those that mention it in any case. Null options go."""
    if within:
        return F.filter(options, lambda o: ~F.contains(F.lower(o), F.lit(refused.lower())))
    return F.filter(options, lambda o: o != refused)


def render_options(options: Column, refused: str = "Refused") -> Column:
    """Options that aren't refusals, lettered from A, one per line; at most 26."""
    kept = F.slice(without_refused(options, refused), 1, 26)
    return F.array_join(F.transform(kept, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o)), "\n")


def distinct_ratio(x: Column, n: int) -> Column:
    """Distinct n-grams over n-grams of lower-case words; 0 without any."""

    def grams(w: Column) -> Column:
        out = F.slice(w, 1, F.greatest(F.size(w) - (n - 1), F.lit(0)))
        for k in range(1, n):
            later = F.slice(w, k + 1, F.greatest(F.size(w) - (n - 1), F.lit(0)))
            out = F.zip_with(out, later, lambda a, b: F.concat(a, F.lit(" "), b))
        return out

    def share(g: Column) -> Column:
        return F.when(F.size(g) > 0, F.size(F.array_distinct(g)) / F.size(g)).otherwise(0.0)

    return bound(words(F.lower(x)), lambda w: bound(grams(w), share))


def max_word_share(x: Column) -> Column:
    """Share of the most frequent lower-case word; 0 without words. Sorted words are run-length counted in one fold."""
    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("c"), F.lit(0).alias("m"))

    def step(a, v):
        c = F.when(a["w"] == v, a["c"] + 1).otherwise(1)
        return F.struct(v.alias("w"), c.alias("c"), F.greatest(a["m"], c).alias("m"))

    def share(w: Column) -> Column:
        return F.when(F.size(w) > 0, F.aggregate(w, start, step)["m"] / F.size(w)).otherwise(0.0)

    return bound(F.sort_array(words(F.lower(x))), share)


def contains_any(x: Column, phrases: tuple[str, ...]) -> Column:
    """Whether the lower-cased text (curly apostrophes straightened) holds any phrase."""
    return phrase_hits(x, phrases) > 0


def phrase_hits(x: Column, phrases: tuple[str, ...]) -> Column:
    """Number of phrases that the lower-cased text holds."""
    low = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "’", "'")
    hits = F.lit(0)
    for p in phrases:
        hits = hits + low.contains(p).cast("int")
    return hits


def opens_with_refusal(x: Column) -> Column:
    """Whether the stripped, lower-cased text begins with a refusal."""
    low = F.regexp_replace(F.lower(strip(F.coalesce(x, F.lit("")))), "’", "'")
    hit = F.lit(False)
    for p in REFUSAL_OPENERS:
        hit = hit | low.startswith(p)
    return hit


def quality_score(x: Column) -> Column:
    """Mean of five checks: filled; 20 to 220 words; two sentence ends; no refusal opener; a word over 7 letters."""
    w = words(x)
    ends = F.regexp_count(F.coalesce(x, F.lit("")), F.lit(r"[.?!]"))
    checks = [F.size(w) > 0, F.size(w).between(20, 220), ends >= 2, ~opens_with_refusal(x), F.exists(w, lambda v: F.length(v) > 7)]
    total = F.lit(0)
    for c in checks:
        total = total + c.cast("int")
    return total / 5


def vagueness_score(x: Column) -> Column:
    """0.2 per vague phrase and 0.3 for a text under 30 words, at most 1."""
    score = phrase_hits(x, VAGUE_PHRASES) * 0.2 + F.when(word_count(x) < 30, 0.3).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def first_boilerplate(x: Column, patterns: tuple[str, ...] = BOILERPLATE_PATTERNS) -> Column:
    """The first pattern that matches, ignoring case; null if none does."""
    return F.coalesce(*[F.when(x.rlike(f"(?i){p}"), F.lit(p)) for p in patterns])


def verdict(x: Column, criteria: tuple[str, ...] = ("neutrality", "coherence", "relevance")) -> Column:
    """The winners in the outermost braces, null if they aren't valid JSON or not all of A, B or tie."""
    schema = ", ".join(f"{c} string" for c in criteria)
    got = F.from_json(F.regexp_extract(x, r"(?s)\{.*\}", 0), schema)
    ok = F.lit(True)
    for c in criteria:
        ok = ok & F.coalesce(got[c].isin("A", "B", "tie"), F.lit(False))
    return F.when(ok, got)


def strict_verdict(x: Column, criteria: tuple[str, ...] = ("neutrality", "coherence", "relevance")) -> Column:
    """As ``verdict``, but what isn't a verdict raises with its first 80 characters; null stays null."""
    got = verdict(x, criteria)
    shape = "struct<" + ", ".join(f"{c}: string" for c in criteria) + ">"
    wrong = F.raise_error(F.concat(F.lit("not a verdict: "), F.substring(x, 1, 80))).cast(shape)
    return F.when(x.isNull() | got.isNotNull(), got).otherwise(wrong)


def is_ordinal(question: Column, options: Column, keywords: tuple[str, ...] = ORDINAL_KEYWORDS, refused: str = "refused") -> Column:
    """Two to six options that don't mention refusal, and any keyword in the question or any option."""
    kept = without_refused(options, refused, within=True)
    text = F.lower(F.concat_ws(" ", question, F.array_join(options, " ")))
    any_key = F.lit(False)
    for k in keywords:
        any_key = any_key | text.contains(k)
    return F.size(kept).between(2, 6) & any_key


def half_even(x: Column, digits: int) -> Column:
    """Rounding to even, as Python does."""
    return F.bround(x, digits)
