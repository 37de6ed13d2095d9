"""Speakers linked to member records, and one pooled record for each person.

Linking is blocked by (congress, chamber, state) and last name. It never lists a speaker's candidates: members are
counted by block and last name, and by block, last name and first initial, and a speaker looks both counts up, so a
common name costs one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textaxis.functions.text import strip, word_count_in_batches
from textaxis.operators.ranking import ordered
from textaxis.session import materialize

UNIT = ["congress", "speaker_id"]
BLOCK = ["congress", "chamber", "state"]
#: Chambers in speaker tables and in member tables.
CHAMBERS = {"H": "House", "S": "Senate"}


def member_names(bioname: Column) -> tuple[Column, Column]:
    """(last, first) of "LAST, First ...", in upper case; all of it is the last name where no comma stands."""
    parts = F.split(bioname, ", ", 2)
    return F.upper(strip(parts[0])), F.upper(strip(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))))


def speaker_speeches(speeches: DataFrame, order: str, text: str = "text", least_words: int = 0, most_words: int = 1 << 62) -> DataFrame:
    """Speeches of at least ``least_words`` that a unit (congress, speaker_id) holds: along ``order`` while those before have fewer than
    ``most_words``. Adds ``n_words`` and ``words_before``; null texts have no words. ``order`` tells a
    unit's speeches apart: only counts are put in order, and kept speeches fetch their texts by it. No task holds a unit's speeches."""
    counted = materialize(speeches.select(*UNIT, order, word_count_in_batches(F.col(text)).alias("n_words")), "counted")  # without texts, whose words are counted once
    placed = ordered(counted.where(F.col("n_words") >= least_words), UNIT, [order], "words_before", "n_words").where(F.col("words_before") < most_words)
    keys = [*UNIT, order]
    kept = materialize(placed.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], "n_words", "words_before"), "kept")
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)])
    return materialize(speeches.join(kept, on).drop(*[f"__k{i}" for i in range(len(keys))]), "speeches")


def match_speakers(units: DataFrame, members: DataFrame) -> DataFrame:
    """``units`` (congress, speaker_id, last_name, first_name, chamber, state; more columns may follow) with ``icpsr`` and ``matched_by``.

    ``members`` has (congress, chamber, state_abbrev, bioname, icpsr, nominate_dim1). A unit's member is the only one of its block with its
    last name (``name``), else the only one of these with its first initial (``initial``); where neither is one, both columns
    are null and ``candidates`` tells how many bear the name. Members without a score don't count, repeated rows count as often as
    they occur. Units of other chambers match nothing.
    """
    last, first = member_names(F.col("bioname"))
    able = members.where(F.col("nominate_dim1").isNotNull()).select(
        F.col("congress").alias("__c"), F.col("chamber").alias("__h"), F.col("state_abbrev").alias("__s"), last.alias("__l"), F.substring(first, 1, 1).alias("__f"), F.col("icpsr").alias("__i"))
    block = ["__c", "__h", "__s", "__l"]
    by_name = able.groupBy(*block).agg(F.count("*").alias("candidates"), F.min("__i").alias("__one"))
    by_initial = able.groupBy(*block, "__f").agg(F.count("*").alias("__m"), F.min("__i").alias("__two"))
    chamber = F.lit(None).cast("string")
    for short, word in CHAMBERS.items():
        chamber = F.when(F.col("chamber") == short, word).otherwise(chamber)
    asked = units.withColumn("__chamber", chamber).withColumn("__initial", F.substring("first_name", 1, 1))
    same = lambda right: [F.col("congress") == right["__c"], F.col("__chamber") == right["__h"], F.col("state") == right["__s"], F.col("last_name") == right["__l"]]
    named = asked.join(by_name, same(by_name), "left").drop(*block)
    got = named.join(by_initial, [*same(by_initial), F.col("__initial") == by_initial["__f"]], "left").drop(*block, "__f")
    one, two = F.col("candidates") == 1, (F.col("candidates") > 1) & (F.col("__initial") != "") & (F.col("__m") == 1)
    return (got.withColumn("icpsr", F.when(one, F.col("__one")).when(two, F.col("__two"))).withColumn("matched_by", F.when(one, "name").when(two, "initial"))
            .withColumn("candidates", F.coalesce("candidates", F.lit(0)).cast("long")).drop("__one", "__two", "__m", "__chamber", "__initial"))


def pool_people(speeches: DataFrame, members: DataFrame, order: str, text: str = "text", least_words: int = 0, most_words: int = 1 << 62) -> tuple[DataFrame, DataFrame]:
    """(people, unmatched units) of ``speeches`` (congress, speaker_id, last_name, first_name, chamber, state, ``order``, text).

    A unit's name and place are those of its first speech kept by ``speaker_speeches``. People: ``icpsr, bioname, party_code, chambers, states,
    congresses, nominate_dim1, nominate_dim2, n_units, n_speeches, n_words, text``: scores are means over the person's units, of
    which a missing second one counts 0; chambers and states stand in order of first appearance; the text joins the speeches unit by
    unit, in order of the units' congresses and first speeches. Each unit gives at most ``most_words`` words and one speech, which
    bounds what is gathered of a person.
    """
    kept = speaker_speeches(speeches, order, text, least_words, most_words)
    described = ["last_name", "first_name", "chamber", "state"]
    units = kept.groupBy(*UNIT).agg(F.min_by(F.struct(*described), order).alias("d"), F.min(order).alias("__start")).select(*UNIT, "d.*", "__start")
    matched = match_speakers(units, members)
    last, _ = member_names(F.col("bioname"))
    rows = members.where(F.col("nominate_dim1").isNotNull()).withColumn("__l", last)
    # The member row of each unit: its block, name and person.
    chamber = F.when(F.col("chamber") == "H", CHAMBERS["H"]).otherwise(CHAMBERS["S"])
    found = matched.where("icpsr is not null").withColumn("__chamber", chamber)
    facts = rows.groupBy(F.col("congress").alias("__c"), F.col("chamber").alias("__h"), F.col("state_abbrev").alias("__s"), "__l", F.col("icpsr").alias("__i")).agg(
        *[F.min(c).alias(c) for c in ("bioname", "party_code", "nominate_dim1", "nominate_dim2")])
    placed = found.join(facts, [found["congress"] == facts["__c"], found["__chamber"] == facts["__h"], found["state"] == facts["__s"], found["last_name"] == facts["__l"], found["icpsr"] == facts["__i"]])
    placed = placed.withColumn("__at", F.struct("congress", "__start"))
    in_order = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("__at", c))), lambda x: x[c]))
    people = placed.groupBy("icpsr").agg(
        F.min_by("bioname", "__at").alias("bioname"), F.min_by("party_code", "__at").alias("party_code"), in_order("chamber").alias("chambers"), in_order("state").alias("states"),
        F.array_sort(F.collect_set("congress")).alias("congresses"), F.avg("nominate_dim1").alias("nominate_dim1"), F.avg(F.coalesce("nominate_dim2", F.lit(0.0))).alias("nominate_dim2"), F.count("*").alias("n_units"))
    pieces = kept.select(*UNIT, order, F.col(text).alias("__text"), "n_words").join(placed.select(*UNIT, "icpsr", "__at"), UNIT)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", order, "__text"))), lambda p: strip(p["__text"])), " ")
    texts = pieces.groupBy("icpsr").agg(F.count("*").alias("n_speeches"), F.sum("n_words").alias("n_words"), joined.alias("text"))
    return people.join(texts, "icpsr"), matched.where("icpsr is null").drop("__start")
