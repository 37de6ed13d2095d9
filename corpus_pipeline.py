"""The training-data pipeline: quality rules, near duplicates, substring repeats, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; every stage but the last returns
the columns of ``documents``. ``run`` writes each stage's rows as Parquet in the shared folder and reads them again
for the next one; a stage's inner tables and its input go as soon as its rows are written. Rows with a null or empty
text go at the first stage. Repeated rows: those of one doc_id and text stay or go together, as they are one document
to every stage. Rows without doc_id pass the next three stages as they are. Of equal documents the smallest doc_id
stays. Texts of any length are taken whole; columns that no stage reads are handed on, whatever their names; an empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textaxis.llm import decontam, jaccard, packing, rlz, rules
from textaxis.llm.queries import vocabulary
from textaxis.session import materialize, release, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return rules.filter_quality(docs, "v1")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id."""
    return jaccard.keep_one(docs, 5, 75)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out; all rows stay."""
    return rlz.rewrite(docs, 50)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, edited or not, go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, in sequences of 1024 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), 1024)


STAGES = [
    ("quality_rules", quality_rules), ("ngram_jaccard_join", ngram_jaccard_join), ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination), ("mixture_packing", mixture_packing),
]
#: Tokens and alignments are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    with scratch(spark) as keep_all:
        docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
        for name, stage in STAGES[:-1]:
            with scratch(spark) as keep:
                docs = keep(materialize(stage(spark, docs, sf_dir), name))
            if before is not None:
                release(before)
            before = docs
        packed = keep_all(materialize(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0]))
    return packed
