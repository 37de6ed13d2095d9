"""Readers and sinks of the reference's file kinds; all paths are read by Spark, so any store will do."""

from __future__ import annotations

import json
import warnings
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class RequiredKeyError(ValueError):
    """A strict reader met rows without a required key."""


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, sep: str = ",") -> DataFrame:
    """CSV with a header and quoted line ends."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep)
    return (r.schema(schema) if schema else r).csv(path)


def read_json_array(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Files that hold one JSON array (or object) each."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, required: list[str] | None = None) -> DataFrame:
    """One object per line; a malformed line fails the job, and so does a missing required key (checked at once)."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if required:
        bad = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required]).first()
        missing = {c: bad[c] for c in required if bad[c]}
        if missing:
            raise RequiredKeyError(f"{path}: rows without {missing}")
    return rows


def read_jsonl_lenient(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines). Blank lines are neither; a path that doesn't exist gives no rows."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], fields), spark.createDataFrame([], "line string")
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.col("value").alias("line"), F.from_json("value", StructType([*fields.fields, *StructType.fromDDL("_corrupt_record string").fields])).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    return parsed.where(~bad).select("r.*").drop("_corrupt_record"), parsed.where(bad).select("line")


def _heads(spark: SparkSession, path: str, most: int = 1 << 16) -> dict[str, str]:
    """The first ``most`` bytes of each file at ``path`` (a file, a folder or a pattern), read by the driver, many at a time."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    found = []
    for s in fs.globStatus(at) or []:
        found += [s] if s.isFile() else list(fs.listStatus(s.getPath()))
    names = [s.getPath().toString() for s in found if s.isFile() and s.getPath().getName()[0] not in "._"]

    def head(name: str) -> str:
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(name))
        try:
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, most))).decode("utf-8", "ignore")
        finally:
            stream.close()

    with ThreadPoolExecutor(32) as pool:
        return dict(zip(names, pool.map(head, names), strict=True))


def json_layout(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """(files of one JSON value a line, files of one value over many lines), told by each file's head.

    A file whose first line that isn't blank is a whole JSON value, or is longer than the head, is one of lines, and Spark
    splits it however large it is; only a value that is spread over lines has to be read by one task. Empty files are in neither list.
    """
    lines, whole = [], []
    for name, head in _heads(spark, path).items():
        first, _, rest = head.lstrip("\ufeff \t\r\n").partition("\n")
        if not first:
            continue
        try:
            json.loads(first)
            lines.append(name)
        except ValueError:
            (whole if rest else lines).append(name)
    return sorted(lines), sorted(whole)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """``(id, prompt_text, axis, source)`` of JSON lines, or of objects with a list of statements, prompts or questions.

    The text is the first of text, prompt_text, statement and question that is there. A file's layout is told by its
    head (``json_layout``); lines may also be such objects, blank and broken ones are left out.
    """
    fields = "id string, text string, prompt_text string, statement string, question string, key string, axis string, primary_axis string, source string"
    lists = ", ".join(f"{c} array<struct<{fields}>>" for c in ("statements", "prompts", "questions"))
    shape = f"{lists}, {fields}"
    lines, whole = json_layout(spark, path)
    parts = []
    if lines:
        parts.append(spark.read.text(lines).select(F.from_json("value", shape).alias("r")).where("r is not null").select("r.*"))
    if whole:
        parts.append(spark.read.schema(shape).option("multiLine", True).json(whole))
    rows = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], StructType.fromDDL(shape))
    own = F.struct(*[F.col(f.split()[0]) for f in fields.split(", ")])
    listed = F.coalesce("statements", "prompts", "questions", F.when(F.coalesce("id", "text", "prompt_text", "statement", "question", "key").isNotNull(), F.array(own)))
    items = rows.select(F.explode(listed).alias("i"))
    text = F.coalesce(*[F.nullif(F.trim(F.col(f"i.{c}")), F.lit("")) for c in ("text", "prompt_text", "statement", "question")])
    return items.select(F.coalesce("i.id", "i.key").alias("id"), text.alias("prompt_text"), F.coalesce("i.axis", "i.primary_axis").alias("axis"), F.col("i.source").alias("source"))


def read_piped(spark: SparkSession, path: str, names: list[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """Bar-separated lines with a header; only the first ``len(names) - 1`` bars separate, shorter lines are left out. The first
    line of each file is its header, whatever it says; other lines are rows, even if they begin like it."""
    # The text source reads UTF-8 only; one CSV column without quotes and with a separator no text holds reads any.
    lines = spark.read.schema("value string").option("encoding", encoding).option("sep", "\u0001").option("quote", "").option("header", True).csv(path)
    parts = F.split("value", r"\|", len(names))
    rows = lines.select(parts.alias("p")).where(F.size("p") == len(names))
    return rows.select(*[F.col("p")[i].alias(n) for i, n in enumerate(names)])


def plan_folders(spark: SparkSession, root: str, sources: list[str], quadrants: list[str], name: str = "retained.jsonl") -> tuple[list[str], list[str]]:
    """(files ``<root>/<source>/<quadrant>/<name>`` that are there, folders under ``root`` that no source is named for).

    Only ``root`` and the asked sources' folders are listed, so what isn't asked for costs nothing.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(conf)
    folders = {s.getPath().getName(): s.getPath() for s in fs.listStatus(at) if s.isDirectory()} if fs.exists(at) else {}
    files = []
    for source in sorted(set(sources) & set(folders)):
        there = {s.getPath().getName() for s in fs.listStatus(folders[source]) if s.isDirectory()}
        for q in sorted(set(quadrants) & there):
            file = jvm.org.apache.hadoop.fs.Path(jvm.org.apache.hadoop.fs.Path(folders[source], q), name)
            files += [file.toString()] if fs.exists(file) else []
    return files, sorted(set(folders) - set(sources))


def read_partitioned(spark: SparkSession, root: str, schema: StructType | str, sources: list[str], quadrants: list[str]) -> DataFrame:
    """``<root>/<source>/<quadrant>/retained.jsonl`` with both folder names as columns.

    Folders are planned before the read (``plan_folders``): others are neither listed nor read, missing files are skipped,
    folders of unknown sources are named in a warning.
    """
    files, unknown = plan_folders(spark, root, sources, quadrants)
    if unknown:
        warnings.warn(f"{root}: folders of unknown sources: {', '.join(unknown)}", stacklevel=2)
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not files:
        return spark.createDataFrame([], StructType([*fields.fields, *StructType.fromDDL("source string, quadrant string").fields]))
    place = F.col("_metadata.file_path")
    rows = spark.read.schema(fields).json(files)
    return rows.select("*", F.url_decode(F.regexp_extract(place, r"([^/]+)/[^/]+/[^/]+$", 1)).alias("source"), F.url_decode(F.regexp_extract(place, r"([^/]+)/[^/]+$", 1)).alias("quadrant"))


def vector_rows(rows: DataFrame, vec: str, width: int) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) rows by length and finiteness of their vectors."""
    from textaxis.functions.vectors import valid

    ok = valid(F.col(vec), width)
    return rows.where(ok), rows.where(~F.coalesce(ok, F.lit(False)))


def write_partitioned(rows: DataFrame, path: str, by: list[str], kind: str = "parquet") -> None:
    """One folder per value of ``by``, rebalanced: Spark splits a folder's rows over as many tasks as their size asks for and
    gathers small ones. It overwrites in place; ``publish`` keeps the old rows readable until the new ones are whole."""
    rows.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).format(kind).save(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of one row as one JSON object."""
    report.select(F.to_json(F.struct(*report.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)
