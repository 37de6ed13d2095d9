"""Streams of appended records: a landing folder read as a stream, and exactly-once appends by a ledger of keys."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

#: Parts of a ledger by the hash of its keys.
LEDGER_PARTS = 256


def landing(spark: SparkSession, folder: str, schema: StructType | str, kind: str = "json", files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder as a stream of rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(folder)


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str) -> list[str]:
    at, fs = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def ledger_part(keys: list[str], parts: int = LEDGER_PARTS) -> Column:
    """The part of the ledger that a key is in."""
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def append_batch(rows: DataFrame, target: str, keys: list[str], name: str, partition_by: list[str] | None = None, parts: int = LEDGER_PARTS) -> bool:
    """Append those of ``rows`` whose keys the target doesn't hold yet, as the batch ``name``; False if it is there already.

    Two phases. First the rows are written under ``_staging/<name>`` and their keys under ``_ledger``; both are written anew if
    a failed batch is run again. Then one rename puts the rows in place as ``batch=<name>``: only with it the batch counts.
    A batch left in ``_staging`` is half-written: readers don't see it, and its keys in the ledger don't count. Of the
    ledger only the parts that the batch's own keys hash to are read and added to. Of repeated keys in a batch one row
    is kept; null keys equal one another.
    """
    spark = rows.sparkSession
    done, fs = _path(spark, f"{target}/batch={name}")
    if fs.exists(done):
        return False
    stage = f"{target}/_staging/{name}"
    fresh = rows.dropDuplicates(keys).withColumn("__part", ledger_part(keys, parts))
    known = _children(spark, f"{target}/_ledger")
    own = {r["__part"] for r in rows.select(ledger_part(keys, parts).alias("__part")).distinct().collect()}  # at most ``parts`` numbers
    if known := [f"{target}/_ledger/part={p}" for p in sorted(own) if f"part={p}" in known]:
        open_ = [b for b in _children(spark, f"{target}/_staging")]
        shape = StructType([*rows.select(*keys).schema.fields, *StructType.fromDDL("batch string, part int, of string").fields])
        held = spark.read.schema(shape).option("basePath", f"{target}/_ledger").parquet(*known)
        held = held.where(~F.col("of").isin(open_)) if open_ else held
        held = held.select(*[F.col(k).alias(f"__l{i}") for i, k in enumerate(keys)])
        on = F.lit(True)
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"__l{i}"))
        fresh = fresh.join(held, on, "left_anti")
    out = fresh.drop("__part").write.mode("overwrite")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(stage)
    written = spark.read.schema(rows.schema).parquet(stage).select(*keys).withColumn("part", ledger_part(keys, parts)).withColumn("batch", F.lit(name))
    for p in sorted(own):  # what an earlier attempt of this batch left
        at, _ = _path(spark, f"{target}/_ledger/part={p}/of={name}")
        fs.delete(at, True)
    written.withColumn("of", F.col("batch")).repartition("part").write.mode("append").partitionBy("part", "of").parquet(f"{target}/_ledger")
    at, _ = _path(spark, stage)
    if not fs.rename(at, done):
        raise OSError(f"{stage} can't be put in place")
    return True


def append_once(stream: DataFrame, target: str, keys: list[str], checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, partition_by: list[str] | None = None,
                parts: int = LEDGER_PARTS) -> StreamingQuery:
    """Append each key once, over restarts and also from other streams that ran before: see ``append_batch``.

    A micro-batch is named by its query's id, which its checkpoint keeps, and its number, so one that is run again
    after a failure either replaces what it had staged or, if it was put in place, adds nothing. One stream at a time may append.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        query = json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]
        batch.persist()
        try:
            append_batch(transform(batch) if transform else batch, target, keys, f"{query}-{number}", partition_by, parts)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_appended(spark: SparkSession, target: str) -> DataFrame:
    """All rows of whole batches, with the name of their ``batch``."""
    return spark.read.parquet(target)


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts by event-time window and key; rows later than ``late`` are left out and closed windows drop their state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
