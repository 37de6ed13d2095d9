"""Publishing tables behind a gate: staged, checked, then switched to by one small file.

A version is written beside what readers see, its checks run on the staged files, and only then a manifest that names
it replaces the old one in one rename. Until that rename readers have the old version, whatever fails before it; after
it they have the new one. Files of versions that the manifest doesn't name are never read and go with ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textaxis.operators.reports import gate

MANIFEST = "_manifest.json"


class NothingPublishedError(FileNotFoundError):
    """A reader asked for a folder without a manifest, or a table that the manifest doesn't name."""


def _jvm_path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What is published at ``path``: version and tables; None if nothing is."""
    target, fs = _jvm_path(spark, f"{path}/{MANIFEST}")
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def _switch(spark: SparkSession, path: str, content: dict) -> None:
    """Replace the manifest in one rename."""
    jvm = spark.sparkContext._jvm
    fresh, fs = _jvm_path(spark, f"{path}/{MANIFEST}.{content['version']}")
    out = fs.create(fresh, True)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fresh, jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}"), overwrite)


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], checks: Callable[[dict[str, DataFrame]], DataFrame] | None = None,
            by: dict[str, list[str]] | None = None, kind: str = "parquet", dry_run: bool = False) -> DataFrame | None:
    """Write ``tables`` as one version and make it the published one if it passes; returns the report of ``checks``.

    ``checks`` gets the staged tables, read back, and returns rows (check_name, value, bound, passed), as ``reports.checks`` does; if one
    failed, ``GateError`` names it, the staged tables go and the report stays under ``_reports``. Tables in ``by`` have one
    folder for each value of their columns, rebalanced so that no folder hangs on one task. ``dry_run`` checks and switches nothing. Tables of
    an earlier version that aren't among ``tables`` aren't part of the new one.
    """
    version = uuid.uuid4().hex
    root, fs = _jvm_path(spark, f"{path}/_versions/{version}")
    staged = {}
    passed = False
    try:
        for name, table in tables.items():
            columns = (by or {}).get(name)
            out = table.hint("rebalance", *columns).write.partitionBy(*columns) if columns else table.write
            out.format(kind).save(f"{path}/_versions/{version}/{name}")
            staged[name] = spark.read.schema(table.schema).format(kind).load(f"{path}/_versions/{version}/{name}")
        report = None
        if checks is not None:
            checks(staged).coalesce(1).write.json(f"{path}/_reports/{version}")
            report = spark.read.schema("check_name string, value double, bound double, passed boolean").json(f"{path}/_reports/{version}")
            gate(report)
        passed = not dry_run
    finally:
        if not passed:
            fs.delete(root, True)
    if passed:
        _switch(spark, path, {"version": version, "kind": kind, "tables": {name: table.schema.jsonValue() for name, table in tables.items()}})
    return report


def read_published(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the published version; readers that planned before a switch keep the version they had."""
    from pyspark.sql.types import StructType

    found = manifest(spark, path)
    if found is None or name not in found["tables"]:
        raise NothingPublishedError(f"{path}: {name} isn't published")
    return spark.read.schema(StructType.fromJson(found["tables"][name])).format(found["kind"]).load(f"{path}/_versions/{found['version']}/{name}")


def vacuum(spark: SparkSession, path: str, older_than_s: float = 86_400) -> list[str]:
    """Delete versions that aren't published and were last written before ``older_than_s`` seconds; returns their names.

    The age spares versions that another job is staging now, and those that readers planned on lately.
    """
    root, fs = _jvm_path(spark, f"{path}/_versions")
    if not fs.exists(root):
        return []
    current = (manifest(spark, path) or {}).get("version")
    now = spark.sparkContext._jvm.System.currentTimeMillis()
    gone = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name != current and now - status.getModificationTime() >= older_than_s * 1000:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def write_jsonl(rows: DataFrame, path: str, per_file: int = 1_000_000) -> None:
    """Rows as JSON lines, nulls written, files of about equal size; the folder must not exist, as nothing is overwritten."""
    out = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    out.hint("rebalance").write.option("maxRecordsPerFile", per_file).text(path)
