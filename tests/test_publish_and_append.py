"""Publishing behind a gate, and exactly-once appends, with failures between their steps."""

import os

import pytest
from pyspark.sql import functions as F

from textaxis.operators.reports import GateError
from textaxis.sources import publish as P
from textaxis.streaming import ingest


def not_empty(tables):
    out = None
    for name, t in tables.items():
        row = t.agg(F.count("*").cast("double").alias("value")).select(F.lit(f"NON_EMPTY:{name}").alias("check_name"), "value", F.lit(1.0).alias("bound"), (F.col("value") >= 1).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


def rows_of(spark, at, name="a"):
    return sorted(r.id for r in P.read_published(spark, at, name).collect())


def test_a_failed_gate_leaves_the_old_version(spark, tmp_path):
    at = str(tmp_path / "out")
    with pytest.raises(P.NothingPublishedError):
        P.read_published(spark, at, "a")
    report = P.publish(spark, at, {"a": spark.range(3), "b": spark.range(6).withColumn("q", F.col("id") % 2)}, not_empty, by={"b": ["q"]})
    assert report.count() == 2 and rows_of(spark, at) == [0, 1, 2] and P.read_published(spark, at, "b").where("q = 1").count() == 3
    planned = P.read_published(spark, at, "a")
    with pytest.raises(GateError, match="NON_EMPTY:a"):
        P.publish(spark, at, {"a": spark.range(0)}, not_empty)
    assert rows_of(spark, at) == [0, 1, 2] and len(os.listdir(f"{at}/_versions")) == 1 and len(os.listdir(f"{at}/_reports")) == 2
    P.publish(spark, at, {"a": spark.range(9)}, not_empty, dry_run=True)
    assert rows_of(spark, at) == [0, 1, 2]
    P.publish(spark, at, {"a": spark.range(1)}, not_empty)
    assert rows_of(spark, at) == [0] and planned.count() == 3
    with pytest.raises(P.NothingPublishedError):
        P.read_published(spark, at, "b")


@pytest.mark.parametrize("step", ["_switch", "gate"])
def test_a_crash_before_the_switch_leaves_the_old_version(spark, tmp_path, monkeypatch, step):
    at = str(tmp_path / "out")
    P.publish(spark, at, {"a": spark.range(3)}, not_empty)

    def crash(*_):
        raise RuntimeError("gone")

    monkeypatch.setattr(P, step, crash)
    with pytest.raises(RuntimeError):
        P.publish(spark, at, {"a": spark.range(5)}, not_empty)
    monkeypatch.undo()
    assert rows_of(spark, at) == [0, 1, 2]
    left = P.vacuum(spark, at, 0)
    assert len(left) == (step == "_switch") and rows_of(spark, at) == [0, 1, 2] and P.vacuum(spark, at, 0) == []
    P.publish(spark, at, {"a": spark.range(5)}, not_empty)
    assert P.vacuum(spark, at) == [] and rows_of(spark, at) == [0, 1, 2, 3, 4]


def test_json_lines_sink(spark, tmp_path):
    P.write_jsonl(spark.createDataFrame([(1, None), (2, "é")], "k int, v string"), str(tmp_path / "o"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "o")).collect()) == ['{"k":1,"v":null}', '{"k":2,"v":"é"}']
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        P.write_jsonl(spark.range(1), str(tmp_path / "o"))


def keys_of(spark, target):
    return sorted((r.k if r.k is not None else -1, r.v) for r in ingest.read_appended(spark, target).collect())


def test_a_batch_touches_its_own_parts_only(spark, tmp_path):
    out, shape = str(tmp_path / "out"), "k long, v string"
    first = spark.createDataFrame([(i, "a") for i in range(50)] + [(None, "a")], shape)
    assert ingest.append_batch(first, out, ["k"], "b0", parts=1024)
    before = {p: os.stat(f"{out}/_ledger/{p}").st_mtime_ns for p in os.listdir(f"{out}/_ledger") if p.startswith("part=")}
    second = spark.createDataFrame([(3, "b"), (50, "b"), (50, "b"), (None, "b")], shape)
    own = {f"part={r.p}" for r in second.select(ingest.ledger_part(["k"], 1024).alias("p")).distinct().collect()}
    assert ingest.append_batch(second, out, ["k"], "b1", parts=1024)
    assert keys_of(spark, out) == sorted([(i, "a") for i in range(50)] + [(-1, "a"), (50, "b")])
    changed = {p for p, t in before.items() if os.stat(f"{out}/_ledger/{p}").st_mtime_ns != t} | {p for p in os.listdir(f"{out}/_ledger") if p.startswith("part=") and p not in before}
    assert changed <= own
    assert not ingest.append_batch(second, out, ["k"], "b1", parts=1024)  # it is there


def test_a_half_written_batch_is_no_batch(spark, tmp_path, monkeypatch):
    """It fails after rows and ledger are written: readers don't see it, and another batch may bring its keys."""
    out, shape = str(tmp_path / "out"), "k long, v string"
    ingest.append_batch(spark.createDataFrame([(1, "a")], shape), out, ["k"], "b0")
    real = ingest._path

    class Broken:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def rename(self, *_):
            return False

    monkeypatch.setattr(ingest, "_path", lambda s, p: (lambda at, fs: (at, Broken(fs)))(*real(s, p)))
    with pytest.raises(OSError, match="in place"):
        ingest.append_batch(spark.createDataFrame([(2, "b"), (3, "b")], shape), out, ["k"], "b1")
    monkeypatch.undo()
    assert keys_of(spark, out) == [(1, "a")]
    assert ingest.append_batch(spark.createDataFrame([(3, "c")], shape), out, ["k"], "b2")
    assert ingest.append_batch(spark.createDataFrame([(2, "b"), (3, "b")], shape), out, ["k"], "b1")  # run again
    assert keys_of(spark, out) == [(1, "a"), (2, "b"), (3, "c")]
    assert ingest.append_batch(spark.createDataFrame([(2, "d"), (4, "d")], shape), out, ["k"], "b3")
    assert keys_of(spark, out) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
