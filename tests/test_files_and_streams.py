"""Readers, sinks and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from textaxis.operators.graph import connected_components
from textaxis.operators.ranking import keyed_offsets
from textaxis.sources import files as S
from textaxis.sources import normalize as N
from textaxis.streaming import ingest


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": 1, "t": "x"}\n\n{"id": 2}\n{broken\n')
    rows, bad = S.read_jsonl_lenient(spark, str(p), "id int, t string")
    assert [r["id"] for r in rows.orderBy("id").collect()] == [1, 2] and [r["line"] for r in bad.collect()] == ["{broken"]
    assert S.read_jsonl_lenient(spark, str(tmp_path / "none"), "id int")[0].count() == 0
    p.write_text('{"id": 1, "t": "x"}\n{"id": 2}\n')
    assert S.read_jsonl(spark, str(p), "id int, t string", ["id"]).count() == 2
    with pytest.raises(S.RequiredKeyError, match="'t': 1"):
        S.read_jsonl(spark, str(p), "id int, t string", ["t"])


def test_prompts_of_both_shapes(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"meta": 1, "statements": [{"id": "a", "text": "T", "axis": "social"}, {"id": "b", "statement": "S"}]}, indent=1))
    (tmp_path / "two.jsonl").write_text('{"id": "c", "prompt_text": "P", "source": "s"}\n{"id": "d", "text": " ", "question": "Q"}\n')
    got = {r["id"]: r["prompt_text"] for r in S.read_prompts(spark, str(tmp_path)).collect()}
    assert got == {"a": "T", "b": "S", "c": "P", "d": "Q"}


def test_other_kinds(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,tags\n"two\nlines, ""quoted""","[\'x\', \'y\']"\n')
    assert S.read_csv(spark, str(tmp_path / "a.csv")).first()["text"] == 'two\nlines, "quoted"'
    (tmp_path / "b.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert S.read_json_array(spark, str(tmp_path / "b.json")).count() == 2
    (tmp_path / "c.txt").write_bytes("speech_id|speech\n1|caf\xe9 | bar\nshort\n".encode("latin-1"))
    assert [tuple(r) for r in S.read_piped(spark, str(tmp_path / "c.txt"), ["speech_id", "speech"]).collect()] == [("1", "café | bar")]
    for s, q in (("s1", "left_lib"), ("s1", "odd"), ("s2", "left_lib")):
        (tmp_path / "pool" / s / q).mkdir(parents=True)
        (tmp_path / "pool" / s / q / "retained.jsonl").write_text('{"k": 1}\n')
    got = S.read_partitioned(spark, str(tmp_path / "pool"), "k int", ["s1", "s2"], ["left_lib"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "s1", "left_lib"), (1, "s2", "left_lib")]


def test_sinks(spark, tmp_path):
    df = spark.range(20).select("id", (F.col("id") % 3).alias("q"))
    S.write_partitioned(df, str(tmp_path / "out"), ["q"])
    assert spark.read.parquet(str(tmp_path / "out")).where("q = 1").count() == 7
    S.write_report(df.groupBy(F.lit("all").alias("g")).agg(F.count("*").alias("n")), str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first()[0]) == {"g": "all", "n": 20}
    good, bad = S.vector_rows(spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([float("nan")] * 2,), (None,)], "v array<double>"), "v", 2)
    assert (good.count(), bad.count()) == (1, 3)


def test_congress_reasons(spark):
    speeches = spark.createDataFrame([("1", "w " * 150), ("2", "w " * 5), ("3", "w " * 900), ("4", "point of order " * 60), ("5", "w " * 150)], "speech_id string, speech string")
    speakers = spark.createDataFrame([("1", "OLD", 0), ("1", "NEW", 1), ("2", "A", 2), ("3", "A", 3), ("4", "A", 4)], "speech_id string, lastname string, row int")
    kept, reasons = N.normalize_congress(speeches, speakers)
    assert [(r["speech_id"], r["lastname"]) for r in kept.collect()] == [("1", "NEW")]
    assert {r["reason"]: r["n"] for r in reasons.collect()} == {"ok": 1, "short": 1, "long": 1, "procedural": 1, "no_speaker": 1}


def test_append_once_over_restarts(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    shape = "k int, v string"
    for files in (["a"], ["b", "c"]):
        for f in files:
            spark.createDataFrame([(i, f) for i in range(3)] + [(ord(f), f)], shape).coalesce(1).write.mode("append").json(src)
        ingest.append_once(ingest.landing(spark, src, shape), out, ["k"], ck).awaitTermination()
    got = spark.read.parquet(out)
    assert sorted(r["k"] for r in got.collect()) == [0, 1, 2, 97, 98, 99]
    again = ingest.append_once(ingest.landing(spark, src, shape), out, ["k"], str(tmp_path / "ck2"))
    again.awaitTermination()
    assert spark.read.parquet(out).count() == 6


def test_late_rows_leave_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    shape = "ts timestamp, k string"
    times = ["2020-01-01 00:01:00", "2020-01-01 00:02:00", "2020-01-01 02:00:00", "2020-01-01 00:03:00", "2020-01-01 03:00:00"]
    for t in times:
        spark.createDataFrame([(t, "a")], "ts string, k string").selectExpr("cast(ts as timestamp) ts", "k").coalesce(1).write.mode("append").json(src)
    q = ingest.windowed_counts(ingest.landing(spark, src, shape, files_per_batch=1), "ts", "k").writeStream.outputMode("append").format("memory").queryName("late").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    got = spark.sql("select window.start as s, n from late order by s").collect()
    assert got and got[0]["n"] in (2, 3)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (7, 7), (None, 3)] + [(200, 200 + i) for i in range(1, 200)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in (100, 101, 102)} | {i: 200 for i in range(200, 400)}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_offsets_are_gapless(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 0 else i % 3, i % 5) for i in range(500)], "k int, g int, w int")
    got = keyed_offsets(df, ["g"], ["k"], salts=16).collect()
    for g in (None, 0, 1, 2):
        slots = sorted(r["slot"] for r in got if r["g"] == g)
        assert slots == list(range(len(slots))) and slots
    spans = sorted((r["g"] or -1, r["at"], r["w"]) for r in keyed_offsets(df, ["g"], ["k"], "w", "at", 16).where("g is not null and w > 0").collect())
    for (g, a, w), (h, b, _) in zip(spans, spans[1:], strict=False):
        assert g != h or a + w == b
