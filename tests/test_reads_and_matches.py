"""Planned reads, layouts of JSON files, and question matching with long lists."""

import json

import pytest

from textaxis.operators.corpus import match_questions
from textaxis.sources import files as S


def test_rows_that_begin_like_the_header_stay(spark, tmp_path):
    (tmp_path / "a.txt").write_text("speech_id|speech\nspeech_id|said so\n1|x|y\n")
    (tmp_path / "b.txt").write_text("speech_id|speech\n2|z\nshort\n")
    got = sorted(tuple(r) for r in S.read_piped(spark, str(tmp_path), ["speech_id", "speech"]).collect())
    assert got == [("1", "x|y"), ("2", "z"), ("speech_id", "said so")]


def test_layouts_are_told_by_heads(spark, tmp_path):
    one, many = {"prompts": [{"id": "p1", "text": "T"}, {"id": "p2", "question": "Q", "primary_axis": "social"}]}, [{"id": f"l{i}", "prompt_text": f"P{i}"} for i in range(50)]
    (tmp_path / "pretty.json").write_text(json.dumps(one, indent=2))
    (tmp_path / "line.json").write_text(json.dumps({"questions": [{"key": "k", "question": "K"}]}))
    (tmp_path / "lines.jsonl").write_text("\n\n" + "\n".join(map(json.dumps, many)) + "\n{broken\n")
    (tmp_path / "long.jsonl").write_text(json.dumps({"id": "long", "text": "w " * 60_000}) + "\n" + json.dumps({"id": "after", "text": "A"}))
    (tmp_path / "empty.json").write_text(" \n")
    (tmp_path / "_skipped.json").write_text("{}")
    lines, whole = S.json_layout(spark, str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in lines] == ["line.json", "lines.jsonl", "long.jsonl"] and [p.rsplit("/", 1)[1] for p in whole] == ["pretty.json"]
    got = {r["id"]: r for r in S.read_prompts(spark, str(tmp_path)).collect()}
    assert set(got) == {"p1", "p2", "k", "long", "after"} | {f"l{i}" for i in range(50)}
    assert got["p2"].prompt_text == "Q" and got["p2"].axis == "social" and got["k"].prompt_text == "K" and len(got["long"].prompt_text) == 119_999
    assert S.read_prompts(spark, str(tmp_path / "empty.json")).count() == 0


def test_lines_split_over_tasks(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text("\n".join(json.dumps({"id": str(i), "text": "x" * 200}) for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512k")
    try:
        df = S.read_prompts(spark, str(tmp_path / "big.jsonl"))
        assert df.rdd.getNumPartitions() > 4 and df.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_only_asked_folders_are_read(spark, tmp_path):
    for s, q, text in (("s1", "left_lib", '{"k": 1}'), ("s1", "odd", '{"k": 2}'), ("s 2", "left_lib", '{"k": 3}'), ("other", "left_lib", "{broken"), ("s3", "left_lib", None)):
        (tmp_path / s / q).mkdir(parents=True)
        if text:
            (tmp_path / s / q / "retained.jsonl").write_text(text + "\n")
    with pytest.warns(UserWarning, match="unknown sources: other"):
        df = S.read_partitioned(spark, str(tmp_path), "k int", ["s1", "s 2", "s3", "s4"], ["left_lib"])
    assert sorted(tuple(r) for r in df.collect()) == [(1, "s1", "left_lib"), (3, "s 2", "left_lib")]
    assert len(df.inputFiles()) == 2
    files, unknown = S.plan_folders(spark, str(tmp_path), ["s1"], ["odd", "left_lib"])
    assert len(files) == 2 and unknown == ["other", "s 2", "s3"]
    with pytest.warns(UserWarning):
        none = S.read_partitioned(spark, str(tmp_path), "k int", ["s3"], ["left_lib"])
    assert none.count() == 0 and none.columns == ["k", "source", "quadrant"]
    assert S.plan_folders(spark, str(tmp_path / "gone"), ["s1"], ["odd"]) == ([], [])


def test_long_question_lists_give_the_same_matches(spark):
    asked = [(f"k{i}", f"question number {i} about the thing that nobody asked of anyone in town {i % 7}", i) for i in range(40)] + [("dup", "question number 3 about the thing that nobody asked of anyone in town 3", 99), ("tiny", "why?", 50), ("none", None, 51)]
    rows = [(i, t) for i, t in enumerate([
        asked[5][1], "  " + asked[3][1] + " ", asked[8][1][:60], "well: " + asked[9][1] + " and more", "so, why? indeed", "number 12 about the thing", "nothing alike", "", None, "why?", "w", "town 4"])]
    r, q = spark.createDataFrame(rows, "id long, t string"), spark.createDataFrame(asked, "k string, q string, o int")
    few, many = (sorted((x.id, x.k) for x in match_questions(r, q, "id", "t", "k", "q", "o", short_list=n).collect()) for n in (10_000, 12))
    assert few == many and dict(few)[1] == "dup" and dict(few)[4] == "tiny" and dict(few)[6] is None


def test_matching_reads_each_text_once(spark):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé ñ") for _ in range(rng.randint(1, 7)))
    phrase = lambda n: " ".join(word() for _ in range(n))
    asked = [(f"k{i}", phrase(rng.choice([1, 2, 5, 30])), i) for i in range(60)] + [("same", None, 60), ("tiny", "bbbbé", 61), ("unplaced", "zzzz", None)]
    texts = [phrase(rng.choice([1, 3, 20, 200])) for _ in range(150)] + [None, "", "zzzz", "x" * 3000, "bbbbé", " "]
    texts += [f"{phrase(9)}{asked[i][1]}{phrase(9)}" for i in range(0, 60, 3)] + [asked[i][1][:70] for i in range(1, 60, 3)]
    texts += [asked[i][1][3:50] for i in range(60) if len(asked[i][1]) > 60]

    def plain(t):
        if t is None:
            return None
        t = t.strip()
        held = [(o, k, q) for k, q, o in asked if q is not None]
        begins = {q[:80]: k for o, k, q in sorted(held, key=lambda x: -1 if x[0] is None else x[0])}
        if t[:80] in begins and begins[t[:80]] != "unplaced":
            return begins[t[:80]]
        return next((k for o, k, q in sorted(x for x in held if x[0] is not None) if t[:60] in q or q[:60] in t), None)

    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    questions = spark.createDataFrame(asked, "k string, q string, o int")
    out = match_questions(rows, questions, "id", "t", "k", "q", "o")
    assert {r.id: r.k for r in out.collect()} == {i: plain(t) for i, t in enumerate(texts)} and out.count() == len(texts)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert match_questions(rows, questions.where("o < 0"), "id", "t", "k", "q", "o").where("k is null").count() == len(texts)
