"""The pipeline against a plain version of its stages, and the entry without this subpackage."""

import subprocess
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_small_operators import plain_measure
from tests.llm.test_text_joins import WORD, components, plain_align
from textaxis.llm import queries
from textaxis.llm.queries import vocabulary

ROOT = Path(__file__).resolve().parents[2]


def folder(spark, tmp_path, texts, items):
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def sample():
    rng = np.random.default_rng(11)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrstuvwxyz"]
    text = lambda n: [str(x) for x in rng.choice(words, n)]
    passage, items = text(70), [text(30) for _ in range(5)]
    out = [text(int(rng.integers(10, 200))) for _ in range(60)]
    out += [list(out[i]) for i in range(5)]  # copies
    for i in range(5, 10):  # near copies
        w = list(out[i])
        w[len(w) // 2] = "edited"
        out.append(w)
    out += [text(60) + passage + text(40) for _ in range(4)]
    out += [text(80) + items[i] + text(20) for i in range(3)]
    out += [["###", "x"] * 60, ["one", "two", "three"] * 40]
    return [" ".join(w) for w in out] + [None, ""], [" ".join(x) for x in items]


def plain_pipeline(texts, items):
    docs = dict(enumerate(texts))
    for i, t in list(docs.items()):
        n, chars, symbols, _, repeat = plain_measure(t)
        upper = sum("A" <= c <= "Z" for c in t or "")
        if n < 50 or 100 * repeat > 50 * n or 100 * symbols > 40 * n or 100 * upper > 50 * chars:
            del docs[i]
    comp = components(list(docs.values()), list(docs))
    docs = {i: t for i, t in docs.items() if comp[i][1] == i}
    first = {}
    words = {i: WORD.findall(t) for i, t in docs.items()}
    for i in sorted(words):
        for s in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][s:s + 50]), i)
    for i, w in words.items():
        gone = {p for s in range(len(w) - 49) if first[tuple(w[s:s + 50])] < i for p in range(s, s + 50)}
        if gone:
            docs[i] = " ".join(x for p, x in enumerate(w) if p not in gone)
    return {i: t for i, t in docs.items() if not any(2 * plain_align(x.split(), t.split()) >= 2 * len(x.split()) for x in items)}


def test_run_equals_the_plain_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    texts, items = sample()
    want = plain_pipeline(texts, items)
    assert 40 < len(want) < 70
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, folder(spark, tmp_path, texts, items)).collect():
        got[r["doc_id"]].append(r)
    assert set(got) == set(want)
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for i, t in want.items():
        ids, at = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(got[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_stages_keep_the_columns(spark, tmp_path):
    texts, items = sample()
    sf_dir = folder(spark, tmp_path, texts, items)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).dtypes == docs.dtypes
        assert stage(spark, docs.where("false"), sf_dir).count() == 0


@pytest.mark.parametrize("name", ["op2_rule_ledger", "op5_relative_lz", "op8_set_relation_join", "op10_revisit_resolution"])
def test_sql_gives_the_same_rows(spark, name):
    from tests.parity import connect, differences

    sf = "/root/testdata/sf0.001"
    assert differences(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name]) == []


def test_entry_without_the_subpackage(tmp_path):
    for name in ("textaxis", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "textaxis/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
