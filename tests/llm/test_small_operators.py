"""Rules, token counts, licenses, revisits, sharding and packing against plain versions."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textaxis.llm import decontam, jaccard, licenses, lm, packing, rlz, rules, sharding, tokens, warc, words
from textaxis.llm.queries import vocabulary

DOCS = "doc_id long, text string, source string, n long, start string, rid int, shard string"


def table(spark, texts, sources=None):
    rows = [(i, t, (sources or ["s0", "s1", None])[i % len(sources or [0, 1, 2])], 7, "x", 3, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n\t", "a", "one two three one two three", "<s> \x00 é\xa0ü 😀  中文\r\n\r\nx", "word " * 3000, "Aa#*$ %&|<>\nAa#*$ %&|<>\n", "dup line\ndup line\ndup line\ndup line", "<|endoftext|> end", "x" * 5000]


def plain_measure(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_rules_measure_and_policies(spark):
    rng = np.random.default_rng(0)
    texts = ODD + [" ".join(rng.choice(["a", "bb", "c#", "\n", "dd"], rng.integers(0, 200))) for _ in range(40)]
    got = {r["doc_id"]: r for r in rules.verdicts(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, want = got[i], plain_measure(t)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in rules.filter_quality(table(spark, texts)).collect()}
    assert kept == {i for i, r in got.items() if r["kept"]}
    assert rules.filter_quality(table(spark, texts)).columns == table(spark, texts).columns


def test_rules_ablation_counts_bits(spark):
    led = spark.createDataFrame([(1,), (3,), (2,), (0,), (4,), (5,)], "failed long")
    got = {r["rule"]: (r["failed"], r["failed_alone"], r["rejected_without"]) for r in rules.ablation(led, "v1").collect()}
    assert got == {"few_words": (3, 1, 4), "repeated_phrases": (2, 1, 4), "symbols": (2, 1, 4), "shouting": (0, 0, 5)}


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    rng = np.random.default_rng(1)
    texts = ODD + ["".join(rng.choice(list("abcde  \n<s>é中😀▁12"), 60)) for _ in range(200)]
    got = {r["doc_id"]: r for r in tokens.token_counts(table(spark, texts), vocabulary("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(texts):
        assert got[i]["n_tokens"] == len(library.encode(t or "")), repr(t)[:80]
        assert got[i]["n_bytes"] == len((t or "").encode())
        assert got[i]["over_limit"] == (got[i]["n_tokens"] > 4096)


def test_encoder_equals_the_library(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 100)
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = np.random.default_rng(2)
    texts = [t or "" for t in ODD] + ["".join(rng.choice(list("ab's  \n\t\r\xa0  1é中😀."), 80)) for _ in range(400)]
    encoder = packing.ByteEncoder(path)
    coded = [x for i in range(0, len(texts), 50) for x in encoder.encode(texts[i:i + 50])]
    for t, ids in zip(texts, coded, strict=True):
        assert np.frombuffer(ids, encoder.kind).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_plain_words_are_merged_as_arrays(monkeypatch):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), packing.ByteEncoder(path)
    rng = np.random.default_rng(3)
    letters = list("aaeeiioottnnsshhrrdlcumAETéñßöÀƒɏ")
    words = ["".join(rng.choice(letters, rng.integers(1, 16))) + "".join(rng.choice(list(".,:;!?"), rng.integers(0, 3))) for _ in range(3000)]
    words += ["aaaaaaa", "hahahahaha", "ssssssss,,,,", "é" * 30, "a" * 63, "a" * 64]
    for size in (1, 70_000):
        monkeypatch.setattr(packing, "PLAIN_CHUNKS", max(size, 100))
        got = encoder._coded([f" {w}".encode() for w in words] + [w.encode() for w in words])
        want = [library.encode(w, add_special_tokens=False).ids for w in [f" {w}" for w in words] + words]
        assert [np.frombuffer(x, encoder.kind).tolist() for x in got] == want
    # Only what isn't plain is left to the library.
    left = []
    by_library = encoder._by_library
    monkeypatch.setattr(encoder, "_by_library", lambda chunks: left.extend(chunks) or by_library(chunks))
    text = "Plain words, façades and more! it's 12 a\u00d7b x\n\ny"
    assert np.frombuffer(encoder.encode([text])[0], encoder.kind).tolist() == library.encode(text, add_special_tokens=False).ids
    assert left == [" it's", " 12", " a\u00d7b", "\n\ny"]


def test_symbols_and_lines_do_not_make_new_chunks(monkeypatch):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), packing.ByteEncoder(path)
    rng = np.random.default_rng(4)
    pieces = [*"ab's\n\t .,$&-(\"éß×ªж1²\x00<", "'ll", "don't", "''s", "--", "\n\n", "é.", "×.", "ж."]
    texts = ["".join(rng.choice(pieces, 40)) for _ in range(2000)] + ["\n", "\na", "a\n", "é", ".é", "é.", "'", "a'", ".'s", "'.s", "\n.", "\n'"]
    for t, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, encoder.kind).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    # A known word is not looked up in the library again for what stands beside it.
    encoder.encode(["\n", "fine words façade"])
    before = len(encoder.known)
    encoder.encode([" words", " façade", "words", "fine", ",", "$$$", "-", " ("])
    left = []
    monkeypatch.setattr(encoder, "_by_library", lambda chunks: left.extend(chunks) or [b""] * len(chunks))
    known = len(encoder.known)
    encoder.encode(["fine words, façade$$$\nwords-words (words"])
    assert known > before and len(encoder.known) == known and not left


def test_merges_that_cannot_go_at_once_are_left_to_the_library(tmp_path):
    import json

    held = json.loads(open(vocabulary("byte_bpe_50k.json"), encoding="utf-8").read())
    held["model"]["merges"] = held["model"]["merges"][::-1]
    (tmp_path / "turned.json").write_text(json.dumps(held))
    assert packing.ByteMerges.read(str(tmp_path / "turned.json")) is None
    assert packing.ByteMerges.read(vocabulary("byte_bpe_50k.json")) is not None


@pytest.mark.parametrize("shares", [None, {"s0": 0.5, "s1": 0.5}])
def test_packing_is_a_partition_of_all_ids(spark, shares):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    texts = ODD + [f"some words of text number {i} " * (i % 9) for i in range(300)]
    got = packing.pack(table(spark, texts), path, 64, shares).collect()
    library = Tokenizer.from_file(path)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids, at = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for k, rows in by_seq.items():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 64 or k == len(by_seq) - 1


def test_packing_keeps_the_mixture(spark):
    docs = spark.createDataFrame([(i, "word " * 40, f"s{i % 10 // 7}") for i in range(1500)], "doc_id long, text string, source string")
    got = packing.pack(docs, vocabulary("byte_bpe_50k.json"), 256).collect()
    first = Counter()
    for r in got:
        first[r["sequence_id"]] += r["length"] * (r["doc_id"] % 10 < 7)
    full = [v for k, v in first.items() if k < max(first)]
    assert all(abs(v - 256 * 0.7) <= 2 for v in full)


def test_packing_of_nothing(spark):
    assert packing.pack(table(spark, []), vocabulary("byte_bpe_50k.json")).count() == 0


def test_rounds_carry_deficits():
    share = np.array([0.5, 0.3, 0.2])
    got = packing.rounds(np.array([500, 300, 200]), share, [10] * 100)
    assert got.sum(axis=0).tolist() == [500, 300, 200] and set(got.sum(axis=1)) == {10}
    assert np.abs(np.cumsum(got, axis=0) - np.arange(1, 101)[:, None] * 10 * share).max() <= 1
    uneven = packing.rounds(np.array([7, 0, 93]), np.array([0.9, 0.0, 0.1]), [10] * 10)
    assert uneven.sum(axis=0).tolist() == [7, 0, 93]


@pytest.mark.parametrize("queues", [5, 1000])
def test_runs_of_a_quantum_hold_the_mixture(queues):
    rng = np.random.default_rng(queues)
    held = rng.integers(1, 4000, queues) + (np.arange(queues) == 0) * 200 * queues
    held[-1] += -held.sum() % 1024
    windows = int(held.sum()) // 1024
    share = held / held.sum()
    got = packing.rounds(held, share, [1024] * windows, quantum=64)
    assert set(got.sum(axis=1)) == {1024} and got.sum(axis=0).tolist() == held.tolist() and got.min() >= 0
    off = np.cumsum(got, axis=0) - np.arange(1, windows + 1)[:, None] * 1024 * share
    assert np.abs(off).max() <= 2 * 64
    # A run under a quantum is a window's last, or a queue's.
    assert (got > 0).sum() <= held.sum() / 64 + 2 * windows + queues


def test_many_sources_do_not_shred_texts(spark):
    docs = spark.createDataFrame([(i, "word " * (20 + i % 90), f"s{i % 300}") for i in range(1500)], "doc_id long, text string, source string")
    got = packing.pack(docs, vocabulary("byte_bpe_50k.json"), 1024).collect()
    tokens = sum(r["length"] for r in got)
    assert len(got) <= 1500 + tokens / 64 + 2 * -(-tokens // 1024) + 300


def test_license_phrases_and_templates(spark):
    mit = licenses.TEMPLATES["mit"].split()
    edited = mit[:20] + ["really"] + mit[20:30] + mit[31:]
    texts = ["Under the MIT License, or Apache-License. mit license", "x MIT\nLicense y", " ".join(mit).upper(), "start " * 9 + " ".join(edited), "mitlicense mit", "Licensed under CC BY-NC 4.0.", None, "", "GNU General Public License"]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(table(spark, texts)).collect()}
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["base_labels"]) == (3, 2, 7, "apache,mit")
    assert (got[1]["n_base"], got[1]["labels"], got[1]["score"]) == (1, "mit", 0.5)
    assert got[2]["labels"] == "mit" and got[2]["score"] == 1.0 and got[2]["n_base"] == 0
    assert got[3]["labels"] == "mit" and 0.8 < got[3]["score"] < 1
    assert got[4]["n_base"] == 0 and got[4]["first_word"] is None and got[4]["labels"] == ""
    assert got[5]["labels"] == "cc-by-nc"
    assert got[6]["n_words"] == got[7]["n_words"] == 0
    assert got[8]["base_labels"] == "gpl"


def test_shards_are_even_and_groups_meet(spark):
    texts = [f"t{i}" for i in range(400)] + ["hot"] * 150 + [f"g{i // 4}" for i in range(200)] + [None, None, ""]
    got = sharding.shard_by_propagation(table(spark, texts), 4).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        t = texts[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((t or "").encode()) and r["law"] == "rows"
    assert set(by) == {0, 1, 2, 3} and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    of = {r["doc_id"]: r["shard"] for r in got}
    groups = defaultdict(set)
    for i, t in enumerate(texts):
        if t and t[0] in "gh":
            groups[t].add(of[i])
    assert sum(len(v) > 1 for v in groups.values()) <= 2


def test_a_group_larger_than_a_shard(spark):
    got = sharding.shard_by_propagation(table(spark, ["hot"] * 500 + [f"t{i}" for i in range(100)]), 4).collect()
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes.values()) == {150}
    assert sharding.shard_by_propagation(table(spark, []), 4).count() == 0


def test_cut_share_is_the_best_on_small_tables(spark):
    texts = [f"t{i % 40}" if i % 3 else f"alone {i}" for i in range(320)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    placed = sharding.shard_by_propagation(docs, 4)
    assert sharding.cut_share(placed) == 0.0  # every group is smaller than a shard: none has to be cut
    sizes = [r["count"] for r in placed.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    big = spark.createDataFrame([(i, "same") for i in range(60)] + [(60 + i, f"x{i}") for i in range(20)], "doc_id long, text string")
    assert sharding.cut_share(sharding.shard_by_propagation(big, 4)) <= 1 - 20 / 60 + 1e-9  # a shard holds 20 of the 60


def test_small_groups_stay_whole_beside_a_hot_one(spark):
    rng = np.random.default_rng(3)
    texts = ["hot"] * 300 + [f"g{i}" for i in range(80) for _ in range(int(rng.integers(2, 9)))]
    texts += [f"alone {i}" for i in range(912 - len(texts))]
    texts = [texts[i] for i in rng.permutation(len(texts))]
    where, sizes = defaultdict(set), Counter()
    for r in sharding.shard_by_propagation(table(spark, texts), 8).collect():
        where[texts[r["doc_id"]]].add(r["shard"])
        sizes[r["shard"]] += 1
    assert set(sizes.values()) == {114}
    assert len(where.pop("hot")) == 3 and all(len(v) == 1 for v in where.values())  # 300 rows need three shards of 114


def test_quotas_keep_sizes_and_close_cycles():
    rng = np.random.default_rng(0)
    for _ in range(200):
        demand = rng.integers(0, 6, (5, 5)) * (rng.random((5, 5)) < 0.4)
        np.fill_diagonal(demand, 0)
        spare = rng.integers(0, 5, 5)
        grant, back = sharding._quotas(demand.astype(np.int64), spare.astype(np.int64))
        moved = grant + back
        assert (moved.sum(axis=0) == moved.sum(axis=1)).all()
        assert (grant >= 0).all() and (grant <= demand).all() and (back >= 0).all() and (back.sum(axis=1) <= spare).all()
        assert not (((demand - grant).sum(axis=0) > 0) & (spare - back.sum(axis=1) > 0)).any()  # no demand waits where a spare row is
    ring = np.array([[0, 2, 0], [0, 0, 3], [2, 0, 0]], np.int64)
    assert (sharding._quotas(ring, np.zeros(3, np.int64))[0] == np.where(ring > 0, 2, 0)).all()


def test_revisits(spark):
    rows = [
        (1, "http://A.com/x#f", 10, "response", "e1", None, "d1", {"ETag": "e1", "Content-Type": "t"}), (2, "https://www.a.com/x/?utm_source=q", 20, "revisit", 'W/e1', None, None, {"Date": "20", "Set-Cookie": "s"}),
        (3, "a.com/x", 20000, "response", "e2", "m", "d2", {"etag": "e2"}), (4, "a.com/x", 30000, "revisit", "e1", None, None, None), (5, "a.com/x", 30001, "revisit", None, "m", None, {}),
        (6, "b.com", 5, "revisit", "e1", None, None, None), (7, None, 5, "revisit", None, None, "d1", None), (8, "a.com/x", 10, "revisit", None, None, "d1", None), (9, "a.com/x", None, "revisit", "e1", None, None, None),
        (None, "a.com/x", 40000, "revisit", "e2", None, None, None), (None, "c.com", 1, "response", "e3", None, None, None), (10, "c.com", 2, "revisit", "e3", None, None, None), (8, "a.com/x", 10, "revisit", None, None, "d1", None),
        (11, "d.com", 5, "response", "x", None, None, {"ETag": "x"}), (11, "d.com", 5, "response", "y", None, None, {"ETag": "y"}), (11, "d.com", 5, "revisit", "y", None, None, {}),
    ]
    shape = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>"
    for per in (warc.BUCKET_ROWS, 2):
        table = spark.createDataFrame([(*r, "old", -1, "k") for r in rows], shape + ", resolution string, refers_to long, url_key string")
        found = warc.resolve_revisits(table, per).collect()
        assert len(found) == len(rows)
        got = {r["record_id"]: r for r in found if r["record_id"] is not None and r["record_id"] < 11}
        assert {k: (r["resolution"], r["refers_to"]) for k, r in got.items()} == {
            1: ("full", 1), 2: ("resolved", 1), 3: ("full", 3), 4: ("mismatch", 3), 5: ("resolved", 3), 6: ("orphan", None), 7: ("orphan", None), 8: ("resolved", 1), 9: ("orphan", None),
            10: ("orphan", None)}
        assert sum(r["record_id"] == 8 and r["resolution"] == "resolved" for r in found) == 2
        assert sorted(r["resolution"] for r in found if r["record_id"] is None) == ["full", "orphan"]
        assert [r["headers"] for r in found if r["record_id"] == 11 and r["kind"] == "revisit"] == [{"etag": "y"}]
        assert got[2]["headers"] == {"etag": "e1", "content-type": "t", "date": "20"}
    assert warc.resolve_revisits(spark.createDataFrame([], shape)).count() == 0


def test_headers_that_differ_in_case_only(spark):
    shape = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>"
    rows = [(1, "a.com", 1, "response", "e", None, None, {"etag": "b", "ETag": "a", "Age": "1"}), (2, "a.com", 2, "revisit", "e", None, None, {"DATE": "1", "date": "2", "Etag": "c"})]
    got = {r["record_id"]: r["headers"] for r in warc.resolve_revisits(spark.createDataFrame(rows, shape)).collect()}
    assert got == {1: rows[0][7], 2: {"age": "1", "etag": "c", "date": "1"}}


def test_revisits_of_a_busy_url_equal_a_plain_scan(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "hot.com" if i % 3 else f"u{i % 7}.com", int(rng.integers(0, 500)), "response" if rng.random() < 0.3 else "revisit", None, None, f"d{rng.integers(3)}", None) for i in range(900)]
    shape = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>"
    got = {r["record_id"]: (r["resolution"], r["refers_to"]) for r in warc.resolve_revisits(spark.createDataFrame(rows, shape), 20).collect()}
    last, want = {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        if r[3] == "response":
            last[r[1]], want[r[0]] = r, ("full", r[0])
        else:
            of = last.get(r[1])
            want[r[0]] = ("orphan", None) if of is None else ("resolved" if of[6] == r[6] else "mismatch", of[0])
    assert got == want


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower().decode())
    found = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found += [(i, i + len(p) - 1, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    return len(words), len(found), min((f[0] for f in found), default=None), max((f[0] for f in found), default=None), ",".join(sorted({f[2] for f in found}))


def test_license_base_equals_a_plain_scan(spark):
    rng = np.random.default_rng(6)
    bits = ["MIT", "license", "Apache", "general", "public", "the", "émit", "x1", "mit license", "General Public License", "apache-license", "li\u00adcense"]
    texts = [" ".join(rng.choice(bits, rng.integers(0, 40))).replace(" the ", rng.choice([", ", "\n", "/"])) for _ in range(200)] + [None, "", "mit", "MIT LICENSE" * 3]
    docs = spark.createDataFrame([(i, t, "z", 3) for i, t in enumerate(texts)], "doc_id long, text string, label string, rid int")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_characters_inside_pieces_only_become_bytes():
    merges = tokens.PieceMerges(vocabulary("piece_bpe_32k.model"))
    want = merges.counts(["▁ab", "▁"])
    inner = "\u4e00"
    merges.symbol[inner] = merges.known  # a character without a piece of its own
    merges.bytes_of = np.array([3])
    got = merges.counts(["▁ab" + inner, "▁"])
    assert got.tolist() == [want[0] + 3, want[1]]


ODD_ROWS = [(1, None, None), (1, "", None), (None, "same words here again and again", "a"), (2, "same words here again and again", "a"), (2, "same words here again and again", "a"),
       (3, "\u00e9\u00e8 \x0b\x0c  ", "b"), (4, " ".join(f"w{i % 5000}" for i in range(250_000)), "b")]


def odd_runs():
    path = lambda: vocabulary("byte_bpe_50k.json")
    return {
        "sharding": (lambda d: sharding.shard_by_propagation(d, 3), 7), "rules": (rules.verdicts, 7), "filter": (rules.filter_quality, 0), "lm": (lambda d: lm.score_texts(d, path()), 7),
        "substrings": (rlz.dedup_substrings, 7), "licenses": (licenses.scan_licenses, 7), "tokens": (lambda d: tokens.token_counts(d, vocabulary("piece_bpe_32k.model")), 7),
        "jaccard": (jaccard.jaccard_components, 7), "keep_one": (jaccard.keep_one, 7), "rewrite": (rlz.rewrite, 7),
        "packing": (lambda d: packing.pack(d, path()).groupBy("doc_id").count(), 5), "leaks": (lambda d: decontam.drop_contaminated(d, d.selectExpr("doc_id as item_id", "'same words here' as text")), 5)}  # rows with the item go, but for that without doc_id


@pytest.mark.parametrize("name", list(odd_runs()))
def test_odd_rows_and_clashing_columns(spark, name):
    """Nulls, repeats, one text of over a megabyte and columns named like the operators' own."""
    run, n = odd_runs()[name]
    clash = [f"{i} as {c}" for i, c in enumerate(("n", "k1", "sig", "node", "grp", "rid", "shard", "tag", "n_words", "failed", "queue", "ids", "held_out", "part"))]
    docs = spark.createDataFrame(ODD_ROWS, "doc_id long, text string, source string").selectExpr("*", *clash).repartition(2)
    assert len(run(docs).collect()) == n
    assert run(docs.where("false")).count() == 0


def test_python_gets_batches_of_bounded_bytes(spark):
    from textaxis import session

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    before = spark.conf.get(session._BATCH_BYTES)
    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("word "), 1600).alias("text"))  # 24 MB
    with session.scratch(spark):
        got = session.materialize(texts.mapInArrow(sizes, "n long, size long"), "sizes").collect()
    assert sum(r["n"] for r in got) == 3000 and max(r["size"] for r in got) < 1.1 * session.BATCH_BYTES
    assert spark.conf.get(session._BATCH_BYTES) == before


def test_a_task_gives_its_free_memory_back_also_when_it_ends_early(monkeypatch):
    given = []
    monkeypatch.setattr(words, "give_back", lambda: given.append(1))
    double = words.lean(lambda batches: (2 * b for b in batches))

    class Batches(list):
        def __rmul__(self, n):
            return [n * x for x in self]

    assert list(double(iter([Batches([1]), Batches([2, 3])]))) == [[2], [4, 6]] and len(given) == 1
    early = double(iter([Batches([1]), Batches([2])]))
    next(early)
    early.close()
    assert len(given) == 2


def test_the_encoder_keeps_few_chunks_and_no_long_ones(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 10)
    path = vocabulary("byte_bpe_50k.json")
    encoder = packing.ByteEncoder(path)
    for k in range(5):
        texts = [f"only{k}x{i} again" for i in range(8)] + ["abcd" * 5000 + " again", None, ""]
        got = encoder.encode(texts)
        assert got == [np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, encoder.kind).tobytes() for t in texts]
        assert len(encoder.known) <= 10 + 8 * 4 + 8 and max(map(len, encoder.known)) <= packing.CACHED_BYTES
