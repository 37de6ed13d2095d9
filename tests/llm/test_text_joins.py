"""Near duplicates, substring repeats, leaks and language-model scores against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from textaxis.llm import decontam, jaccard, lm, rlz
from textaxis.llm.queries import vocabulary

SHAPE = "doc_id long, text string, id string, hub int, spans string, tag string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in zip(ids or range(len(texts)), texts, strict=True)], SHAPE)


def lower(t):
    return (t or "").encode().lower().decode()


def shingles(t):
    w = WORD.findall(lower(t))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(texts, ids):
    s = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                parent[find(i)] = find(j)
    low = {}
    for i in range(len(texts)):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return {ids[i]: (len(s[i]), low[find(i)]) for i in range(len(texts))}


def corpus(seed, n, vocabulary_size=300):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(vocabulary_size)]
    base = [list(rng.choice(words, rng.integers(1, 160))) for _ in range(n // 4)]
    out = []
    for _ in range(n):
        w = list(base[rng.integers(len(base) if rng.random() < 0.5 else 3)])
        for _ in range(rng.integers(0, 8)):
            k = rng.integers(0, len(w) + 1)
            w[k:k + int(rng.integers(0, 3))] = list(rng.choice(words, rng.integers(0, 3)))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_components_equal_brute_force(spark, seed):
    texts = corpus(seed, 300) + [None, "", " ", "a b", "A  b", "a b c d e", "É x", "é x"]
    ids = [int(i) for i in np.random.default_rng(seed).permutation(len(texts)) * 3]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(table(spark, texts, ids)).collect()}
    assert got == components(texts, ids)


def test_large_group_of_edited_copies(spark):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.integers(0, 6)):
            w[rng.integers(100)] = f"e{i}_{rng.integers(9)}"
        texts.append(" ".join(w))
    texts += texts[:50]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(table(spark, texts)).collect()}
    assert got == components(texts, list(range(len(texts))))


def test_a_token_in_a_third_of_the_sets(spark):
    rng = np.random.default_rng(13)
    shared = [f"common{k}" for k in range(12)]
    texts = []
    for i in range(240):
        if i % 3 == 0:  # edited copies of one text, and short texts that are little more than the common passage
            w = [f"c{k}" for k in range(60)] + shared
            for _ in range(rng.integers(0, 6)):
                w[rng.integers(len(w))] = f"e{rng.integers(1000)}"
        elif i % 3 == 1:
            w = shared + [f"x{rng.integers(40)}" for _ in range(rng.integers(0, 12))]
        else:
            w = [f"r{rng.integers(300)}" for _ in range(rng.integers(5, 80))]
        texts.append(" ".join(w))
    ids = list(range(len(texts)))
    for part_members in (jaccard.PART_MEMBERS, 16):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(table(spark, texts, ids), part_members=part_members).collect()}
        assert got == components(texts, ids)


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(14)
    for _ in range(200):
        both = rng.integers(0, 2**64, rng.integers(1, 500), dtype=np.uint64)
        x, y = (np.unique(np.concatenate([both, rng.integers(0, 2**64, rng.integers(0, 200), dtype=np.uint64)])) for _ in range(2))
        a, b = (np.frombuffer(jaccard.signature(s), np.uint8) for s in (x, y))
        wide = min(len(a), len(b))
        a, b = (np.bitwise_xor.reduce(s.reshape(-1, wide), axis=0) for s in (a, b))
        assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))


def test_jaccard_odd_tables(spark):
    assert jaccard.jaccard_components(table(spark, [])).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (0, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (0, 0, 0)], key=str)
    kept = jaccard.keep_one(table(spark, ["a b c d e f", "a b c d e f", "", None]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3] and kept.columns == table(spark, []).columns


def plain_cut(texts, ids, k):
    words = {i: WORD.findall(t or "") for i, t in zip(ids, texts, strict=True)}
    first = {}
    for i, w in words.items():
        for s in range(len(w) - k + 1):
            g = tuple(w[s:s + k])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, w in words.items():
        gone = {p for s in range(len(w) - k + 1) if first[tuple(w[s:s + k])] < i for p in range(s, s + k)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize(("window", "anchor"), [(50, 16), (8, 3), (5, 5)])
def test_substrings_equal_brute_force(spark, window, anchor):
    rng = np.random.default_rng(window)
    passages = [[f"p{j}_{i}" for i in range(int(rng.integers(window - 2, 3 * window)))] for j in range(8)]
    texts = []
    for i in range(150):
        w = []
        for _ in range(rng.integers(0, 4)):
            w += [f"o{rng.integers(40)}" for _ in range(rng.integers(0, 2 * window))]
            p = passages[rng.integers(len(passages))]
            a = rng.integers(0, 5)
            w += p[a:len(p) - rng.integers(0, 5)]
        texts.append(" \n".join(w))
    texts += [None, "", "r " * 200, "r " * 260, texts[3]]
    ids = [int(i) for i in rng.permutation(len(texts))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rlz.dedup_substrings(table(spark, texts, ids), window, anchor).collect()}
    assert got == plain_cut(texts, ids, window)
    text = {r["doc_id"]: r["text"] for r in rlz.rewrite(table(spark, texts, ids), window, anchor).collect()}
    for i, t in zip(ids, texts, strict=True):
        if got[i][1]:
            assert hashlib.sha256(text[i].encode()).hexdigest() == got[i][2]
        else:
            assert text[i] == t


@pytest.mark.parametrize("seed", range(4))
def test_passages_twice_in_the_later_document(spark, seed):
    rng = np.random.default_rng(seed)
    a, b, p, x, y = ([f"{c}{seed}_{rng.integers(10**6)}" for _ in range(60)] for c in "abpxy")
    first, later = " ".join(a + p + b), " ".join(x + p + y + x + p + y)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rlz.dedup_substrings(table(spark, [first, later])).collect()}
    assert got == plain_cut([first, later], [0, 1], 50) and got[1][1] == 120
    rows = table(spark, [first, " ".join(x + p + y), " ".join(a[:9] + x + p + y)], [0, 1, 1])  # one doc_id, two texts
    assert sorted(r["n_removed"] for r in rlz.dedup_substrings(rows).collect()) == [0, 60, 60]


def test_factors_are_copies_and_greedy(spark):
    rng = np.random.default_rng(12)
    words = [f"w{k}" for k in range(400)]
    texts = [list(rng.choice(words, 200)) for _ in range(4)]
    for _ in range(12):
        parts = []
        for _ in range(3):
            source = texts[rng.integers(len(texts))]
            a = int(rng.integers(0, len(source) - 30))
            parts += source[a:a + int(rng.integers(5, 90))] + list(rng.choice(words, rng.integers(0, 6)))
        texts.append(parts)
    rows = rlz.factors(table(spark, [" ".join(t) for t in texts]), 20, 8).collect()
    assert len(rows) > 10
    covered = {}
    for r in rows:
        assert r["length"] >= 20 and r["ref_doc_id"] < r["doc_id"]
        copy = texts[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert copy == texts[r["ref_doc_id"]][r["ref_start"]:r["ref_start"] + r["length"]]
        covered.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["length"]))
    first = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - 19):
            first.setdefault(tuple(t[i:i + 20]), d)
    for d, t in enumerate(texts):
        want = {p for i in range(len(t) - 19) if first[tuple(t[i:i + 20])] < d for p in range(i, i + 20)}
        assert covered.get(d, set()) == want


def test_parse_takes_the_furthest_factor():
    copies = [(0, 50, 3, 10), (30, 80, 3, 40), (20, 70, 1, 0), (60, 200, 2, 5), (70, 120, 1, 9), (300, 350, 4, 0)]
    assert rlz.parse(copies) == [(0, 80, 3, 10), (60, 140, 2, 5), (300, 50, 4, 0)]
    assert rlz.parse([]) == []


def test_texts_without_factors_are_not_shuffled(spark, monkeypatch):
    rng = np.random.default_rng(8)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 400, n))
    passage = word(60)
    texts = [word(80) for _ in range(40)] + [f"{word(30)} {passage} {word(20)}" for _ in range(4)] + [None, ""]
    rows = [(i, t, f"more {i}") for i, t in enumerate(texts)] + [(None, texts[40], "no id"), (41, texts[41], "again"), (41, "other", "same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, factors string")
    got = {}
    for most in (1 << 20, 0):
        monkeypatch.setattr(rlz, "BROADCAST_IDS", most)
        out = rlz.rewrite(docs)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert ("LeftAnti" in plan) == (most > 0)
        if most:  # the branch of texts without factors is a broadcast join over the input
            assert "BroadcastHashJoin" in (physical := out._jdf.queryExecution().sparkPlan().toString()) and "LeftAnti, BuildRight" in physical
        sums = rlz.dedup_substrings(docs, keep_text=True).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept")
        got[most] = [sorted(map(tuple, x.collect()), key=repr) for x in (out, sums)]
        assert out.columns == docs.columns
    assert got[0] == got[1 << 20] and len(got[0][0]) == len(got[0][1]) == len(rows)
    assert sum(r[2] for r in got[0][1]) == 4 * 60


def test_substrings_odd_tables(spark):
    assert rlz.dedup_substrings(table(spark, [])).count() == 0
    long = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, long), (1, long), (None, long), (2, long)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in rlz.dedup_substrings(docs).collect())
    assert got == [("1", 0), ("1", 0), ("2", 60), ("None", 0)]
    assert rlz.rewrite(docs).columns == docs.columns


def plain_align(x, y):
    best = 0
    row = [0] * (len(y) + 1)
    for a in x:
        new = [0]
        for j, b in enumerate(y):
            new.append(max(0, row[j] + (2 if a == b else -1), row[j + 1] - 1, new[j] - 1))
        best, row = max(best, *new), new
    return best


def test_alignment_scores(spark):
    rng = np.random.default_rng(3)
    xs = [rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint64) for _ in range(60)]
    ys = [rng.integers(0, 6, rng.integers(1, 50)).astype(np.uint64) for _ in range(60)]
    score, end = decontam.align(xs, ys)
    assert score.tolist() == [plain_align(x.tolist(), y.tolist()) for x, y in zip(xs, ys, strict=True)]
    assert all(plain_align(x.tolist(), y[:e].tolist()) == s for x, y, e, s in zip(xs, ys, end, score, strict=True))


def test_leaks_exact_and_edited(spark):
    rng = np.random.default_rng(4)
    word = lambda: f"w{rng.integers(5000)}"
    items = [[word() for _ in range(rng.integers(15, 60))] for _ in range(30)]
    texts, want = [], set()
    for i in range(120):
        w = [word() for _ in range(rng.integers(0, 300))]
        if i % 3 == 0:
            k = int(rng.integers(len(items)))
            copy = list(items[k])
            if i % 6 == 0:
                for _ in range(len(copy) // 10):
                    copy[rng.integers(len(copy))] = word()
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = copy
            want.add((i, k))
        texts.append(", ".join(w).upper())
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(98, "a b"), (99, None), (None, "x y z w v u")], "item_id long, text string")
    got = decontam.contaminated_pairs(table(spark, [*texts, None, ""]), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    for r in got:
        if r["doc_id"] % 6:
            assert r["score"] == 1.0 and r["end_word"] - r["start_word"] == r["item_words"]
    left = {r["doc_id"] for r in decontam.drop_contaminated(table(spark, texts), bench).collect()}
    assert left == set(range(120)) - {d for d, _ in want}
    assert decontam.contaminated_pairs(table(spark, []), bench).count() == 0
    assert decontam.contaminated_pairs(table(spark, texts), bench.where("false")).count() == 0


def test_a_common_seed_is_enough(spark):
    item = [f"i{k}" for k in range(15)]
    edited = [w if k not in (4, 8, 12) else f"e{k}" for k, w in enumerate(item)]  # runs of 4, 3, 3 and 2: one seed
    around = [f"a{k}" for k in range(40)]
    texts = [" ".join(around + edited + around), *(f"x{k} " + " ".join(item) for k in range(30)), "no " + " ".join(item[:4]) + " more"]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in decontam.contaminated_pairs(table(spark, texts), bench).collect()}
    assert got == {0: 0.7} | dict.fromkeys(range(1, 31), 1.0)


def edited(rng, item, share, even):
    """A copy with words changed at even steps, or changed, dropped and put in at random."""
    if even:
        step = max(2, round(1 / share))
        return [f"e{rng.integers(10**6)}" if k % step == step - 1 else w for k, w in enumerate(item)]
    out = []
    for w in item:
        if rng.random() >= share:
            out.append(w)
        elif (kind := rng.integers(3)) == 0:
            out.append(f"e{rng.integers(10**6)}")
        elif kind == 1:
            out += [w, f"e{rng.integers(10**6)}"]
    return out


@pytest.mark.parametrize("index_seeds", [decontam.INDEX_SEEDS, 0])
def test_edited_copies_against_all_alignments(spark, index_seeds):
    rng = np.random.default_rng(8)
    items = [[f"w{rng.integers(400)}" for _ in range(rng.integers(8, 45))] for _ in range(20)]
    texts = []
    for share in (0.05, 0.1, 0.2, 0.25, 0.3):
        for even in (False, True):
            for k in range(0, 20, 2):
                around = [f"w{rng.integers(400)}" for _ in range(30)]
                texts.append(" ".join(around[:15] + edited(rng, items[k + even], share, even) + around[15:]))
    number = {}
    coded = lambda t: np.array([number.setdefault(w, len(number) + 1) for w in t.split()], np.uint64)
    xs, ys = [coded(" ".join(x)) for x in items], [coded(t) for t in texts]
    want = {}
    for d, y in enumerate(ys):
        score, _ = decontam.align(xs, [y] * len(xs))
        want |= {(d, k): s / (2 * len(x)) for k, (s, x) in enumerate(zip(score.tolist(), xs, strict=True)) if s >= len(x)}
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contaminated_pairs(table(spark, texts), bench, index_seeds=index_seeds).collect()}
    assert set(got) <= set(want) and len(want) > 80
    assert len(got) >= 0.95 * len(want)
    assert all(got[p] == pytest.approx(want[p], abs=1e-5) for p in got)


def test_every_fourth_word_replaced_is_found(spark):
    items = [[f"i{k}x{j}" for j in range(40)] for k in range(20)]
    texts = [" ".join(f"e{k}x{j}" if j % 4 == 3 else w for j, w in enumerate(x)) for k, x in enumerate(items)]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = decontam.contaminated_pairs(table(spark, texts), bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(k, k) for k in range(20)]


def test_scores_base_and_model(spark):
    rng = np.random.default_rng(6)
    words = ["alpha", "beta", "gamma", "delta", "Omega", "zeta"]
    texts = [" ".join(words[(i + j * (1 + i % 2)) % 6] for j in range(rng.integers(1, 80))) for i in range(200)] + [None, "", "never seen before"]
    got = {r["doc_id"]: r for r in lm.score_texts(table(spark, texts), vocabulary("byte_bpe_50k.json")).collect()}
    held = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 1}
    counts, n_texts = Counter(), 0
    for i, t in enumerate(texts):
        if i not in held:
            counts.update(WORD.findall(lower(t)))
            n_texts += 1
    n, v = sum(counts.values()) + n_texts, len(counts) + 1
    log = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    for i, t in enumerate(texts):
        w, r = WORD.findall(lower(t)), got[i]
        assert r["held_out"] == (i in held) and r["n_tokens"] == len(w) + 1 and r["train_tokens"] == n
        assert r["n_known"] == sum(counts[x] > 0 for x in w) + 1
        assert r["base_score"] == pytest.approx(sum(log(counts[x]) for x in w) + log(n_texts), abs=1e-6)
        assert r["score"] < 0 and math.isfinite(r["score"])
    many = [i for i in held if texts[i] and len(texts[i]) > 100]
    assert sum(got[i]["score"] for i in many) > sum(got[i]["base_score"] for i in many)
    assert lm.score_texts(table(spark, []), vocabulary("byte_bpe_50k.json")).count() == 0


def plain_model(units, pairs, classes):
    return lm.Model(np.asarray(units), pairs, np.asarray(classes, np.int32))


def small_model(n=40, seed=7):
    rng = np.random.default_rng(seed)
    pairs = np.zeros((lm.CLASSES, lm.CLASSES), np.int64)
    pairs[:n, :n] = rng.integers(0, 9, (n, n))
    return plain_model(rng.integers(0, 50, n), pairs, np.minimum(np.arange(n), lm.CLASSES - 1))


def plain_score(model, text):
    """The model written down place by place."""
    w, out = model.weights, 0.0
    distance, key, match = w["distance"], w["key"], w["match"]
    before = [model.end, *text.tolist()]  # before[i] is the id before place i
    for i, target in enumerate(text.tolist()):
        last, low = before[i], (i // lm.BLOCK - 1) * lm.BLOCK
        c = model.classes[last]
        total = copied = 0.0
        best = 0
        for j in range(max(0, low), i):
            level = 0 if before[j] != last else 2 if j > max(0, low) and before[j - 1] == before[i - 1] else 1
            best = max(best, level)
            s = distance[i - j] * key[model.classes[before[j]]] * match[level, c]
            total += s
            copied += s * (text[j] == target)
        uni, bi = model.unigram[target], model.bigram[c, model.classes[target]] * model.inside[target]
        g = w["gate"][c * 3 + best]
        out += math.log10(g[0] * uni + g[1] * bi + g[2] * (copied / total if total else bi))
    return out


def test_texts_are_coded_and_counted_in_large_slices(monkeypatch):
    import pyarrow as pa

    from textaxis.llm import packing

    encoder, calls = packing._encoder(vocabulary("byte_bpe_50k.json")), []
    whole = encoder.encode_column
    monkeypatch.setattr(encoder, "encode_column", lambda texts: calls.append(len(texts)) or whole(texts))
    texts = [f"Word{i % 7} of\x0bÉ text{i} " * 6000 for i in range(30)] + [None, "", "\x1c Ab"]  # 4 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([False] * len(texts)), pa.array(texts)], names=["doc_id", "held_out", "text"])
    coded = list(lm._code(vocabulary("byte_bpe_50k.json"))(iter([batch])))
    assert calls == [len(texts)]
    assert coded[0].column("ids").to_pylist() == encoder.encode([lower(t) for t in texts])
    end = encoder.tokenizer.get_vocab_size()
    found = [r for b in lm._count(encoder.kind.str, end)(iter(coded)) for r in b.to_pylist()]
    assert {r["word"]: r["n"] for r in found if r["kind"] == 0} == Counter(w.encode() for t in texts for w in WORD.findall(lower(t)))
    assert [r["n"] for r in found if r["kind"] == 2] == [len(texts)]


def test_cells_are_the_places_that_a_line_sees():
    want = [(i, j) for i in range(lm.BLOCK + 2) for j in range(lm.BLOCK - 1 + i)]
    assert list(zip(lm._LINE.tolist(), lm._COLUMN.tolist(), strict=True)) == want
    at = {c: k for k, c in enumerate(want)}
    for k, back in enumerate(lm._BACK, 1):
        assert all(b == at[i - k, j - k] for (i, j), b in zip(want, back.tolist(), strict=True) if i >= k and j >= k)


@pytest.mark.parametrize("size", [1, 2, lm.BLOCK, lm.BLOCK + 1, 5 * lm.BLOCK + 7])
def test_scores_equal_the_plain_model(size):
    model, rng = small_model(), np.random.default_rng(size)
    model.weights["distance"] = rng.uniform(0.5, 2, 2 * lm.BLOCK).astype(np.float32)
    model.weights["key"] = rng.uniform(0.5, 2, lm.CLASSES).astype(np.float32)
    text = rng.integers(0, 40, size).astype(np.int32)
    other = rng.integers(0, 40, 3).astype(np.int32)
    got = model.score([other, text, other])
    assert got[1] == pytest.approx(plain_score(model, text), rel=1e-4)
    assert got[0] == got[2] == pytest.approx(plain_score(model, other), rel=1e-4)


def test_every_id_is_a_target_once():
    model = small_model()
    texts = [np.arange(n).astype(np.int32) % 40 for n in (1, 2, lm.BLOCK, lm.BLOCK + 1, 300, 4)]
    seen = [[] for _ in texts]
    for x, text in model.windows(texts):
        for row, t in zip(x, text, strict=True):
            seen[t] += [v for v in row[lm.BLOCK + 1:].tolist() if v >= 0]
    assert seen == [t.tolist() for t in texts]


def test_probabilities_sum_up_to_one():
    model, rng = small_model(), np.random.default_rng(9)
    prefix = rng.integers(0, 40, 50).astype(np.int32)
    start = model.score([prefix])[0]
    assert sum(10 ** (model.score([np.append(prefix, x).astype(np.int32)])[0] - start) for x in range(40)) == pytest.approx(1.0, abs=1e-3)


def repeats(rng, n=60):
    """Texts whose second half repeats the first at a distance, in random order of phrases."""
    out = []
    for _ in range(n):
        phrases = [rng.integers(0, 200, 6) for _ in range(4)]
        out.append(np.concatenate([phrases[i] for i in rng.permutation(np.repeat(np.arange(4), 3))] + [[200]]).astype(np.int32))
    return out


def test_learned_attention_beats_uniform_weights_and_bigrams():
    rng = np.random.default_rng(10)
    train, held = repeats(rng), repeats(rng)
    units, classes = np.bincount(np.concatenate(train), minlength=201), np.arange(201)
    pairs = np.zeros((lm.CLASSES, lm.CLASSES), np.int64)
    for x in train:
        np.add.at(pairs, (np.append(200, x[:-1]), x), 1)

    def held_out(learned):
        model = plain_model(units, pairs, classes)
        if not learned:
            model.weights["match"][:] = 1
        for _ in range(3):
            grown = model.sums()
            model.train(train, grown)
            kept = {k: w.copy() for k, w in model.weights.items()}
            model.learn(grown)
            if not learned:
                model.weights.update(distance=kept["distance"], key=kept["key"], match=kept["match"])
        with_attention = model.score(held).sum()
        model.weights["gate"][:, 1] += model.weights["gate"][:, 2]
        model.weights["gate"][:, 2] = 0
        return with_attention, model.score(held).sum()

    learned, bigrams = held_out(True)
    uniform, _ = held_out(False)
    assert learned > 0.85 * uniform and learned > 0.75 * bigrams  # scores are negative


def test_training_passes_add_up_over_parts_and_help():
    rng = np.random.default_rng(11)
    texts = repeats(rng, 20)
    model = plain_model(np.bincount(np.concatenate(texts), minlength=201), np.zeros((lm.CLASSES, lm.CLASSES), np.int64), np.arange(201))
    whole, parts = model.sums(), model.sums()
    model.train(texts, whole)
    for x in texts:
        model.train([x], parts)
    assert all(np.allclose(whole[k], parts[k], rtol=1e-3, atol=1e-4) for k in whole)
    assert whole["gate"].sum() == pytest.approx(sum(map(len, texts)), rel=1e-4)  # each id of each text trains once
    before = model.score(texts).sum()
    model.learn(whole)
    assert model.score(texts).sum() > before
