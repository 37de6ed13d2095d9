"""Source divergence, b-bit MinHash and ranked search against brute force."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.test_text_joins import corpus, lower
from textaxis.llm import divergence, minhash, search

ALPHA = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "n k1 sig node item source_ term value rank seat slab cell place band members hub segment terms counts score block number".split()


def clashing(df):
    return df.selectExpr("*", *[f"{i} as {c}" for i, c in enumerate(CLASH)])


def plain_divergence(rows, least):
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [ALPHA.findall(lower(t)) for t, _, _ in rows]
    df, of_lang, of_group = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for w, (_, lang, source) in zip(words, rows, strict=True):
        groups[lang].add(source)
        df[lang].update(set(w))
        of_lang[lang].update(w)
        of_group[lang, source].update(w)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]

        def p(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q, ps = p(of_lang[lang]), {s: p(of_group[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted((-sum(abs(ps[s][t] - ps[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((q[t] - ps[s][t], t.encode(), t) for t in kept if of_group[lang, s][t] and ps[s][t] > q[t])
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(pairs, 1)]
            out += [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(terms[:50], 1)]
    return sorted(out)


def group_rows(seed, n=160, sources=23):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in "abcdefghi" for b in ("x", "Y", "é", "zz")]
    rows = []
    for _ in range(n):
        s = int(rng.integers(sources)) if rng.random() < 0.6 else 0
        some = [words[int(i)] for i in rng.zipf(1.3, rng.integers(0, 60)) % len(words)]
        some += [words[s % len(words)]] * int(rng.integers(3))
        rows.append((" 1-".join(some), "en" if rng.random() < 0.7 else "de", f"s{s}"))
    return rows + [(None, None, None), ("", "en", "empty"), ("only lone words", "xx", "a"), ("other", "xx", "b"), ("one", "yy", "a"), (words[0], "en", None)] + rows[:5]


@pytest.mark.parametrize("seed", [0, 1])
def test_divergence_equals_brute_force(spark, seed, monkeypatch):
    rows = group_rows(seed)
    if seed:  # few entries a cell, so a language has many slabs; small stretches
        monkeypatch.setattr(divergence, "CELL_ENTRIES", 4)
        monkeypatch.setattr(divergence, "SLABS", 1)
    df = clashing(spark.createDataFrame(rows, "text string, lang string, source string")).repartition(3)
    got = sorted(tuple(r) for r in divergence.source_divergence(df, 5).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_divergence(rows, 5)
    assert divergence.source_divergence(df.where("false"), 5).count() == 0


def test_divergence_of_a_text_of_a_megabyte_and_one_hot_source(spark):
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, 4)) for _ in range(3000)]
    rows = [(" ".join(words[int(i)] for i in rng.integers(0, 3000, 250_000)), "en", "hot")]
    rows += [(" ".join(words[int(i)] for i in rng.integers(0, 3000, 300)), "en", "hot" if i % 3 else f"s{i % 5}") for i in range(60)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    got = sorted(tuple(r) for r in divergence.source_divergence(df, 4).collect())
    assert got == plain_divergence(rows, 4)


def test_shares_are_exact_where_products_overflow():
    for count, total, kept in ((3 * 10**14, 8 * 10**14, 10**6), (0, 0, 1), (7, 9, 3), (10**10, 10**10, 1)):
        assert divergence.shares(np.array([count]), np.array([total]), kept).tolist() == [1 + 10**9 * (count + 5) // (total + 5 * kept)]


def test_every_two_seats_meet_once():
    met = Counter(p for turn in range(divergence.SEATS - 1) for p in divergence.opponents(turn))
    assert set(met.values()) == {1} and len(met) == divergence.SEATS * (divergence.SEATS - 1) // 2
    for turn in range(divergence.SEATS - 1):
        assert sorted(x for p in divergence.opponents(turn) for x in p) == list(range(divergence.SEATS))


def test_cells_survive_packing():
    rng = np.random.default_rng(0)
    source = np.sort(rng.integers(0, 5, 40))
    term = np.concatenate([np.sort(rng.choice(100, int((source == s).sum()), replace=False)) for s in range(5)])
    n, totals = rng.integers(1, 10**12, 40), rng.integers(10**12, 10**13, 5)
    raw = divergence._packed(["a", "é", "", "d", "x" * 300], totals, 77, 100, source, term, n)
    got, want = divergence._unpacked(raw), divergence.Cell(["a", "é", "", "d", "x" * 300], totals, 77, 100, source, term, n)
    assert got.names == want.names and got.width == want.width
    assert all((getattr(got, c) == getattr(want, c)).all() for c in ("source", "term", "p", "zero", "cuts"))


def sets_of(t, k=3):
    w = WORD.findall(lower(t))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain_components(texts, ids, percent=85):
    s, parent = [sets_of(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if ids[i] is not None and ids[j] is not None and s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(s[i]), low[find(i)] if d is not None else None, d is None or low[find(i)] == d) for i, d in enumerate(ids)), key=str)


def shape(spark, texts, ids):
    return clashing(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3))


@pytest.mark.parametrize(("seed", "bucket"), [(0, 16), (1, 2), (2, 1)])
def test_near_duplicates_equal_brute_force(spark, seed, bucket):
    """With small buckets the exact join of crowded bands takes over."""
    texts = corpus(seed, 300) + [None, "", " ", "a b", "A  b", "a b c", "É x", "é x", "a b", "a b"]
    ids = [int(i) for i in np.random.default_rng(seed).permutation(len(texts)) * 3]
    ids[-1], ids[-2] = None, ids[-3]
    got = sorted((tuple(r) for r in minhash.near_duplicates(shape(spark, texts, ids), bucket=bucket).collect()), key=str)
    assert got == plain_components(texts, ids)


def test_a_chain_of_edits_and_a_crowd_of_edited_copies(spark):
    rng = np.random.default_rng(7)
    base = [f"b{i}" for i in range(120)]
    texts, w = [], list(base)
    for i in range(40):  # neighbours link, ends don't
        w = [*w]
        w[3 * i] = f"c{i}"
        texts.append(" ".join(w))
    for i in range(150):  # around the limit
        w = [f"x{j}" for j in range(100)]
        for _ in range(int(rng.integers(0, 6))):
            w[int(rng.integers(100))] = f"e{i}_{rng.integers(99)}"
        texts.append(" ".join(w))
    ids = [int(i) for i in rng.permutation(len(texts))]
    for bucket in (3, 16):
        got = sorted((tuple(r) for r in minhash.near_duplicates(shape(spark, texts, ids), bucket=bucket).collect()), key=str)
        assert got == plain_components(texts, ids)


def test_near_duplicates_of_a_very_long_text_and_of_nothing(spark):
    long = [f"w{i % 5000}" for i in range(250_000)]
    texts = [" ".join(long), " ".join(long[:240_000] + ["q"]), "x y z"]
    assert minhash.near_duplicates(shape(spark, texts, [5, 2, 3])).where("component_id = 2").count() == 2
    assert minhash.near_duplicates(shape(spark, texts, [5, 2, 3]).where("false")).count() == 0


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(1)
    for similarity in (0.2, 0.5, 0.85, 1.0):
        n, off = 600, []
        for _ in range(40):
            both = int(n * 2 * similarity / (1 + similarity))
            x = rng.integers(0, 2**64, 2 * n - both, dtype=np.uint64)
            m = minhash.minima([x[:n], x[n - both:]])
            s = minhash.signatures(m)
            same = int(minhash.agreeing(s[:1], s[1:])[0])
            assert same == int((minhash.mix(m[0].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(16) == minhash.mix(m[1].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(16)).sum())
            off.append(minhash.estimate(same) - similarity)
        assert abs(np.mean(off)) < 0.03
    assert 0.55 < minhash.estimate(minhash.least_agreeing(0.85)) < 0.75


def test_bands_find_pairs_at_the_limit():
    rng = np.random.default_rng(2)
    missed = 0
    for _ in range(300):
        n, both = 200, 184  # 184 / 216 = 0.852
        x = rng.integers(0, 2**64, 2 * n - both, dtype=np.uint64)
        k = minhash.bands(minhash.minima([x[:n], x[n - both:]]))
        missed += not (k[0] == k[1]).any()
    assert missed == 0


def plain_search(docs, items, k):
    words = [ALNUM.findall(lower(t)) for _, t in docs]
    n, total = sum(map(bool, words)), sum(map(len, words))
    tf, df = [Counter(w) for w in words], Counter(t for w in words for t in set(w))
    out = []
    for item, text in items:
        asked = Counter(ALNUM.findall(lower(text)))
        scores = []
        for (doc, _), counts, w in zip(docs, tf, words, strict=True):
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * (25 + 75 * len(w) * n // total)))
                    for t, times in asked.items() if counts[t])
            if s > 0 and doc is not None:
                scores.append((-s, doc))
        out += [(item, i, d, -s) for i, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def search_rows(seed, n=400):
    rng = np.random.default_rng(seed)
    words = [f"t{i}" for i in range(80)] + ["É", "Zz9"]
    text = lambda most: " ".join(words[int(i) % len(words)] for i in rng.zipf(1.2, rng.integers(0, most)))
    docs = [(int(i), text(50)) for i in rng.permutation(n)]
    docs += [(n, None), (n + 1, ""), (None, "t1 t1 t1 t5"), (n + 2, "t1 t5!"), (n + 3, "T1, t5"), (n + 3, "t1 t5"), (n + 4, " ".join(words) * 2)]
    items = [(i, text(12)) for i in range(20)] + [(20, None), (21, ""), (22, "unheard of"), (23, "t1 T1 t5 t1"), (23, "t1 T1 t5 t1"), (None, "zz9 é")]
    return docs, items


@pytest.mark.parametrize(("seed", "k", "chars"), [(0, 10, 1 << 22), (1, 1, 40), (2, 500, 200)])
def test_search_equals_brute_force(spark, seed, k, chars, monkeypatch):
    """Also in many blocks of items, in small segments, and with more asked than there is."""
    docs, items = search_rows(seed)
    monkeypatch.setattr(search, "BLOCK_CHARS", chars)
    got = search.search(clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)), clashing(spark.createDataFrame(items, "item_id long, text string")), k)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search(docs, items, k)


def test_search_in_a_text_of_a_megabyte_and_empty_tables(spark):
    docs = [(1, "rare " + " ".join(f"w{i % 999}" for i in range(250_000))), (2, "rare w1"), (3, "w1")]
    items = [(1, "rare w1"), (2, "w5")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(r) for r in search.search(d, i).collect()) == plain_search(docs, items, 10)
    assert search.search(d.where("false"), i).count() == 0 and search.search(d, i.where("false")).count() == 0


def test_impacts_bound_the_saturated_frequency():
    rng = np.random.default_rng(4)
    x = search.saturated(rng.integers(1, 10**6, 1000), rng.integers(1, 10**6, 1000), 1000, 10**6)
    impact = -(-x // search.STEP)
    assert impact.max() <= 255 and (impact * search.STEP >= x).all() and ((impact - 1) * search.STEP < x).all()
