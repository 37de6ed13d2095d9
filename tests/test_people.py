"""Speakers matched and pooled, against a plain pass over the rows."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from textaxis.operators import people as P

SPEECH = "id long, congress int, speaker_id string, last_name string, first_name string, chamber string, state string, text string"
MEMBER = "congress int, chamber string, state_abbrev string, bioname string, icpsr long, party_code string, nominate_dim1 double, nominate_dim2 double"


def plain(speeches, members, least, most):
    index = defaultdict(list)
    for m in members:
        if m[6] is not None:
            last, _, first = m[3].partition(", ")
            index[m[0], m[1], m[2]].append((last.strip().upper(), first.strip().upper(), m))
    units = {}
    for s in sorted(speeches):
        n = len((s[7] or "").split())
        if n < least:
            continue
        u = units.setdefault((s[1], s[2]), {"d": s[3:7], "texts": [], "n": 0, "start": s[0]})
        if u["n"] < most:
            u["texts"].append(s[7].strip())
            u["n"] += n
    people, unmatched = {}, set()
    for (congress, speaker), u in sorted(units.items(), key=lambda x: (x[0][0], x[1]["start"])):
        last, first, chamber, state = u["d"]
        named = [x for x in index[congress, {"H": "House", "S": "Senate"}.get(chamber), state] if x[0] == last]
        if len(named) > 1:
            named = [x for x in named if first and x[1][:1] == first[0]]
        if len(named) != 1:
            unmatched.add((congress, speaker))
            continue
        m = named[0][2]
        p = people.setdefault(m[4], {"bioname": m[3], "chambers": [], "states": [], "congresses": set(), "d": [], "texts": [], "n": 0})
        p["texts"] += u["texts"]
        p["n"] += u["n"]
        p["congresses"].add(congress)
        p["d"].append((m[6], m[7] or 0.0))
        for c, v in (("chambers", chamber), ("states", state)):
            if v not in p[c]:
                p[c].append(v)
    return people, unmatched


def test_people_equal_a_plain_pass(spark):
    rng = np.random.default_rng(0)
    members = [(int(rng.integers(1, 4)), ["House", "Senate"][int(rng.integers(2))], f"S{rng.integers(3)}", f"L{rng.integers(12)}{', ' if rng.random() < 0.9 else ''}{'ABC'[int(rng.integers(3))]}y ", int(rng.integers(60)), "100",
                None if rng.random() < 0.1 else float(rng.normal()), None if rng.random() < 0.3 else float(rng.normal())) for _ in range(150)]
    members = list({(m[0], m[1], m[2], m[3].partition(", ")[0], m[4]): m for m in members}.values()) + [(1, "House", "S0", "SOLO, Han", 500, "200", 0.5, None), (2, "Senate", "S1", "SOLO, Han", 500, "200", 0.25, 1.0)]
    speeches = []
    for i in rng.permutation(900).tolist():
        k = 0 if i % 3 == 0 else int(rng.integers(1, 60))  # a third of all speeches in three units
        speeches.append((i, i % 3 + 1, f"p{k}", f"L{k % 12}", ["A", "Bob", ""][k % 3], "HSE"[k % 5 % 3], f"S{k % 4}", None if i % 50 == 0 else " " + "w " * int(rng.integers(0, 30)) + f"end{i}\n"))
    speeches += [(1000, 1, "solo", "SOLO", "HAN", "H", "S0", "first words here"), (1001, 2, "other", "SOLO", "", "S", "S1", "more words here"), (1002, 2, "other", "SOLO", "", "S", "S1", "short")]
    s, m = spark.createDataFrame(speeches, SPEECH).repartition(5), spark.createDataFrame(members, MEMBER).repartition(3)
    people, unmatched = P.pool_people(s, m, "id", "text", 3, 120)
    want, none = plain(speeches, members, 3, 120)
    got = {r.icpsr: r for r in people.collect()}
    assert set(got) == set(want) and 500 in got and {(r.congress, r.speaker_id) for r in unmatched.collect()} == none and none
    for k, p in want.items():
        r = got[k]
        assert (r.chambers, r.states, r.congresses, r.n_words, r.n_speeches, r.n_units) == (p["chambers"], p["states"], sorted(p["congresses"]), p["n"], len(p["texts"]), len(p["d"]))
        assert r.text == " ".join(p["texts"]) and np.allclose([r.nominate_dim1, r.nominate_dim2], np.mean(p["d"], axis=0)) and r.bioname == p["bioname"]
    assert got[500].text == "first words here more words here" and got[500].nominate_dim2 == 0.5
    people, unmatched = P.pool_people(s.where("false"), m, "id")
    assert people.count() == 0 and unmatched.count() == 0


def test_words_in_batches_equal_words_of_columns(spark):
    from textaxis.functions.text import word_count, word_count_in_batches

    spaces = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"
    texts = [None, "", " ", "a", " a  b ", *[f"{c}a{c}b{c}{c}c" for c in spaces], "a​b c", "﻿a b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r.a == r.b for r in df.select(word_count(F.col("t")).alias("a"), word_count_in_batches(F.col("t")).alias("b")).collect())


def test_only_counts_are_put_in_order(spark, monkeypatch):
    """No text goes through the range shuffle, for speeches and for equalized texts."""
    from textaxis.operators import corpus, people, ranking

    seen = []

    def spy(df, *more):
        seen.append(df.columns)
        return ranking.ordered(df, *more)

    monkeypatch.setattr(people, "ordered", spy)
    monkeypatch.setattr(corpus, "ordered", spy)
    df = spark.createDataFrame([(1, 1, i, "a b c", "k") for i in range(9)], "congress int, speaker_id int, i int, text string, k string")
    assert sorted(r.i for r in people.speaker_speeches(df, "i", "text", 1, 7).collect()) == [0, 1, 2]
    assert sum(r.kept_words for r in corpus.equalize(df, "k", "i", "text", 7, 1).collect()) == 7
    assert len(seen) == 2 and all("text" not in c for c in seen)
