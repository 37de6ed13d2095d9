"""Exact Jaccard join on word n-grams with set-relation skipping, and the components of its links.

A document's set holds the hashes of its distinct n-grams. Equal sets are one class, so copies cost nothing further.
Every class puts the tokens of its prefix (under one global order: unfrequent hashes first, by value, then frequent
ones by count) into index lists. Two relations let most of the work be skipped:

* *within lists, by position*: sets of sizes a and b need an overlap of ``t / (1 + t) * (a + b)``, so a token at
  position i can only be the first that two sets share if as many tokens are left behind it in both; the rest of the
  list is skipped. Lists with equal members are one list.
* *between answers*: one member of a list, its hub, is compared with every other; members that its answer already
  links need no comparison with one another. Only members that stay outside the hub's component are then compared with
  the rest of their list, and only with those that the known differences of both from the hub leave possible, so no
  list yields all its pairs. Members are compared with the hub that most of their lists name first, and with others
  only if that leaves them apart.

Before two whole sets meet, their signatures do: bitmaps of the parities of hashed counts, a few bytes per shingle of
the smaller set. They bound the symmetric difference from below, so no link is lost, and nearly all pairs that share a
token by chance end there. Lists of tokens that very many sets hold are cut by member into parts with hubs of their
own, and these hubs meet under the first of them.

Sets are told apart by 128 bits; classes are numbered. Broadcast are only the order's table of frequent hashes, at most
``FREQUENT`` entries of 24 bytes (any such table gives the same links, as it only sets the order of tokens and the
parts of lists), and the ids of documents whose whole sets are needed, if they are at most ``BROADCAST_IDS``; more of
them meet the texts in a shuffled join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textaxis.llm.frequent import most_frequent
from textaxis.llm.words import Ranges, lean, mix, word_slices
from textaxis.operators.graph import connected_components
from textaxis.session import materialize, release, scratch

U = np.uint64
FREQUENT = 1 << 19
#: Shingles that a task counts at a time when it looks for frequent ones, and the least count it reports.
COUNT_ROWS, LOCAL_COUNT = 2_000_000, 2
#: Prefix tokens that a task packs at a time.
PACKED = 250_000
#: Tokens that one bucket of the index should hold.
BUCKET_TOKENS = 1 << 19
_SALT1, _SALT2 = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)

#: Members of a frequent token's list that go to one part of it.
PART_MEMBERS = 1 << 17
#: Most bits of a signature; beyond as many shingles it only prunes less.
SIGNATURE_BITS = 1 << 17
BROADCAST_IDS = 1 << 20
#: Bounds of the bands of differences from a hub.
BANDS = (0, 4, 16, 64, 256, 1024, 4096, 16384)

_SETS = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
                   ("sig", pa.binary())])
_BLOBS = pa.schema([("bucket", pa.int64()), ("data", pa.binary())])
_LISTS = pa.schema([("list_id", pa.int64()), ("hub", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()),
                    ("star", pa.bool_()), ("split", pa.bool_())])
_FULL = pa.schema([("node", pa.int64()), ("hashes", pa.binary())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("low", pa.int64()), ("near", pa.bool_())])
_COMPARED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("apart", pa.int64()), ("linked", pa.bool_())])


def shingle_sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct n-gram hashes of each text that has a word; lower-cases A-Z."""
    for lo, hi, row, h in word_slices(batch, "text", lower=True):
        if not len(h):
            continue
        ranges = Ranges(h)
        grams = ranges.rolling(words)
        count = np.bincount(row, minlength=hi - lo)
        first = np.cumsum(count) - count
        short = np.flatnonzero((count > 0) & (count < words))
        alone = dict(zip(short.tolist(), ranges.of(first[short], first[short] + count[short]).tolist(), strict=True))
        for i, (a, n) in enumerate(zip(first.tolist(), count.tolist(), strict=True)):
            if n >= words:
                s = np.sort(grams[a:a + n - words + 1])
                yield lo + i, s[np.r_[True, s[1:] != s[:-1]]]
            elif n:
                yield lo + i, np.array([alone[i]], U)


def _keys(s: np.ndarray) -> tuple[int, int]:
    pair = mix(s ^ _SALT1).sum(dtype=U), mix(s ^ _SALT2).sum(dtype=U)
    return tuple(np.array(pair, U).view(np.int64).tolist())


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def signature(s: np.ndarray) -> bytes:
    """Parities of the number of hashes in each of 2**k bins, 2**k >= the size of the set; k can be lowered by XOR."""
    bits = min(SIGNATURE_BITS, max(64, 1 << (len(s) - 1).bit_length()))
    odd = np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _summaries(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        rows = 0

        def frequent() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held) if held else np.zeros(0, U), return_counts=True)
            u, c = u[c >= LOCAL_COUNT], c[c >= LOCAL_COUNT]
            blank = pa.nulls(len(u), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(u), np.int8)), blank, pa.array(c), pa.array(_signed(u)), blank, pa.nulls(len(u), pa.binary())], schema=_SETS)

        for batch in batches:
            n = np.zeros(len(batch), np.int64)
            k = np.zeros((2, len(batch)), np.int64)
            sig: list[bytes | None] = [None] * len(batch)
            for i, s in shingle_sets(batch, words):
                n[i] = len(s)
                k[:, i] = keys = _keys(s)
                sig[i] = signature(s)
                if keys[0] not in seen:
                    seen.add(keys[0])
                    held.append(s)
                    rows += len(s)
                    if rows > COUNT_ROWS:
                        yield frequent()
                        held.clear()
                        rows = 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(batch), np.int8)), batch.column("doc_id"), pa.array(n), pa.array(k[0]), pa.array(k[1]), pa.array(sig, pa.binary())],
                schema=_SETS)
        yield frequent()

    return run


def prefix_length(n: int, t: tuple[int, int]) -> int:
    """Tokens that must hold a common one for a similarity of t[0]/t[1]."""
    return n + (-t[0] * n // t[1]) + 1


def _ordered(s: np.ndarray, frequent) -> tuple[np.ndarray, np.ndarray]:
    """A set's hashes in the global order, and in how many parts each one's list is cut."""
    hot, rank, parts = frequent
    one = np.ones(len(s), np.uint64)
    if not len(hot):
        return s, one
    j = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
    often = hot[j] == s
    if not often.any():
        return s, one
    at = j[often]
    order = np.argsort(rank[at])
    return np.concatenate([s[~often], s[often][order]]), np.concatenate([one[:len(s) - len(at)], parts[at][order]])


def _prefixes(words: int, t: tuple[int, int], frequent, buckets: int):
    """Prefix tokens, packed by bucket: the lower half of the token, the set's first key, its size and the position.

    A token of a list in parts goes to the bucket of the set's part; its position is then stored as -1 - position.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(tokens: list, cut: list, ids: list, sizes: list) -> pa.RecordBatch:
            each = np.array([len(x) for x in tokens])
            pos = np.arange(each.sum(), dtype=np.int32) - np.repeat(np.cumsum(each) - each, each).astype(np.int32)
            tok, parts = np.concatenate(tokens), np.concatenate(cut)
            own = np.repeat(np.array(ids, np.int64), each)
            size = np.repeat(np.array(sizes, np.int32), each)
            part = mix(own.view(U)) % parts
            bucket = (((tok >> U(32)) + part) % U(buckets)).astype(np.int64)
            pos = np.where(parts > U(1), -1 - pos, pos)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True])
            data = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                o = order[a:b]
                data.append(tok[o].astype(np.uint32).tobytes() + own[o].tobytes() + size[o].tobytes() + pos[o].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(bucket[order[cuts[:-1]]]), pa.array(data, pa.binary())], schema=_BLOBS)

        seen: set[tuple[int, int]] = set()
        held: tuple[list, ...] = ([], [], [], [])
        many = 0
        for batch in batches:
            for _, s in shingle_sets(batch, words):
                key = _keys(s)
                if key in seen:
                    continue
                seen.add(key)
                long = prefix_length(len(s), t)
                ordered, parts = _ordered(s, frequent.value)
                for column, x in zip(held, (ordered[:long].copy(), parts[:long].copy(), key[0], len(s)), strict=True):
                    column.append(x)
                many += long
                if many > PACKED:
                    yield packed(*held)
                    held, many = ([], [], [], []), 0
        if many:
            yield packed(*held)

    return run


def needed(na, nb, t: tuple[int, int]):
    """The overlap that sets of sizes na and nb need."""
    return -(-t[0] * (na + nb) // (t[0] + t[1]))


def fits(na, pa_, nb, pb, t: tuple[int, int]):
    """Whether sets of sizes na and nb whose first common token is at pa_ and pb can be similar enough."""
    need = needed(na, nb, t)
    return (na - pa_ >= need) & (nb - pb >= need) & (np.minimum(na, nb) >= need)


def _lists(t: tuple[int, int]):
    def run(key, table):
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for x in table.column("data"):
            raw = x.as_buffer()
            n = len(raw) // 20
            at = 0
            for k, kind in enumerate((np.uint32, np.int64, np.int32, np.int32)):
                parts[k].append(np.frombuffer(raw, kind, n, at))
                at += n * np.dtype(kind).itemsize
        tok = np.concatenate(parts[0])
        order = np.argsort(tok, kind="stable")
        s = tok[order]
        same = s[1:] == s[:-1]
        split = np.concatenate(parts[3])[order] < 0  # these lists go on in other buckets
        order = order[np.r_[same, False] | np.r_[False, same] | split]
        tok, own, size, pos = tok[order], *(np.concatenate(p)[order] for p in parts[1:])
        split, pos = pos < 0, np.where(pos < 0, -1 - pos, pos)
        # The hub of a list is the member with the fewest rarer tokens of its own: of members that share what is behind
        # the token, it links with each that links with any other.
        order = np.lexsort((own, size, pos, tok))
        tok, own, size, pos, split = tok[order], own[order], size[order], pos[order], split[order]
        fresh = np.r_[True, (tok[1:] != tok[:-1]) | (own[1:] != own[:-1]) | (size[1:] != size[:-1])][:len(tok)]  # copies from several tasks
        tok, own, size, pos, split = tok[fresh], own[fresh], size[fresh], pos[fresh], split[fresh]
        cuts = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1], True]) if len(tok) else np.zeros(1, int)
        known: dict[tuple, list] = {}
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            whole = not split[a]
            if b - a < 2 and whole:
                continue
            named = (own[a:b].tobytes(), size[a:b].tobytes(), -1 if whole else int(tok[a]))
            if (old := known.get(named)) is None:
                known[named] = [own[a:b], size[a:b], pos[a:b]]
            else:
                old[2] = np.minimum(old[2], pos[a:b])
        out: list[list[np.ndarray]] = [[] for _ in _LISTS]
        for i, ((_, _, token), (m, n, p)) in enumerate(known.items()):
            star = fits(n[0], p[0], n, p, t)
            if len(m) == 2 and token < 0 and not star[1]:
                continue
            star[0] = False
            number = (int(key[0].as_py()) << 32) + i if token < 0 else -1 - token
            for column, x in zip(out, (np.full(len(m), number), np.full(len(m), m[0]), m, n, p, star, np.full(len(m), token >= 0)), strict=True):
                column.append(x)
        arrays = [pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(out, _LISTS, strict=True)]
        return pa.Table.from_arrays(arrays, schema=_LISTS)

    return run


def _full_sets(words: int):
    """The set of each asked class: rows are texts with the class's number and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, k1, k2 = (batch.column(c).to_pylist() for c in ("node", "k1", "k2"))
            nodes, data, held = [], [], 0
            for i, s in shingle_sets(batch, words):
                if _keys(s) != (k1[i], k2[i]):  # another text under the same doc_id
                    continue
                nodes.append(node[i])
                data.append(s.tobytes())
                held += len(data[-1])
                if held > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(data, pa.binary())], schema=_FULL)
                    nodes, data, held = [], [], 0
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(data, pa.binary())], schema=_FULL)

    return run


def _folded(column: pa.Array, at: np.ndarray, wide: int, to: int) -> np.ndarray:
    rows = np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1, to)
    return np.bitwise_xor.reduce(rows, axis=1) if wide > to else rows[:, 0]


def _near(t: tuple[int, int]):
    """Pairs with the least difference that their signatures leave (``low``), and whether a link is left possible.

    Signatures of two widths meet in the smaller one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("sig_a"), batch.column("sig_b")
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            wide = np.stack([pc.binary_length(c).to_numpy() for c in (x, y)])
            most = na + nb - 2 * needed(na, nb, t)
            low = np.abs(na - nb)
            for a, b in np.unique(wide, axis=1).T.tolist():
                at = np.flatnonzero((wide[0] == a) & (wide[1] == b))
                apart = _folded(x, at, a, min(a, b)) ^ _folded(y, at, b, min(a, b))
                low[at] = np.maximum(low[at], np.bitwise_count(apart).sum(axis=1, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "n")), pa.array(low), pa.array(low <= most)], schema=_PAIRS)

    return run


def _compare(t: tuple[int, int]):
    """How many hashes stand in one of two whole sets only, and whether the sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart, linked = np.zeros(len(batch), np.int64), np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                both = np.concatenate([np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)])
                size = len(both)
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                apart[i], linked[i] = size - 2 * common, t[1] * common >= t[0] * (size - common)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(apart), pa.array(linked)], schema=_COMPARED)

    return run


def _candidates(pairs: DataFrame, nodes: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Pairs of first keys ``(a, b, n)`` as pairs of class numbers, with what ``_near`` says of them."""
    x = nodes.select(F.col("k1").alias("b"), F.col("node").alias("node_b"), F.col("n").alias("nb"), F.col("sig").alias("sig_b"))
    y = nodes.select(F.col("k1").alias("a"), F.col("node").alias("node_a"), F.col("n").alias("na"), F.col("sig").alias("sig_a"))
    met = pairs.join(x, "b").join(y, "a").where("node_a <> node_b")
    met = met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"),
                     F.when(F.col("node_a") < F.col("node_b"), F.col("na")).otherwise(F.col("nb")).alias("na"),
                     F.when(F.col("node_a") < F.col("node_b"), F.col("nb")).otherwise(F.col("na")).alias("nb"),
                     F.when(F.col("node_a") < F.col("node_b"), F.col("sig_a")).otherwise(F.col("sig_b")).alias("sig_a"),
                     F.when(F.col("node_a") < F.col("node_b"), F.col("sig_b")).otherwise(F.col("sig_a")).alias("sig_b"), "n")
    return met.mapInArrow(lean(_near(t)), "a long, b long, n long, low long, near boolean")


def _compared(pairs: DataFrame, known: DataFrame, nodes: DataFrame, words: int, t: tuple[int, int]) -> DataFrame:
    """``pairs`` (a, b) with how far their whole sets are apart; only the texts of these pairs are read again."""
    ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    asked = nodes.join(ids, "node", "left_semi").select(F.col("first").alias("doc_id"), "node", "k1", "k2")
    if asked.count() <= BROADCAST_IDS:
        asked = F.broadcast(asked)
    sets = known.join(asked, "doc_id").select("node", "k1", "k2", "text").mapInArrow(lean(_full_sets(words)), "node long, hashes binary")
    sets = materialize(sets.dropDuplicates(["node"]), "fullsets")
    x = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    y = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    links = materialize(pairs.select("a", "b").join(x, "b").join(y, "a").select("a", "b", "x", "y").mapInArrow(lean(_compare(t)), "a long, b long, apart long, linked boolean"), "compared")
    release(sets)
    return links


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 75, part_members: int = PART_MEMBERS) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row of ``docs`` (doc_id, text; other columns are ignored).

    Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their distinct ``words``-grams of lower-cased
    words; a text with fewer words has its whole sequence as its one shingle. The component is the smallest doc_id
    reachable. A text without words, or null, has size 0 and stays alone. A row without doc_id has a null component
    and links to nothing. Repeated rows each get a row; rows of one doc_id with different texts link by their texts
    only. Texts of any length are taken whole; an empty table gives no row. ``part_members`` bounds the part of a
    frequent token's list that one task holds; it changes no result.
    """
    t = (percent, 100)
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.where("doc_id is not null")
    with scratch(spark) as keep:
        found = materialize(docs.mapInArrow(lean(_summaries(words)), "kind byte, doc_id long, n long, k1 long, k2 long, sig binary"), "sets")
        rows = found.where("kind = 0").select("doc_id", "n", "k1", "k2")
        classes = materialize(
            found.where("kind = 0 and n > 0 and doc_id is not null").groupBy("k1", "k2")
            .agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("sig").alias("sig"))
            .withColumn("node", F.monotonically_increasing_id()), "classes")
        often = most_frequent(found.where("kind = 1").groupBy("k1").agg(F.sum("n").alias("n")), "k1", "n", FREQUENT)
        often = often.sort_values(["n", "k1"], ascending=[True, True])  # the most frequent comes last
        hot = often["k1"].to_numpy(np.int64).view(U)
        o = np.argsort(hot)
        pieces = 1 + often["n"].to_numpy(np.int64) // part_members
        frequent = spark.sparkContext.broadcast((hot[o], np.arange(len(hot))[o], pieces.astype(U)[o]))
        tokens = rows.agg(F.sum("n")).first()[0] or 0
        buckets = max(256, int(tokens * (1 - t[0] / t[1])) // BUCKET_TOKENS)

        blobs = known.select("text").mapInArrow(lean(_prefixes(words, t, frequent, buckets)), "bucket long, data binary")
        shape = "list_id long, hub long, id long, n int, pos int, star boolean, split boolean"
        lists = materialize(blobs.groupBy("bucket").applyInArrow(_lists(t), shape), "lists")
        nodes = materialize(classes.join(lists.select(F.col("id").alias("k1")).distinct(), "k1", "left_semi"), "nodes")

        # Of all hubs that a set meets, the one it meets most often answers first.
        met = lists.where("id <> hub").groupBy(F.col("hub").alias("a"), F.col("id").alias("b")).agg(F.count_if("star").alias("n"))
        if (pieces > 1).any():  # the hubs of a list's parts meet under the first of them
            heads = lists.where("split and id = hub").select("list_id", "hub", "pos", "n").distinct()
            first = heads.groupBy("list_id").agg(F.min(F.struct("pos", "n", "hub")).alias("a")).select("list_id", F.col("a.hub").alias("a"))
            met = met.unionByName(heads.join(first, "list_id").where("hub <> a").groupBy("a", F.col("hub").alias("b")).agg(F.count("*").alias("n")))
            lists = lists.join(first, "list_id", "left").withColumn("hub", F.coalesce("a", "hub")).drop("a")
        met = materialize(_candidates(met, nodes, t), "met")
        near = met.where("near and n > 0")
        both = near.select("a", "b", "n").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
        best = both.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a"))
        best = materialize(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "best")
        stars = _compared(best, known, nodes, words, t)
        links = stars.where("linked").select("a", "b")
        part = materialize(connected_components(links).select(F.col("id").alias("node"), F.col("component").alias("part")), "parts")

        # What these answers leave open: other hubs that a set may link to, and members that are outside the component
        # of their list's hub, which meet the rest of that list.
        def named(c: str) -> DataFrame:
            return part.select(F.col("node").alias(c), F.col("part").alias(f"part_{c}"))

        def apart(pairs: DataFrame) -> DataFrame:
            placed = pairs.join(named("a"), "a", "left").join(named("b"), "b", "left")
            return placed.where("coalesce(part_a, a) <> coalesce(part_b, b)").select("a", "b")

        at = nodes.join(part, "node", "left").select("k1", "node", F.coalesce("part", "node").alias("part"), F.col("n").alias("size"))
        own = lists.join(at.drop("size").withColumnRenamed("k1", "id"), "id")
        own = own.join(at.select(F.col("k1").alias("hub"), F.col("node").alias("hub_node"), F.col("part").alias("hub_part"), F.col("size").alias("hub_n")), "hub")
        own = materialize(own.join(own.where("part <> hub_part").select("list_id").distinct(), "list_id", "left_semi"), "open")
        bounds = met.groupBy("a", "b").agg(F.max("low").alias("low")).join(stars.where("linked").groupBy("a", "b").agg(F.min("apart").alias("high")), ["a", "b"], "left")
        own = (
            own.withColumn("a", F.least("node", "hub_node")).withColumn("b", F.greatest("node", "hub_node")).join(bounds, ["a", "b"], "left")
            .withColumn("high", F.when(F.col("node") == F.col("hub_node"), F.lit(0)).otherwise(F.col("high")))
            .withColumn("low", F.greatest(F.coalesce("low", F.lit(0)), F.abs(F.col("n") - F.col("hub_n"))))
        )
        # A member at most ``high`` from the hub and one at least ``low`` from it are at least ``low - high`` apart, so
        # members near the hub and members far from it never meet: members are banded by ``high``, and an outsider asks
        # the bands that it may have a link in.
        band = F.coalesce(*[F.when(F.col("high") <= edge, F.lit(i)) for i, edge in enumerate(BANDS)], F.lit(len(BANDS)))
        widest = F.floor(F.col("n") * (t[1] - t[0]) / t[0])  # a link's difference is at most this share of the smaller set, and more of the larger
        asks = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(edge).alias("edge")) for i, edge in enumerate((*BANDS, 1 << 40))]),
                        lambda e: e["edge"] >= F.col("low") - widest)
        outside = own.where("part <> hub_part").withColumn("ask", F.explode(asks))
        outside = outside.select("list_id", F.col("ask.i").alias("band"), *[F.col(c).alias(f"r_{c}") for c in ("id", "n", "pos", "part", "low", "high")])
        inside = own.where("id <> hub or split").withColumn("band", band)
        need = f"((({t[0]} * (n + r_n)) + {t[0] + t[1] - 1}) div {t[0] + t[1]})"
        cross = (
            inside.join(outside, ["list_id", "band"])
            .where("part <> r_part and (part = hub_part or id < r_id)")
            .where(f"n - pos >= {need} and r_n - r_pos >= {need} and least(n, r_n) >= {need}")
            .where(f"(high is null or r_low - high <= n + r_n - 2 * {need}) and (r_high is null or low - r_high <= n + r_n - 2 * {need})")
            .select(F.least("id", "r_id").alias("a"), F.greatest("id", "r_id").alias("b")).distinct()
        )
        cross = materialize(_candidates(cross.withColumn("n", F.lit(1).cast("long")), nodes, t).where("near"), "cross")
        left = apart(near).unionByName(apart(cross)).distinct().join(best, ["a", "b"], "left_anti")
        left = materialize(left, "left")
        if not left.isEmpty():
            links = links.unionByName(_compared(left, known, nodes, words, t).where("linked").select("a", "b"))
        whole = connected_components(links)

        named_whole = classes.join(whole, F.col("node") == F.col("id"), "left").withColumn("c", F.coalesce("component", "node"))
        least = named_whole.where("component is not null").groupBy("c").agg(F.min("first").alias("least"))
        labels = named_whole.join(least, "c", "left").select("k1", "k2", F.coalesce("least", "first").alias("component_id"))
        real = rows.where("n > 0 and doc_id is not null").join(labels, ["k1", "k2"])
        rest = rows.where("n = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
        columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
        return keep(materialize(real.select(*columns).unionByName(rest.select(*columns)), "components"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the smallest doc_id stays.

    Rows without words or without doc_id stay. Of repeated rows with one doc_id all stay, as they are one document.
    """
    gone = jaccard_components(docs, words, percent).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
