"""Axis vectors from contrasting groups, projection of items on them, prototypes, and checks of the geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textaxis.functions import vectors as V
from textaxis.operators.stats import auc
from textaxis.session import materialize

#: Prototypes that are broadcast at a time.
PROTOTYPES = 4096


def mean_vector(rows: DataFrame, by: list[str], vec: str, weight: str | None = None, out: str = "vec") -> DataFrame:
    """Elementwise mean of the vectors of each group, weighted if asked (weights under 1e-12 count as that).

    Places are averaged as rows, partially before the shuffle; only one row per group and place is gathered.
    """
    w = F.lit(1.0) if weight is None else F.greatest(F.col(weight), F.lit(1e-12))
    long = rows.select(*by, w.alias("__w"), F.posexplode(V.as_double(F.col(vec))).alias("__i", "__x"))
    means = long.groupBy(*by, "__i").agg((F.sum(F.col("__x") * F.col("__w")) / F.sum("__w")).alias("__m"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"]).alias(out)
    return means.groupBy(*by).agg(packed)


def weighted_axis(rows: DataFrame, by: list[str], vec: str, weight: str, out: str = "axis") -> DataFrame:
    """The unit vector along the weighted mean of each group's vectors; a group whose mean is zero raises."""
    return mean_vector(rows, by, vec, weight).select(*by, V.unit(F.col("vec")).alias(out))


def mean_difference_axis(rows: DataFrame, vec: str, positive: Column, normalize_first: bool = False) -> DataFrame:
    """One row ``axis``: the unit difference of the positive and negative means."""
    x = V.unit(F.col(vec)) if normalize_first else F.col(vec)
    means = mean_vector(rows.select(positive.alias("pole"), x.alias("v")), ["pole"], "v")
    both = means.agg(F.max(F.when(F.col("pole"), F.col("vec"))).alias("p"), F.max(F.when(~F.col("pole"), F.col("vec"))).alias("n"))
    return both.select(V.unit(V.subtract(F.col("p"), F.col("n"))).alias("axis"))


def sign_convention(axis: Column, mean_positive: Column, mean_negative: Column) -> Column:
    """The axis, turned round if the positive pole projects lower."""
    return F.when(mean_positive < mean_negative, V.scaled(axis, -1.0)).otherwise(axis)


def logistic_axis(rows: DataFrame, vec: str, positive: Column, c: float = 1.0, iterations: int = 200) -> DataFrame:
    """One row ``axis``: the unit coefficients of an L2 logistic regression (the solver leaves the intercept free)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector(V.as_double(F.col(vec))).alias("features"), positive.cast("double").alias("label"))
    model = LogisticRegression(regParam=1.0 / (c * max(1, data.count())), elasticNetParam=0.0, standardization=False, maxIter=iterations).fit(data)
    w = [float(x) for x in model.coefficients]
    return rows.sparkSession.createDataFrame([(w,)], "axis array<double>").select(V.unit(F.col("axis")).alias("axis"))


def project(rows: DataFrame, vec: str, axes: dict[str, DataFrame], metric: str = "cosine") -> DataFrame:
    """A score per axis; 'cosine' divides by the item's norm, 'dot' doesn't. The two are never mixed.

    Each axis is one row, so its cross join adds no row and is a broadcast of one vector.
    """
    if metric not in ("cosine", "dot"):
        raise ValueError(metric)
    out = rows.withColumn("__u", V.unit(F.col(vec)) if metric == "cosine" else V.as_double(F.col(vec)))
    for name, axis in axes.items():
        out = out.join(F.broadcast(axis.select(F.col("axis").alias("__axis"))))
        out = out.withColumn(name, V.dot(F.col("__u"), F.col("__axis"))).drop("__axis")
    return out.drop("__u")


def scored_items(items: DataFrame, vec: str, label: str) -> DataFrame:
    """Items with economic and social scores on axes made from the contrast of their labels, quadrant and margin."""
    econ = mean_difference_axis(items, vec, F.col(label) >= 5, True)
    social = mean_difference_axis(items, vec, F.col(label) % 2 == 0, True)
    got = project(items, vec, {"score_econ": econ, "score_soc": social})
    return got.withColumn("quadrant", V.quadrant(F.col("score_econ"), F.col("score_soc"))).withColumn("margin", V.confidence_margin(F.col("score_econ"), F.col("score_soc")))


def nearest_prototypes(items: DataFrame, key: str, vec: str, prototypes: DataFrame, name: str, proto: str, most: int = PROTOTYPES) -> DataFrame:
    """``(key, topic_primary, topic_primary_score, topic_secondary, topic_secondary_score)`` by cosine.

    The prototypes are counted first. Up to ``most`` are gathered into one array value, so items are scored in place without
    a pair row each. More are taken in blocks of ``most``, each a matrix that is broadcast for one scan of the items; a scan
    keeps two of each item. Without prototypes the topic is 'other' with score 0. Ties go to the smaller name. ``key`` tells
    items apart; items with a null vector are left out where there are several blocks, and have null scores where there is one.
    """
    named = prototypes.select(F.col(name).cast("string").alias("name"), V.unit(F.col(proto), 1e-12).alias("v"))
    if named.count() > most:
        return _nearest_in_blocks(items, key, vec, named, most)
    table = named.agg(F.array_sort(F.collect_list(F.struct("name", "v"))).alias("__p"))
    u = V.unit(F.col(vec), 1e-12)
    scored = items.select(key, u.alias("__u")).join(F.broadcast(table))
    each = F.transform("__p", lambda p: F.struct((-V.dot(F.col("__u"), p["v"])).alias("s"), p["name"].alias("name")))
    return _two_best(scored.select(key, F.array_sort(each).alias("__b")), key)


def _two_best(best: DataFrame, key: str) -> DataFrame:
    """Topics from ``__b``, sorted structs of the negative score ``s`` and the ``name``."""
    at = lambda i: F.get("__b", F.lit(i))
    return best.select(
        key, F.coalesce(at(0)["name"], F.lit("other")).alias("topic_primary"), F.coalesce(-at(0)["s"], F.lit(0.0)).alias("topic_primary_score"),
        at(1)["name"].alias("topic_secondary"), (-at(1)["s"]).alias("topic_secondary_score"))


def _nearest_in_blocks(items: DataFrame, key: str, vec: str, named: DataFrame, most: int) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    from textaxis.operators.ranking import ordered

    spark = items.sparkSession
    numbered = materialize(ordered(named.withColumn("__tie", F.xxhash64("v")), [], ["name", "__tie"], "at"), "prototypes")
    units = items.where(F.col(vec).isNotNull()).select(F.col(key).alias("k"), V.unit(F.col(vec), 1e-12).alias("u"))
    shape = f"k {items.schema[key].dataType.simpleString()}, b array<struct<s: double, name: string>>"
    parts = []
    for number in range(-(-numbered.count() // most)):
        block = numbered.where((F.col("at") >= number * most) & (F.col("at") < (number + 1) * most)).orderBy("at").toPandas()  # at most ``most`` rows
        sent = spark.sparkContext.broadcast((block["name"].tolist(), np.stack(block["v"].to_numpy()).astype(float)))

        def score(batches, sent=sent):
            names, matrix = sent.value
            for batch in batches:
                if not len(batch):
                    continue
                u = batch.column("u").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                s = -(u @ matrix.T)
                two = np.lexsort((np.broadcast_to(np.arange(len(names)), s.shape), s), axis=1)[:, :2]  # names ascend
                rows = [[{"s": float(s[i, j]), "name": names[j]} for j in two[i]] for i in range(len(batch))]
                yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(rows, pa.list_(pa.struct([("s", pa.float64()), ("name", pa.string())])))], names=["k", "b"])

        parts.append(units.mapInArrow(score, shape))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    best = every.groupBy(F.col("k").alias(key)).agg(F.array_sort(F.flatten(F.collect_list("b"))).alias("__b"))  # two for each block
    return _two_best(best, key)


def layer_quality(accuracy: Column, separation: Column) -> Column:
    """0.6 * accuracy + 0.4 * min(separation / 2, 1)."""
    return accuracy * 0.6 + F.least(separation / 2, F.lit(1.0)) * 0.4


def combined_projection(layers: DataFrame, item: str, layer: str, vec: str, axes: DataFrame, weight: str | None = None) -> DataFrame:
    """Sum over layers of the weighted dot with each layer's unit axis; ``axes`` has layer, axis and the weight."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    joined = layers.join(F.broadcast(axes), layer)
    return joined.groupBy(item).agg(F.sum(w * V.dot(F.col(vec), V.unit(F.col("axis"), 1e-12))).alias("score"))


def cross_separation(scores: DataFrame, axes: list[str], poles: dict[str, Column]) -> DataFrame:
    """Cohen's d of every axis's score between the poles of every contrast: a matrix as rows."""
    parts = [F.struct(F.lit(a).alias("axis"), F.lit(c).alias("contrast"), F.col(a).alias("x"), p.alias("p")) for a in axes for c, p in poles.items()]
    long = scores.select(F.inline(F.array(*parts)))
    pos, neg = F.when(F.col("p"), F.col("x")), F.when(~F.col("p"), F.col("x"))
    d = (F.avg(pos) - F.avg(neg)) / (F.sqrt((F.var_samp(pos) + F.var_samp(neg)) / 2) + 1e-12)
    return long.groupBy("axis", "contrast").agg(d.alias("cohens_d"))


def leave_one_group_out(rows: DataFrame, vec: str, positive: str, group: str) -> DataFrame:
    """AUC of each group on an axis made from all other groups; rows without a group always train, never test."""
    groups = rows.where(F.col(group).isNotNull()).select(F.col(group).alias("held")).distinct()
    train = rows.join(F.broadcast(groups), ~F.col(group).eqNullSafe(F.col("held")))  # groups are few; each row trains groups - 1 axes
    means = mean_vector(train.select("held", F.col(positive).alias("pole"), F.col(vec).alias("v")), ["held", "pole"], "v")
    axis = means.groupBy("held").agg(F.max(F.when(F.col("pole"), F.col("vec"))).alias("p"), F.max(F.when(~F.col("pole"), F.col("vec"))).alias("n"))
    axis = axis.select("held", V.unit(V.subtract(F.col("p"), F.col("n")), 1e-12).alias("axis"))
    test = rows.join(F.broadcast(axis), F.col(group) == F.col("held")).withColumn("s", V.dot(F.col(vec), F.col("axis")))
    return auc(test, "s", positive, ["held"])


def kfold_auc(rows: DataFrame, vec: str, positive: str, fold: str) -> DataFrame:
    """AUC of pooled held-out scores; every fold is scored on the axis of the others."""
    ks = rows.select(F.col(fold).alias("held")).distinct()
    train = rows.join(F.broadcast(ks), F.col(fold) != F.col("held"))
    means = mean_vector(train.select("held", F.col(positive).alias("pole"), F.col(vec).alias("v")), ["held", "pole"], "v")
    axis = means.groupBy("held").agg(F.max(F.when(F.col("pole"), F.col("vec"))).alias("p"), F.max(F.when(~F.col("pole"), F.col("vec"))).alias("n"))
    axis = axis.select("held", V.unit(V.subtract(F.col("p"), F.col("n")), 1e-12).alias("axis"))
    test = rows.join(F.broadcast(axis), F.col(fold) == F.col("held")).withColumn("s", V.dot(F.col(vec), F.col("axis"))).withColumn("all", F.lit("all"))
    return auc(test, "s", positive, ["all"])


def random_direction_null(rows: DataFrame, vec: str, positive: str, width: int, reps: int = 500, seed: int = 0) -> DataFrame:
    """Mean, 95th percentile and maximum of |Cohen's d| on random directions.

    The directions are drawn once from the seed; every batch of rows adds to their sums and squares, which are all
    that is shuffled (one row of ``reps`` numbers per task and pole).
    """
    import numpy as np

    directions = np.random.default_rng(seed).normal(size=(width, reps))
    directions /= np.linalg.norm(directions, axis=0)

    def partial(batches):
        import pandas as pd

        for pdf in batches:
            for pole, part in pdf.groupby("pole"):
                x = np.stack(part["v"].to_list()).astype(float) @ directions
                yield pd.DataFrame({"pole": [bool(pole)], "n": [len(x)], "s": [x.sum(axis=0).tolist()], "q": [(x * x).sum(axis=0).tolist()]})

    parts = rows.select(F.col(positive).alias("pole"), F.col(vec).alias("v")).mapInPandas(partial, "pole boolean, n long, s array<double>, q array<double>")
    sums = parts.select("pole", "n", F.posexplode(F.arrays_zip("s", "q")).alias("rep", "z")).groupBy("pole", "rep").agg(F.sum("n").alias("n"), F.sum("z.s").alias("s"), F.sum("z.q").alias("q"))
    stats = sums.select("pole", "rep", (F.col("s") / F.col("n")).alias("m"), ((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)).alias("v"))
    d = stats.groupBy("rep").agg(((F.max(F.when(F.col("pole"), F.col("m"))) - F.max(F.when(~F.col("pole"), F.col("m")))) / F.sqrt(F.sum("v") / 2)).alias("d"))
    return d.agg(F.count("*").alias("reps"), F.avg(F.abs("d")).alias("mean"), F.percentile(F.abs("d"), 0.95).alias("p95"), F.max(F.abs("d")).alias("max"))


def shuffled_label_null(rows: DataFrame, vec: str, positive: str, row_key: str, width: int, reps: int = 200, seed: int = 0) -> DataFrame:
    """Cohen's d of the mean-difference axis (``real``) against axes rebuilt from shuffled labels: mean, 95th
    percentile, maximum and the one-sided p-value (hits + 1) / (reps + 1), without absolute values.

    Repetition r labels a row by the top bit of hex digit r % 32 of md5("seed:r // 32:key"), so groups are equal but for
    chance and SQL can repeat them; the true labels are one more repetition. Two passes over the rows: sums for the
    axes, then sums and squares along them. Each task sends one set of sums; the driver holds reps * width numbers,
    whatever the rows. Rows without vector or label are left out; a group without two rows gives null, as do no rows.
    """
    import numpy as np

    n_all = reps + 1

    def sides(pdf):
        """Labels, rows by repetitions, and the vectors."""
        import hashlib

        digits = [np.array([[int(c, 16) for c in hashlib.md5(f"{seed}:{b}:{k}".encode()).hexdigest()] for k in pdf["k"]]) for b in range(-(-reps // 32))]
        coins = np.concatenate([*digits, np.zeros((len(pdf), 0), int)], axis=1)[:, :reps] >= 8
        return np.column_stack([coins, pdf["p"].to_numpy(bool)]).astype(float), np.stack(pdf["v"].to_list()).astype(float)

    def sums(batches):
        import pandas as pd

        n, s = np.zeros((2, n_all)), np.zeros((2, n_all, width))
        for pdf in batches:
            if len(pdf):
                a, x = sides(pdf)
                n += [a.sum(axis=0), (1 - a).sum(axis=0)]
                s += [a.T @ x, (1 - a).T @ x]
        if n.any():
            for rep in range(n_all):
                yield pd.DataFrame({"rep": [rep] * 2, "pole": [True, False], "n": n[:, rep], "s": list(s[:, rep])})

    data = rows.where(F.col(vec).isNotNull() & F.col(positive).isNotNull()).select(F.col(row_key).cast("string").alias("k"), F.col(positive).alias("p"), F.col(vec).alias("v"))
    parts = data.mapInPandas(sums, "rep int, pole boolean, n double, s array<double>")
    means = parts.select("rep", "pole", "n", F.posexplode("s").alias("i", "x")).groupBy("rep", "i").agg(
        *[(F.sum(F.when(F.col("pole") == p, F.col("x"))) / F.nullif(F.sum(F.when(F.col("pole") == p, F.col("n"))), F.lit(0.0))).alias(c) for p, c in ((True, "a"), (False, "b"))])
    axes = np.zeros((width, n_all))
    for r in means.select("rep", "i", (F.col("a") - F.col("b")).alias("d")).where("d is not null").toLocalIterator():  # reps * width rows
        axes[r["i"], r["rep"]] = r["d"]
    lengths = np.linalg.norm(axes, axis=0)
    axes /= np.where(lengths == 0, 1.0, lengths)

    def along(batches):
        import pandas as pd

        n, s, q = np.zeros((3, 2, n_all))
        for pdf in batches:
            if len(pdf):
                a, x = sides(pdf)
                y = x @ axes
                n += [a.sum(axis=0), (1 - a).sum(axis=0)]
                s += [(y * a).sum(axis=0), (y * (1 - a)).sum(axis=0)]
                q += [(y * y * a).sum(axis=0), (y * y * (1 - a)).sum(axis=0)]
        if n.any():
            for side, pole in enumerate((True, False)):
                yield pd.DataFrame({"rep": range(n_all), "pole": pole, "n": n[side], "s": s[side], "q": q[side]})

    of = data.mapInPandas(along, "rep int, pole boolean, n double, s double, q double").groupBy("rep", "pole").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).where("n > 1")
    of = of.select("rep", "pole", (F.col("s") / F.col("n")).alias("m"), ((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)).alias("v"))
    two = of.groupBy("rep").agg(F.sum(F.when(F.col("pole"), F.col("m"))).alias("a"), F.sum(F.when(~F.col("pole"), F.col("m"))).alias("b"), F.sum("v").alias("v"))
    d = two.select("rep", ((F.col("a") - F.col("b")) / F.sqrt(F.nullif(F.col("v") / 2, F.lit(0.0)))).alias("d"))
    real, null = F.max(F.when(F.col("rep") == reps, F.col("d"))), F.when(F.col("rep") < reps, F.col("d"))
    seen = d.agg(real.alias("real"))
    return d.join(F.broadcast(seen)).agg(
        F.count(null).alias("reps"), F.first("real").alias("real"), F.avg(null).alias("mean"), F.percentile(null, 0.95).alias("p95"), F.max(null).alias("max"),
        ((F.count_if((F.col("rep") < reps) & (F.col("d") >= F.col("real"))) + 1) / (F.count(null) + 1)).alias("p"))


def method_agreement(axes: DataFrame, layer: str, a: str, b: str) -> DataFrame:
    """Each layer's cosine between the axes of two methods, and the smallest of all layers."""
    each = axes.select(layer, V.cosine(F.col(a), F.col(b), 0.0).alias("cosine"))
    return each.join(F.broadcast(each.agg(F.min("cosine").alias("min_cosine"))))


def encode_batches(rows: DataFrame, key: str, text: str, encoder, out: str = "vec", size: int = 64) -> DataFrame:
    """``(key, out)``: vectors of texts by a model call, ``encoder(list of str) -> list of vectors``, at most ``size``
    texts a call, in order of the partition. ``encoder`` is pickled to the executors and should load its model once a
    process. Null texts aren't encoded and get null."""
    kind = rows.schema[key].dataType.simpleString()

    def encode(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            vectors, asked = [None] * len(pdf), [i for i, x in enumerate(pdf["t"]) if x is not None]
            for at in range(0, len(asked), size):
                part = asked[at:at + size]
                for i, v in zip(part, encoder([pdf["t"].iloc[i] for i in part]), strict=True):
                    vectors[i] = np.asarray(v, float).tolist()
            yield pd.DataFrame({key: pdf["k"], out: vectors})

    return rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(encode, f"`{key}` {kind}, `{out}` array<double>")


def top_examples(rows: DataFrame, by: str, score: str, key: str, k: int = 5) -> DataFrame:
    """The best ``k`` of each group (a report's top-k); ties go to the smaller key."""
    w = Window.partitionBy(by).orderBy(F.desc(score), key)
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
