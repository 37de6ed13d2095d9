"""License scans by diagonal voting of word k-grams against license templates.

Rolling word k-gram hashes of all texts are joined to the templates' positions; each match votes for the diagonal
(text position minus template position). Votes are summed by document, template and diagonal, neighbouring diagonals
are merged (words added or left out shift a copy by a few diagonals), and a merged span is verified by the share of
the template's k-grams that it really holds. Phrases of two or three words are matched word by word beside that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textaxis.llm.words import NOT_ALNUM, Ranges, word_slices
from textaxis.session import materialize, scratch

# Phrases and their labels, and openings of public license texts.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc0": "dedicated to the public domain under cc0 1 0",
}
BITMAP = 1 << 20
_DOCS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, gram array<long>, pos array<long>"


def _hashes(texts: list[str]) -> list[np.ndarray]:
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    out = [np.zeros(0, np.uint64) for _ in texts]
    for lo, hi, row, h in word_slices(batch, "text", NOT_ALNUM, lower=True):
        for i in range(hi - lo):
            out[lo + i] = h[row == i]
    return out


def template_grams(templates: dict[str, str], k: int) -> list[tuple[str, int, int, int]]:
    """(label, template's k-grams, position, hash) of every template position."""
    rows = []
    for label, h in zip(templates, _hashes(list(templates.values())), strict=True):
        grams = Ranges(h).rolling(k).view(np.int64).tolist()
        rows += [(label, len(grams), i, g) for i, g in enumerate(grams)]
    return rows


def _scan(k: int, phrases: dict[str, str], bitmap: np.ndarray):
    words = _hashes(list(phrases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, row, h in word_slices(batch, "text", NOT_ALNUM, lower=True):
                n = hi - lo
                first = np.searchsorted(row, np.arange(n))
                count, least, most = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
                labels = [set() for _ in range(n)]
                for phrase, label in zip(words, phrases.values(), strict=True):
                    m = len(phrase)
                    at = np.flatnonzero(h[:len(h) - m + 1] == phrase[0]) if len(h) >= m else np.zeros(0, int)
                    for j in range(1, m):
                        at = at[h[at + j] == phrase[j]]
                    at = at[row[at] == row[at + m - 1]] if len(at) else at
                    for r, p in zip(row[at].tolist(), (at - first[row[at]]).tolist(), strict=True):
                        count[r] += 1
                        least[r] = p if least[r] < 0 else min(least[r], p)
                        most[r] = max(most[r], p)
                        labels[r].add(label)
                grams = Ranges(h).rolling(k)
                at = np.flatnonzero(bitmap[(grams >> np.uint64(44)).astype(np.int64)])
                at = at[row[at] == row[at + k - 1]]
                cut = np.searchsorted(row[at], np.arange(n + 1))
                lists = pa.array(cut, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(lo, n), pa.array(np.bincount(row, minlength=n).astype(np.int64)), pa.array(count),
                    pa.array(least, mask=least < 0), pa.array(most, mask=most < 0), pa.array([",".join(sorted(x)) for x in labels]),
                    pa.ListArray.from_arrays(lists, pa.array(grams[at].view(np.int64))),
                    pa.ListArray.from_arrays(lists, pa.array((at - first[row[at]]).astype(np.int64)))],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "gram", "pos"])

    return run


def diagonal_spans(hits: DataFrame, grams: DataFrame, k: int, band: int, percent: int) -> DataFrame:
    """Verified spans ``(rid, label, first, last, coverage)`` of ``hits`` (rid, gram, pos) on ``grams``.

    Diagonals at most ``band`` apart are one; a span counts if it holds ``percent`` of the template's k-grams.
    """
    votes = (
        hits.join(F.broadcast(grams), "gram").withColumn("diagonal", F.col("pos") - F.col("tpos"))
        .groupBy("rid", "label", "size", "diagonal")
        .agg(F.collect_set("tpos").alias("tpos"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    )
    order = Window.partitionBy("rid", "label").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > band).cast("int"), F.lit(0))
    merged = (
        votes.withColumn("apart", apart).withColumn("run", F.sum("apart").over(order))
        .groupBy("rid", "label", "size", "run")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("tpos")))).alias("held"), F.min("first").alias("first"), F.max("last").alias("last"))
    )
    return merged.where(f"100 * held >= {percent} * size").select("rid", "label", "first", (F.col("last") + k - 1).alias("last"), (F.col("held") / F.col("size")).alias("coverage"))


def scan_licenses(docs: DataFrame, k: int = 3, band: int = 4, percent: int = 60, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case. ``n_base``: places of phrases;
    ``score``: the best verified coverage of a template (at least 0.5 where a phrase stands, else 0). Labels are
    distinct, sorted and joined by commas; none is an empty string. A null text has no words. The one broadcast is
    the templates' k-grams, which are parameters of fixed size. Repeated rows and rows without doc_id each get a row;
    an empty table gives none; texts of any length are read whole, in slices; other columns are ignored.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    spark: SparkSession = docs.sparkSession
    rows = template_grams(templates, k)
    bitmap = np.zeros(BITMAP, bool)
    bitmap[(np.array([r[3] for r in rows], np.int64).view(np.uint64) >> np.uint64(44)).astype(np.int64)] = True
    grams = spark.createDataFrame(rows, "label string, size int, tpos int, gram long")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch(spark) as keep:
        found = keep(materialize(texts.mapInArrow(_scan(k, phrases, bitmap), _DOCS).withColumn("rid", F.monotonically_increasing_id()), "licenses"))
        hits = found.where("size(gram) > 0").select("rid", F.explode(F.arrays_zip("gram", "pos")).alias("h")).select("rid", "h.*")
        spans = diagonal_spans(hits, grams, k, band, percent)
        best = spans.groupBy("rid").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("coverage"), F.count("*").alias("n_spans"))
        best = keep(materialize(best, "verified"))
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    more = F.coalesce("more", F.array().cast("array<string>"))
    floor = F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)
    return found.join(best, "rid", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.round(F.greatest(floor, F.coalesce("coverage", F.lit(0.0))), 6).alias("score"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"))
