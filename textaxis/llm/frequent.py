"""The most frequent keys of a table of counts, without sorting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def most_frequent(counts: DataFrame, key: str, n: str, most: int):
    """A pandas table (key, n) of at most ``most`` rows: all keys from some count on, as many as fit.

    The count comes from a histogram of a few hundred rows, so neither it nor the result grows with the table. Keys
    with counts in the last step that doesn't fit whole are left out; callers treat those as any other key.
    """
    step = F.floor(F.log2(n) * 16).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("c")).collect()
    total, least = 0, None
    for r in sorted(sizes, key=lambda r: -r["step"]):
        total += r["c"]
        if total > most:
            break
        least = r["step"]
    rows = counts.where(step >= least) if least is not None else counts.limit(0)
    return rows.select(key, n).toPandas()
