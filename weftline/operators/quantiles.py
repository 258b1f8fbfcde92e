"""Exact medians by distributed selection: histograms narrow the interval that holds the middle values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bars of a histogram, and values that are few enough to be sorted in one place.
BARS, FEW = 1024, 10_000


def median(rows: DataFrame, column: str, bars: int = BARS, few: int = FEW) -> float | None:
    """Median of a column's values, the mean of the two middle ones of an even number; null without values.

    Nulls and NaN are left out.  Each round counts values by bar of the interval that holds the middle
    ones, combined before the shuffle, and goes on with one bar; so no task and not the driver ever
    holds more than `few` values or `bars` bars.  rows should be checkpointed, as rounds read them anew.
    """
    values = rows.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    whole = values.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    n, low, high = whole["n"], whole["low"], whole["high"]
    if not n:
        return None
    first, second, inside = (n - 1) // 2, n // 2, n  # ranks of the middle values among those from low to high
    while True:
        if low == high:
            return low
        held = values.filter((F.col("v") >= low) & (F.col("v") <= high))
        if inside <= few:
            kept = sorted(r["v"] for r in held.collect())
            return (kept[first] + kept[second]) / 2
        bar = F.least(F.floor((F.col("v") - low) / (high - low) * bars), F.lit(bars - 1))
        counts = held.groupBy(bar.alias("bar")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("bar").collect()
        before = 0
        for at, found in enumerate(counts):
            if first < before + found["n"]:
                break
            before += found["n"]
        if second >= before + found["n"]:  # the middle lies between two bars
            return (found["high"] + counts[at + 1]["low"]) / 2
        first, second, inside, low, high = first - before, second - before, found["n"], found["low"], found["high"]
