"""Exact medians by narrowing, and content at a version over deletes and renames."""

import random
import statistics

from pyspark.sql import functions as F

from weftline.operators import quantiles, versions


def test_median_against_sorting(spark):
    rng = random.Random(3)
    cases = [[], [None], [5.0], [1.0, 2.0], [7.0] * 300, [rng.gauss(0, 1e6) for _ in range(301)], [1.0] * 100 + [2.0] * 100, [float(rng.randint(0, 5)) for _ in range(400)], [1e-9 * i for i in range(200)] + [1e12]]
    for values in cases:
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
        known = [v for v in values if v is not None]
        assert quantiles.median(df, "x", bars=4, few=10) == (statistics.median(known) if known else None)
    assert quantiles.median(spark.range(100_001).select(F.col("id").alias("x")), "x", bars=16, few=100) == 50_000.0


def plain(changes, path, at, depth=0):
    """Content and origin of a path at a time, by replaying the log."""
    state = {}
    for p, time, kind, content, old in changes:
        if time > at:
            break
        if kind == "D":
            state.pop(p, None)
        elif kind == "R":
            state[p] = (content, p) if content is not None else state.get(old)
            state.pop(old, None)
        else:
            state[p] = (content, p)
    return state.get(path)


def test_content_at_versions(spark):
    log = [("a", 1, "A", "one", None), ("a", 2, "M", "two", None), ("b", 3, "R", None, "a"), ("a", 4, "A", "new a", None), ("c", 5, "R", None, "b"), ("c", 6, "M", "three", None), ("d", 7, "R", "edited", "c"), ("a", 8, "D", None, None), ("a", 9, "A", "back", None), ("b", 10, "R", None, "a"), ("a", 11, "R", None, "b")]
    changes = spark.createDataFrame(log, "path string, time long, kind string, content string, old_path string")
    asked = [(p, t) for p in "abcdx" for t in range(0, 13)]
    got = {(r.path, r.at): (r.content, r.origin) for r in versions.content_at(changes, spark.createDataFrame(asked, "path string, at long")).collect()}
    assert got == {k: v for k in asked if (v := plain(log, *k)) is not None}
