"""Coupling of components, hotspots and complexity trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.graph import checkpoint
from weftline.operators.quantiles import median


def lifted(edges: DataFrame, owner: DataFrame, weight: str = "weight") -> DataFrame:
    """Edges of items (a, b) summed over their owners' pairs; owner: item, component."""
    x, y = owner.toDF("a", "_x"), owner.toDF("b", "_y")
    rows = edges.join(x, "a").join(y, "b").filter("_x <> _y")
    return rows.groupBy(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")).agg(F.sum(weight).alias("behavioral"))


def classify(structural, behavioral, s_line, b_line):
    """Quadrant of a pair by two thresholds, each reached by equality."""
    s, b = structural >= s_line, behavioral >= b_line
    return F.when(s & b, "explicit_module").when(s, "stable_interface").when(b, "hidden_coupling").otherwise("unrelated")


def coupling_matrix(structural: DataFrame, behavioral: DataFrame, s_line: float | None = None, b_line: float | None = None) -> DataFrame:
    """a, b, structural, behavioral, classification of all pairs of either side.

    Missing sides are 0.  A threshold not given is the median of that side's positive values, 0 if
    there are none (then every pair reaches it).
    """
    rows = structural.join(behavioral, ["a", "b"], "full").select("a", "b", F.coalesce("structural", F.lit(0.0)).cast("double").alias("structural"), F.coalesce("behavioral", F.lit(0.0)).cast("double").alias("behavioral"))
    if s_line is None or b_line is None:
        rows = checkpoint(rows)
    line = lambda given, c: given if given is not None else median(rows.filter(F.col(c) > 0), c) or 0.0
    s_line, b_line = line(s_line, "structural"), line(b_line, "behavioral")
    return rows.withColumn("classification", classify(F.col("structural"), F.col("behavioral"), F.lit(s_line), F.lit(b_line)))


def hidden_coupling(matrix: DataFrame) -> DataFrame:
    return matrix.filter("classification = 'hidden_coupling'")


def component_profile(matrix: DataFrame, component) -> DataFrame:
    return matrix.filter((F.col("a") == component) | (F.col("b") == component))


def hotspots(frequencies: DataFrame, sizes: DataFrame) -> DataFrame:
    """item, n, size, score = n * size of items with a size above 0."""
    return frequencies.join(sizes.filter("size > 0"), "item").withColumn("score", F.col("n") * F.col("size"))


def half_trend(changes: DataFrame, item: str, value: str, *order: str, threshold: float = 1.0, least: int = 2) -> DataFrame:
    """item, n, direction and magnitude: mean of the later half less that of the earlier half.

    Rows of an item are split by position, the earlier half rounded down; items with fewer than
    `least` rows are stable with magnitude 0.
    """
    w = Window.partitionBy(item)
    rows = changes.withColumn("_k", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    half = F.floor(F.col("_n") / 2)
    means = rows.groupBy(item).agg(F.max("_n").alias("n"), F.avg(F.when(F.col("_k") <= half, F.col(value))).alias("_a"), F.avg(F.when(F.col("_k") > half, F.col(value))).alias("_b"))
    diff = F.when(F.col("n") < least, F.lit(0.0)).otherwise(F.col("_b") - F.col("_a"))
    return means.select(item, "n", F.when(diff > threshold, "increasing").when(diff < -threshold, "decreasing").otherwise("stable").alias("direction"), F.round(F.abs(diff), 2).alias("magnitude"))


def neighbourhood(both: DataFrame, imports: DataFrame | None = None, line: float = 0.0) -> DataFrame:
    """Edges from each item (item, neighbour, weight, n) with tier and import flag; import-only pairs are structural."""
    rows = both
    if imports is not None:
        rows = rows.join(imports.select("item", "neighbour", F.lit(True).alias("imported")).distinct(), ["item", "neighbour"], "full")
    else:
        rows = rows.withColumn("imported", F.lit(False))
    rows = rows.fillna({"weight": 0.0, "n": 0, "imported": False})
    return rows.withColumn("tier", F.when(F.col("weight") >= line, "direct").when(F.col("weight") > 0, "moderate").otherwise("structural"))


def dominant_trend(a: str, b: str):
    """Of two trend structs (direction, magnitude): the one that is not stable, else the larger."""
    rank = lambda c: F.struct((F.col(c)["direction"] != "stable").cast("int"), F.col(c)["magnitude"])
    return F.when(rank(a) >= rank(b), F.col(a)).otherwise(F.col(b))
