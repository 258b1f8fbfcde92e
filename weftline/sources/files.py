"""Trees of files as tables: metadata, contents, listings and line search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.paths import LANGUAGES, ignored, is_binary, language, matches_any

#: Paths never looked at.
IGNORED = ("node_modules", ".git", "dist", "build", ".DS_Store", "*.min.js", "*.bundle.js")


def scan(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """file (relative), path, modified, size, content; content is not read unless it is selected."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*(?=/)", "")
    plain = F.regexp_replace("path", "^[a-z]+:/*(?=/)", "")
    return rows.select(F.substring(plain, F.length(base) + 2, F.length(plain)).alias("file"), "path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def source_files(spark: SparkSession, root: str, patterns: tuple[str, ...] = IGNORED) -> DataFrame:
    """file, language, content (text), size of known source files that are neither ignored nor binary."""
    rows = scan(spark, root).filter(~ignored(F.col("file"), list(patterns))).withColumn("language", language(F.col("file"))).filter("language <> 'unknown'")
    rows = rows.withColumn("content", F.decode("content", "UTF-8"))
    return rows.filter(~is_binary(F.col("content"))).select("file", "language", "content", "size", "modified")


def listing(rows: DataFrame, globs: list[str] | None = None, most: int = 5000) -> DataFrame:
    """The first `most` files by name and whether there are more (column truncated)."""
    kept = rows.filter(matches_any(F.col("file"), globs)) if globs else rows
    first = kept.select("file", "size").orderBy("file").limit(most + 1)
    n = F.count("*").over(_all())
    return first.withColumn("truncated", n > most).orderBy("file").limit(most)


def _all():
    from pyspark.sql import Window

    return Window.partitionBy()


def search(rows: DataFrame, pattern: str, per_file: int = 1000, most: int = 100) -> DataFrame:
    """file, n, line, truncated: matching lines in order, at most per_file of a file and most in all."""
    from pyspark.sql import Window

    lines = rows.select("file", F.posexplode(F.split("content", "\n", -1)).alias("n", "line")).filter(F.col("line").rlike(pattern)).withColumn("n", F.col("n") + 1)
    lines = lines.withColumn("_k", F.row_number().over(Window.partitionBy("file").orderBy("n"))).filter(F.col("_k") <= per_file).drop("_k")
    first = lines.orderBy("file", "n").limit(most + 1)
    return first.withColumn("truncated", F.count("*").over(_all()) > most).orderBy("file", "n").limit(most)


def source_file(path):
    """Code files that are not tests."""
    return path.rlike(r"\.(?:ts|tsx|js|jsx)$") & ~path.rlike(r"\.test\.tsx?$")


__all__ = ["LANGUAGES", "listing", "scan", "search", "source_file", "source_files"]
