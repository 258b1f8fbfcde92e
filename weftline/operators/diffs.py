"""Differences of keyed tables: missing and extra edges, added, removed and changed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, status (added, removed, modified, same) and the changed fields."""
    a = old.select(*keys, F.struct(*fields).alias("_a"))
    b = new.select(*keys, F.struct(*fields).alias("_b"))
    rows = a.join(b, keys, "full")
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("modified")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), F.lit(f)) for f in fields]))
    return rows.select(*keys, status.alias("status"), F.when(status == "modified", changed).otherwise(F.array().cast("array<string>")).alias("fields"))


def edge_diff(declared: DataFrame, inferred: DataFrame) -> DataFrame:
    """src, dst, status: missing (inferred only) or extra (declared only)."""
    d, i = declared.select("src", "dst").distinct(), inferred.select("src", "dst").distinct()
    missing = i.join(d, ["src", "dst"], "left_anti").withColumn("status", F.lit("missing"))
    return missing.unionByName(d.join(i, ["src", "dst"], "left_anti").withColumn("status", F.lit("extra")))


def unused_by_both(declared: DataFrame, by_imports: DataFrame, by_links: DataFrame, with_source: DataFrame) -> DataFrame:
    """Declared edges (src, dst) that neither imports nor links show, for components that have source."""
    extra = declared.join(with_source.select("src").distinct(), "src", "left_semi")
    return extra.join(by_imports, ["src", "dst"], "left_anti").intersect(declared.select("src", "dst").join(by_links, ["src", "dst"], "left_anti"))


def resolved_deps(components: DataFrame) -> DataFrame:
    """src, dst: dependencies by component name or tag (all that have it, itself excluded); an unknown one is an error.

    components: name, deps, tags.
    """
    want = components.select(F.col("name").alias("src"), F.explode("deps").alias("dep"))
    names = components.select(F.col("name").alias("dep"), F.col("name").alias("_n"))
    tags = components.select(F.explode("tags").alias("dep"), F.col("name").alias("_t"))
    rows = want.join(names, "dep", "left").join(tags, "dep", "left")
    dst = F.coalesce("_n", "_t")
    known = F.when(dst.isNull(), F.raise_error(F.concat(F.lit("unknown dependency: "), F.col("dep")))).otherwise(dst)
    return rows.select("src", known.alias("dst"), F.col("_n").isNull().alias("_by_tag")).filter("not (_by_tag and src = dst)").select("src", "dst").distinct()


def suppressed_issues(issues: DataFrame, keys: DataFrame) -> DataFrame:
    """Issues (severity, key) without the suppressed warnings; errors always stay."""
    return issues.filter("severity <> 'warning'").unionByName(issues.filter("severity = 'warning'").join(keys, "key", "left_anti"))
