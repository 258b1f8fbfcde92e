"""A change index: liveness, provenance, tags, full-text and status, over links of commits and artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import tokens


def liveness(changes: DataFrame, key: str, state: str, *order: str) -> DataFrame:
    """Last state of each key in the given order (time, then sequence)."""
    return changes.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state))


def replay(operations: DataFrame, keys: list[str], op: str, *order: str) -> DataFrame:
    """Keys whose last operation adds; the fold of an operation log, one row for each key and task shuffled."""
    last = operations.groupBy(*keys).agg(F.max_by(op, F.struct(*order)).alias("last"))
    return last.filter(F.col("last") == "add").drop("last")


def provenance(links: DataFrame, commits: DataFrame, targets: DataFrame, item: str, group: str) -> DataFrame:
    """Commits of the targets' links; the filter reaches the link scan before the join."""
    return links.join(targets, item, "left_semi").select(item, group).distinct().join(commits, group)


def artifact_card(history: DataFrame, item: str, time: str, group: str, latest: int = 5) -> DataFrame:
    """The latest commits of each item with its total and whether the list is cut.

    Totals are counted and the latest are picked before the shuffle already, so an item with a very
    long history sends few rows from each task.
    """
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(item).orderBy(F.desc(time), F.desc(group)))
    rows = history.withColumn("nth", nth).filter(F.col("nth") <= latest)
    totals = history.groupBy(item).agg(F.count("*").alias("total"))
    return rows.join(totals, item).withColumn("truncated", F.col("total") > latest)


def with_all_tags(tags: DataFrame, wanted: list[str]) -> DataFrame:
    """Items that have every wanted tag, with all their tags, distinct and sorted."""
    hit = tags.filter(F.col("tag").isin(wanted)).groupBy("item").agg(F.count_distinct("tag").alias("n")).filter(F.col("n") == len(set(wanted))).select("item")
    return tags.join(hit, "item", "left_semi").groupBy("item").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.select("item", "tag").distinct().groupBy("tag").agg(F.count("*").alias("n"))


def matching_text(rows: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """Rows whose text has every term as a token."""
    return rows.filter(F.size(F.array_intersect(tokens(F.col(text)), F.array(*map(F.lit, terms)))) == len(terms)) if terms else rows.limit(0)


def page(rows: DataFrame, ignored: DataFrame, key: str, offset: int, limit: int, *order: Column) -> DataFrame:
    """One page of rows in a total order, ignored keys taken out first."""
    return rows.join(ignored, key, "left_anti").orderBy(*order).offset(offset).limit(limit)


def insert_absent(rows: DataFrame, existing: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key is not there yet, one for each key."""
    return rows.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def suppress_all(warnings: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Keys to add so that every present warning is suppressed."""
    return warnings.filter(F.col("severity") == "warning").select("key").distinct().join(suppressed, "key", "left_anti")
