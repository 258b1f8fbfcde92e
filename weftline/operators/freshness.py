"""Freshness of documents against their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: a source may be this many milliseconds newer than its document.
TOLERANCE_MS = 5000


def stale(source_ms, doc_ms, ack_ms, tolerance: int = TOLERANCE_MS):
    """Whether a document is out of date: no time, no source, or the source newer by more than the tolerance."""
    own = F.greatest(doc_ms, ack_ms)  # nulls are skipped
    return own.isNull() | source_ms.isNull() | F.coalesce(source_ms - own > tolerance, F.lit(True))


def report(sources: DataFrame, docs: DataFrame, acks: DataFrame | None = None) -> DataFrame:
    """component, doc, source_ms, doc_ms, ack_ms, stale.

    sources: component, ms (one row for each file); docs: component, doc, doc_ms; acks: doc, ms.
    """
    newest = sources.groupBy("component").agg(F.max("ms").alias("source_ms"))
    rows = docs.join(newest, "component", "left")
    if acks is not None:
        rows = rows.join(acks.groupBy("doc").agg(F.max("ms").alias("ack_ms")), "doc", "left")
    else:
        rows = rows.withColumn("ack_ms", F.lit(None).cast("long"))
    return rows.withColumn("stale", stale(F.col("source_ms"), F.col("doc_ms"), F.col("ack_ms")))


def changed_since(rows: DataFrame, since_ms: int | None) -> DataFrame:
    """Rows whose source or document is newer than since; without it, the stale ones."""
    if since_ms is None:
        return rows.filter("stale")
    return rows.filter((F.col("source_ms") > since_ms) | (F.col("doc_ms") > since_ms))


def warm(sources: DataFrame, since_ms: int) -> DataFrame:
    """component, changed: whether anything of it is newer than since."""
    return sources.groupBy("component").agg((F.max("ms") > since_ms).alias("changed"))


def acknowledge(docs: DataFrame, now_ms: int) -> DataFrame:
    """Acknowledgement rows for documents."""
    return docs.select("doc", F.lit(now_ms).cast("long").alias("ms")).distinct()
