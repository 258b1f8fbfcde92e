"""Writing results: reports as JSON, Markdown and HTML, snapshots, idempotent inserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON object to a row (column value)."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def as_markdown(rows: DataFrame, *order: str) -> DataFrame:
    """Lines of a Markdown table with their position, ready for a text sink of one file."""
    cells = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\|", r"\\|"), F.lit("")) for c in rows.columns]
    body = rows.orderBy(*order).select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    head = rows.sparkSession.createDataFrame([("| " + " | ".join(rows.columns) + " |",), ("|" + "---|" * len(rows.columns),)], "value string")
    return head.coalesce(1).union(body)


def as_html(rows: DataFrame, title: str, *order: str) -> DataFrame:
    """Lines of an HTML page with one table, cells escaped, ready for a text sink of one file."""

    def safe(c):
        out = F.coalesce(c.cast("string"), F.lit(""))
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    spark = rows.sparkSession
    line = lambda *parts: spark.createDataFrame([(p,) for p in parts], "value string").coalesce(1)
    cells = [F.concat(F.lit("<td>"), safe(F.col(c)), F.lit("</td>")) for c in rows.columns]
    body = rows.orderBy(*order).select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value"))
    head = f"<!DOCTYPE html><meta charset='utf-8'><title>{title}</title><h1>{title}</h1><table>"
    return line(head, "<tr>" + "".join(f"<th>{c}</th>" for c in rows.columns) + "</tr>").union(body).union(line("</table>"))


def append_new(rows: DataFrame, path: str, *keys: str) -> None:
    """Append rows whose key the table at path does not have; repeated runs add nothing."""
    spark = rows.sparkSession
    new = rows.dropDuplicates(list(keys))
    try:
        there = spark.read.parquet(path).select(*keys)
    except Exception as missing:  # no table yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    else:
        new = new.join(there, list(keys), "left_anti")
    new.write.mode("append").parquet(path)


def due_snapshot(commits: DataFrame, last: int | None, every: int = 500) -> bool:
    """Whether `every` commits or more came after the last snapshot's time."""
    return commits.filter(F.col("timestamp") > (last if last is not None else -1)).limit(every).count() >= every


def latest_meta(meta: DataFrame) -> DataFrame:
    """One row of a key-value table (key, value): sha and time of the last snapshot, null if either is missing."""
    pick = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    both = meta.agg(pick("snapshot_sha").alias("sha"), pick("snapshot_time").alias("time"))
    ok = F.col("sha").isNotNull() & F.col("time").isNotNull()
    return both.select(F.when(ok, F.col("sha")).alias("sha"), F.when(ok, F.col("time").cast("long")).alias("time"))
