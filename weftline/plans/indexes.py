"""Queries over what is built and kept: logs read with pushed filters, the inverted index, the index of changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.operators import quantiles, textindex, versions
from weftline.operators.graph import scratch
from weftline.plans.surveys import log
from weftline.sources import logsource
from weftline.sources.store import Store
from weftline.sources.tables import load
from weftline.streaming.changes import ChangeIndex

#: 1996 begins, in seconds, and the seconds of a year.
LATE, YEAR = 820_454_400, 31_536_000


@query(
    "log_window",
    f"""WITH l AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS p FROM lineitem) SELECT o_orderkey::VARCHAR AS sha, 'feat: ' || o_orderpriority AS subject, epoch(o_orderdate)::BIGINT AS timestamp, count(*) FILTER (p % 5 <> 0) AS files, count(*) FILTER (p % 5 = 0) AS gone
FROM orders JOIN l ON k = o_orderkey WHERE epoch(o_orderdate) > {LATE} AND epoch(o_orderdate) <= {LATE + YEAR} GROUP BY ALL""",
)
def log_window(spark, sf_dir):
    path = scratch(spark, "log")
    records = log(spark, sf_dir).withColumn("timestamp", F.split("value", "\n")[2].cast("long"))
    logsource.write_log(records, path, YEAR)
    found = logsource.commits_between(spark, path, after=LATE, until=LATE + YEAR)
    return found.select("sha", "subject", "timestamp", F.size("files").cast("long").alias("files"), F.size("deleted_files").cast("long").alias("gone"))


WORDS = "t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents)"


def indexed(spark, sf_dir) -> Store:
    """An index of all documents, written in two batches and merged."""
    store = Store(spark, scratch(spark, "words"))
    textindex.define(store, buckets=16)
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    for batch in (0, 1):
        with store.begin(batch) as tx:
            tx.append("postings", textindex.postings(docs.filter(F.col("doc") % 2 == batch)), spread=False)
    store.merge("postings", 1, textindex.merged)
    return store


@query("indexed_terms", f"WITH {WORDS} SELECT doc_id FROM t WHERE list_has_all(w, ['the', 'and', 'that'])")
def indexed_terms(spark, sf_dir):
    return textindex.match_all(indexed(spark, sf_dir), ["the", "and", "that"]).select(F.col("doc").alias("doc_id"))


@query("indexed_phrase", f"WITH {WORDS} SELECT doc_id FROM t WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')")
def indexed_phrase(spark, sf_dir):
    return textindex.match_phrase(indexed(spark, sf_dir), ["of", "the"]).select(F.col("doc").alias("doc_id"))


@query("term_frequency", f"WITH {WORDS}, u AS (SELECT doc_id, unnest(w) AS term FROM t) SELECT term, count(DISTINCT doc_id) AS texts, count(*) AS occurrences FROM u WHERE term IN ('the', 'de', 'und') GROUP BY term")
def term_frequency(spark, sf_dir):
    return textindex.frequency(indexed(spark, sf_dir), ["the", "de", "und"])


@query(
    "indexed_changes",
    f"""WITH l AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS p, o_custkey % 5 AS t, epoch(o_orderdate)::BIGINT AS ts, (l_partkey + l_orderkey) % 5 <> 0 AS alive FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
live AS (SELECT p, arg_max(alive, struct_pack(ts := ts, k := k::VARCHAR)) AS alive, count(*) AS links FROM l GROUP BY p),
ops AS (SELECT p, 'k' || t AS tag, arg_max(k % 4 = 0, struct_pack(ts := ts, k := k::VARCHAR)) AS kept FROM l WHERE k % 4 < 2 AND alive GROUP BY ALL),
tags AS (SELECT p, tag FROM ops WHERE kept UNION SELECT p, 'm' || p % 7 FROM live)
SELECT 'lib/m' || p % 7 || '/p' || p AS path, alive, links, string_agg(tag, ',' ORDER BY tag) AS tags FROM live JOIN tags USING (p) GROUP BY ALL""",
)
def indexed_changes(spark, sf_dir):
    # dealt once by order: distinct links, the lists of an order and the join with orders stay where they are
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").repartition("l_orderkey").distinct()
    path = F.concat(F.lit("lib/m"), (F.col("l_partkey") % 7).cast("string"), F.lit("/p"), F.col("l_partkey").cast("string"))
    alive = (F.col("l_partkey") + F.col("l_orderkey")) % 5 != 0
    held = line.groupBy("l_orderkey").agg(F.collect_list(F.when(alive, path)).alias("files"), F.collect_list(F.when(~alive, path)).alias("deleted_files"))
    sign = F.when(F.col("o_orderkey") % 4 == 0, "tags: +k").when(F.col("o_orderkey") % 4 == 1, "tags: -k")
    body = F.coalesce(F.concat(sign, (F.col("o_custkey") % 5).cast("string")), F.lit(""))
    rows = load(spark, sf_dir, "orders").join(held, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").cast("string").alias("sha"), F.col("o_custkey").cast("string").alias("author"), F.unix_timestamp("o_orderdate").alias("timestamp"), F.concat(F.lit("feat: "), "o_orderpriority").alias("subject"), body.alias("body"), "files", "deleted_files",
    )
    index = ChangeIndex(spark, scratch(spark, "changes"))
    index.index(rows.filter(F.col("timestamp") <= LATE), 0)
    index.index(rows.filter(F.col("timestamp") > LATE), 1)
    links = index.read("links").groupBy("path").agg(F.count("*").alias("links"))
    tags = index.read("tags").groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))
    return index.read("artifacts").join(links, "path").join(tags, "path")


@query("exact_medians", "SELECT 'price' AS name, median(l_extendedprice)::DOUBLE AS value FROM lineitem UNION ALL SELECT 'value', median(value) FROM events UNION ALL SELECT 'length', median(length(text))::DOUBLE FROM documents")
def exact_medians(spark, sf_dir):
    table = lambda name, column: load(spark, sf_dir, name).select(column.cast("double").alias("x"))
    found = {"price": table("lineitem", F.col("l_extendedprice")), "value": table("events", F.col("value")), "length": table("documents", F.length("text"))}
    return spark.createDataFrame([(k, quantiles.median(rows, "x")) for k, rows in found.items()], "name string, value double")


#: A part is a file, renamed in the middle of its orders where its number divides by four; each order line writes it, every seventh deletes it.
VERSIONS = """l AS (SELECT l_partkey AS p, l_orderkey * 8 + l_linenumber AS t FROM lineitem),
c AS (SELECT p, t, CASE WHEN p % 4 = 0 AND t > 160000 THEN 'new/p' || p ELSE 'p' || p END AS path, CASE WHEN t % 7 = 0 THEN 'D' ELSE 'M' END AS kind FROM l)"""


@query(
    "content_at",
    f"""WITH {VERSIONS}, last AS (SELECT p, arg_max(kind, t) AS kind, max(t) AS t, arg_max(path, t) AS path FROM c WHERE t <= 200000 GROUP BY p)
SELECT CASE WHEN p % 4 = 0 THEN 'new/p' || p ELSE 'p' || p END AS path, 'v' || t AS content, path AS origin FROM last WHERE kind = 'M'""",
)
def content_at(spark, sf_dir):
    p, t = F.col("l_partkey"), F.col("l_orderkey") * 8 + F.col("l_linenumber")
    old, new = F.concat(F.lit("p"), p.cast("string")), F.concat(F.lit("new/p"), p.cast("string"))
    path, kind = F.when((p % 4 == 0) & (t > 160_000), new).otherwise(old), F.when(t % 7 == 0, "D").otherwise("M")
    lines = load(spark, sf_dir, "lineitem")
    changes = lines.select(path.alias("path"), t.alias("time"), kind.alias("kind"), F.when(kind == "M", F.concat(F.lit("v"), t.cast("string"))).alias("content"), F.lit(None).cast("string").alias("old_path"))
    moved = lines.filter(p % 4 == 0).filter(t <= 160_000).groupBy(new.alias("path"), old.alias("old_path")).agg(F.max_by(kind, t).alias("last")).filter("last = 'M'")
    renames = moved.select("path", F.lit(160_000).cast("long").alias("time"), F.lit("R").alias("kind"), F.lit(None).cast("string").alias("content"), "old_path")
    wanted = lines.select(F.when(p % 4 == 0, new).otherwise(old).alias("path"), F.lit(200_000).cast("long").alias("at"))
    return versions.content_at(changes.unionByName(renames), wanted).select("path", "content", "origin")
