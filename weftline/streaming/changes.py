"""An index of changes that follows a commit log: commits, links, liveness, tags and words in one transaction.

A batch of commits changes seven tables of a store, and all of them with one manifest: a reader sees
the index before the batch or after it.  A batch that fails half-way leaves no trace; one that is
repeated, or a commit that comes again in a later batch, adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import paths, text
from weftline.operators import textindex
from weftline.operators.graph import checkpoint
from weftline.sources import commits, logsource
from weftline.sources.store import Store, without

TABLES = {
    "commits": ("sha string, doc long, message string, author string, timestamp long, conv_type string, conv_scope string", ["sha"], None),
    "links": ("path string, sha string", ["path", "sha"], 1),
    "artifacts": ("path string, alive boolean", ["path"], None),
    "operations": ("path string, sha string, seq int, tag string, op string, timestamp long", ["path", "sha", "seq"], 1),
    "tags": ("path string, tag string", ["path", "tag"], 1),
}


class ChangeIndex:
    """The index in a folder; exclude: globs of paths that it leaves out."""

    def __init__(self, spark: SparkSession, path: str, exclude: list[str] | None = None, buckets: int = 16):
        self.spark, self.store, self.exclude = spark, Store(spark, path), exclude or []
        for table, (schema, keys, by) in TABLES.items():
            self.store.define(table, schema, keys, buckets, by)
        textindex.define(self.store, buckets=buckets)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.store.read(table, version)

    def index(self, rows: DataFrame, batch: int | None = None, clear: bool = False) -> dict:
        """Add parsed commits; counts of new commits, of paths added or changed, and of paths deleted.

        Within a batch commits count in order of time and sha, deletions of a commit last; a later batch
        counts after an earlier one.  clear: build the index anew, still in one transaction.
        """
        with self.store.begin(batch) as tx:
            if tx.done:
                return {"commits": 0, "indexed": 0, "deleted": 0}
            if clear:
                tx.manifest["tables"], tx.manifest["meta"] = {}, {}
            new = checkpoint(without(rows.dropDuplicates(["sha"]), tx.read("commits"), ["sha"]))
            first = tx.manifest["meta"].get("next_doc", 0)
            last = new.agg(F.max_by("sha", F.struct("timestamp", "sha")).alias("sha"), F.count("*").alias("n")).first()
            if last["n"] == 0:
                return {"commits": 0, "indexed": 0, "deleted": 0}
            numbered = checkpoint(new.withColumn("doc", F.monotonically_increasing_id() + first))
            self._commits(tx, numbered)
            counts = self._paths(tx, new)
            top = numbered.agg(F.max("doc").alias("top")).first()["top"]
            tx.manifest["meta"] |= {"next_doc": top + 1, "last_sha": last["sha"], "since_snapshot": tx.manifest["meta"].get("since_snapshot", 0) + last["n"]}
            return {"commits": last["n"], **counts}

    def _commits(self, tx, rows: DataFrame) -> None:
        subject = F.col("subject")
        tx.append("commits", rows.select("sha", "doc", subject.alias("message"), "author", "timestamp", text.conventional_type(subject).alias("conv_type"), text.conventional_scope(subject).alias("conv_scope")), spread=False)
        tx.append("postings", textindex.postings(rows, "doc", "subject"), spread=False)

    def _kept(self, path: Column) -> Column:
        return ~paths.matches_any(path, self.exclude) if self.exclude else F.lit(True)

    def _paths(self, tx, rows: DataFrame) -> dict:
        changed = checkpoint(commits.changes(rows).filter(self._kept(F.col("path"))))
        tx.insert_absent("links", changed.select("path", "sha"))  # one row for each key, as any insertion
        tx.upsert("artifacts", changed.groupBy("path").agg(F.max_by("alive", F.struct("timestamp", "sha", "seq")).alias("alive")))
        said = rows.select("sha", "timestamp", text.tag_operations(F.col("body")).alias("ops")).filter("ops is not null").select("sha", F.posexplode("ops").alias("seq", "o"))
        found = changed.filter("alive").select("path", "sha", "timestamp").join(said.drop("timestamp"), "sha").select("path", "sha", "seq", "o.tag", "o.op", "timestamp")
        tx.insert_absent("operations", found)
        touched = changed.select("path").distinct()
        tx.rewrite("tags", ["path"], self._tags(tx, touched), touched)
        n = changed.agg(F.count_if("alive").alias("indexed"), F.count_if(~F.col("alive")).alias("deleted")).first()
        return n.asDict()

    def _tags(self, tx, touched: DataFrame) -> DataFrame:
        """Tags of paths: of their folders, and what operations in order of time left of them."""
        folder = touched.select("path", F.explode(paths.path_tags(F.col("path"))).alias("tag"), F.lit("add").alias("op"), F.lit(None).cast("long").alias("timestamp"), F.lit("").alias("sha"), F.lit(-1).alias("seq"))
        said = tx.read("operations").join(touched, "path", "left_semi").select("path", "tag", "op", "timestamp", "sha", "seq")
        last = folder.unionByName(said).groupBy("path", "tag").agg(F.max_by("op", F.struct("timestamp", "sha", "seq")).alias("op"))
        return last.filter("op = 'add'").select("path", "tag")

    def rebuild(self, rows: DataFrame) -> dict:
        """Index all commits anew; readers see the old index until it is done."""
        return self.index(rows, clear=True)

    def follow(self, log: str, done: str, **options) -> None:
        """Index what a commit log has gained since the last run; `done` holds how far each file was read."""
        stream = logsource.stream(self.spark, log, **options).writeStream.option("checkpointLocation", done).trigger(availableNow=True)
        stream.foreachBatch(lambda batch, n: self.index(commits.parse_records(batch), n)).start().awaitTermination()

    def snapshot_due(self, every: int = 500) -> bool:
        """Whether so many commits came since the last snapshot; 0: never."""
        return 0 < every <= self.store.meta().get("since_snapshot", 0)

    def snapshot(self) -> int:
        """Remember the present version as a snapshot; its number."""
        with self.store.begin() as tx:
            tx.manifest["meta"] |= {"since_snapshot": 0, "snapshot": tx.base}
        return self.store.meta()["snapshot"]

    def restore(self) -> None:
        """Go back to the last snapshot, as a version of its own."""
        with self.store.begin() as tx:
            then = self.store.manifest(tx.manifest["meta"]["snapshot"])
            tx.manifest |= {"tables": then["tables"], "meta": then["meta"] | {"snapshot": tx.manifest["meta"]["snapshot"], "since_snapshot": 0}}

    def search(self, query: str, tags: list[str] | None = None, limit: int = 20) -> DataFrame:
        """sha, message, author, timestamp of the latest commits whose message has every word of a query and, with tags, that touch a path with one of them."""
        hits = textindex.match_all(self.store, text.search_terms(query))
        found = self.read("commits").join(hits, "doc", "left_semi")
        if tags:
            tagged = self.read("tags").filter(F.col("tag").isin(tags)).select("path").distinct()
            found = found.join(self.read("links").join(tagged, "path", "left_semi"), "sha", "left_semi")
        return found.select("sha", "message", "author", "timestamp").orderBy(F.desc("timestamp"), "sha").limit(limit)

    def merge(self, most: int = 8) -> None:
        """Merge the segments of the words and of the commits."""
        self.store.merge("postings", most, textindex.merged)
        self.store.merge("commits", most)
