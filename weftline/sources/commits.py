"""Commit logs as tables.  A log is text; each commit is one record between delimiters of one's own choice.

Produce one with, for example, git log --name-status and a format of
"<commit mark>%n%H%n%an%n%at%n%s%n%b<files mark>".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT_MARK, FILES_MARK = "---COMMIT---", "---FILES---"


def read_log(spark: SparkSession, path: str, mark: str = COMMIT_MARK) -> DataFrame:
    """One row (value) for each record; Spark cuts files at the mark, so large logs are read in parallel."""
    return spark.read.option("lineSep", mark).text(path)


def parse_records(records: DataFrame, files_mark: str = FILES_MARK, value: str = "value") -> DataFrame:
    """sha, author, timestamp, subject, body, files, deleted_files of commit records.

    Status D deletes; R deletes the old path and adds the new one; everything else names a file.
    Blank records are skipped; a record without files has empty lists.
    """
    halves = F.split(F.regexp_replace(F.col(value), r"^\s+", ""), files_mark, 2)
    lines = F.split(halves[0], "\n")
    at = lambda i: F.trim(F.coalesce(F.get(lines, F.lit(i)), F.lit("")))
    rows = F.transform(F.filter(F.split(F.coalesce(F.get(halves, F.lit(1)), F.lit("")), "\n"), lambda x: F.trim(x) != ""), lambda x: F.split(F.trim(x), "\t"))
    rows = F.filter(rows, lambda p: F.coalesce(F.get(p, F.lit(1)), F.lit("")) != "")
    status = lambda p: p[0]
    files = F.flatten(F.transform(rows, lambda p: F.when(status(p) == "D", F.array().cast("array<string>")).when(status(p).startswith("R"), F.array_compact(F.array(F.get(p, F.lit(2))))).otherwise(F.array(p[1]))))
    gone = F.transform(F.filter(rows, lambda p: (status(p) == "D") | status(p).startswith("R")), lambda p: p[1])
    body = F.regexp_replace(F.array_join(F.slice(lines, 5, 1 << 30), "\n"), r"\s+$", "")
    return records.filter(F.trim(F.regexp_replace(value, r"\s", "")) != "").select(
        at(0).alias("sha"), at(1).alias("author"), at(2).try_cast("long").alias("timestamp"), at(3).alias("subject"), body.alias("body"), files.alias("files"), gone.alias("deleted_files")
    )


def changes(commits: DataFrame) -> DataFrame:
    """sha, timestamp, path, alive: one row for each path of a commit, deletions last."""
    both = F.concat(F.transform("files", lambda f: F.struct(f.alias("path"), F.lit(True).alias("alive"))), F.transform("deleted_files", lambda f: F.struct(f.alias("path"), F.lit(False).alias("alive"))))
    return commits.select("sha", "timestamp", F.posexplode(both).alias("seq", "c")).select("sha", "timestamp", "seq", "c.path", "c.alive")


def parse_name_only(records: DataFrame, value: str = "value") -> DataFrame:
    """sha, subject, files of records that hold a sha, a subject and then paths."""
    lines = F.filter(F.split(value, "\n"), lambda x: F.trim(x) != "")
    return records.withColumn("_l", lines).filter(F.size("_l") >= 2).select(F.trim(F.col("_l")[0]).alias("sha"), F.col("_l")[1].alias("subject"), F.slice("_l", 3, 1 << 30).alias("files"))


def parse_numstat(records: DataFrame, value: str = "value") -> DataFrame:
    """sha, file, additions, deletions; binary files (a dash for counts) are skipped."""
    rows = records.select(F.regexp_extract(value, r"([0-9a-f]{40})", 1).alias("sha"), F.explode(F.split(value, "\n")).alias("line"))
    p = F.split("line", "\t")
    rows = rows.filter(F.size(p) >= 3).select("sha", p[2].alias("file"), p[0].try_cast("int").alias("additions"), p[1].try_cast("int").alias("deletions"))
    return rows.filter("additions is not null and deletions is not null")


def bounded_history(commits: DataFrame, files: list[str], most: int = 500) -> DataFrame:
    """The latest `most` commits that touch one of the files; both bounds come before anything is exploded."""
    hit = F.arrays_overlap("files", F.array(*map(F.lit, files)))
    return commits.filter(hit).orderBy(F.desc("timestamp"), "sha").limit(most)


def since(commits: DataFrame, timestamp: Column | int) -> DataFrame:
    """Commits after a time; reaches the scan of a Parquet log."""
    return commits.filter(F.col("timestamp") > timestamp)


def changed_files(commits: DataFrame, timestamp: Column | int) -> DataFrame:
    """file: what commits after a time touch and do not leave deleted."""
    last = changes(since(commits, timestamp)).groupBy("path").agg(F.max_by("alive", F.struct("timestamp", "sha", "seq")).alias("alive"))
    return last.filter("alive").select(F.col("path").alias("file"))


def only_changed(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Files (column file) among the changed ones."""
    return files.join(changed.select("file"), "file", "left_semi")


def with_dependents(changed: DataFrame, owner: DataFrame, deps: DataFrame) -> DataFrame:
    """Changed files and all files of components that depend, in turn, on a changed component.

    owner: file, component; deps: src, dst (src depends on dst).
    """
    from weftline.operators.graph import reachable, reversed_edges

    hit = owner.join(changed.select("file"), "file", "left_semi").select(F.col("component").alias("node")).distinct()
    affected = reachable(reversed_edges(deps), hit).select(F.col("node").alias("component")).distinct()
    return changed.select("file").unionByName(owner.join(affected, "component", "left_semi").select("file")).distinct()


def resume(spark: SparkSession, path: str, checkpoint: str, each, mark: str = COMMIT_MARK, files_mark: str = FILES_MARK) -> None:
    """Parse the records of log files that are new since the last run and hand them, batch by batch, to each(commits, batch_id).

    A folder of logs is read as a stream whose checkpoint says which files are done, so a run after a
    failure goes on where the last one stopped and reads nothing twice.
    """
    from weftline.streaming.incremental import run_available

    run_available(spark.readStream.option("lineSep", mark).text(path), checkpoint, lambda batch, n: each(parse_records(batch, files_mark), n))
