"""Commit logs as a data source of Spark: pushed-down filters, byte ranges, and a stream with offsets.

A log is a file, or a folder of files, of records that begin with a mark.  Rows are (sha, timestamp,
value): the record's head, and its text for commits.parse_records.  Files are cut into byte ranges; a
record belongs to the range that its mark begins in.  Filters on timestamp and sha are taken over: a
file in a folder named window=FROM-TO is not opened if no time in it can match, and of other records
only the head is looked at.  As a stream, an offset says how far each file has been read, so files may
grow (by whole records) and new ones may come.

Paths are those that pyarrow's file systems open; commits.read_log reads any store that Spark reads.
"""

from __future__ import annotations

import json
import posixpath
import re

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

import weftline
from weftline.sources.commits import COMMIT_MARK, parse_records

cloudpickle.register_pickle_by_value(weftline)  # executors need no copy of this package

SCHEMA = "sha string, timestamp long, value string"
SPLIT_BYTES, BLOCK = 32 << 20, 1 << 20


def opened(path: str):
    """File system of a path or URI, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w[\w+.-]+:/", path) else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(name below path or "", size) of a log's files; names that begin with a dot or an underscore do not count."""
    from pyarrow import fs

    system, root = opened(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [("", info.size)]
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    names = ((posixpath.relpath(f.path, root), f.size) for f in found if f.type == fs.FileType.File and f.size)
    return sorted((n, size) for n, size in names if not any(p[0] in "._" for p in n.split("/")))


def window_of(name: str) -> tuple[float, float]:
    """First and last time that a file's folder says its records have."""
    m = re.search(r"(?:^|/)window=(\d+)-(\d+)/", name)
    return (int(m[1]), int(m[2])) if m else (float("-inf"), float("inf"))


class Range(InputPartition):
    """Records whose mark begins in [start, end) of a file."""

    def __init__(self, name: str, start: int, end: int):
        super().__init__((name, start, end))
        self.name, self.start, self.end = name, start, end


def ranges(name: str, start: int, end: int, split: int) -> list[Range]:
    return [Range(name, at, min(at + split, end)) for at in range(start, end, split)]


def records(path: str, part: Range, mark: bytes):
    """Bytes of the records of a range, without the mark; a record may go on behind the range."""
    system, root = opened(path)
    with system.open_input_file(posixpath.join(root, part.name) if part.name else root) as file:
        file.seek(part.start)
        held, at, more, begun, look = b"", part.start, True, False, 0  # held begins at byte `at`, and has no mark before `look`
        while True:
            cut = held.find(mark, look)
            if cut < 0 and more:
                block = file.read(BLOCK)
                more = bool(block)
                keep = max(0, len(held) - len(mark) + 1)  # a mark may lie across blocks
                if begun:
                    look = max(len(mark), keep)
                else:
                    at, held = at + keep, held[keep:]
                held += block
                continue
            if begun:
                yield held[len(mark) : cut if cut >= 0 else len(held)]
            if cut < 0 or at + cut >= part.end:
                return
            at, held, begun, look = at + cut, held[cut:], True, len(mark)


def head(record: bytes) -> tuple[str, int | None] | None:
    """sha and time of a record, or None if it is blank."""
    lines = record.lstrip().split(b"\n", 3)
    if lines == [b""]:
        return None
    when = lines[2].strip() if len(lines) > 2 else b""
    return lines[0].strip().decode(errors="replace"), int(when) if re.fullmatch(rb"[+-]?\d+", when) else None


class LogReader(DataSourceReader):
    """Reads byte ranges of the files that the pushed filters leave."""

    def __init__(self, options: dict):
        self.path, self.mark = options["path"], options.get("mark", COMMIT_MARK).encode()
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.low, self.high, self.shas = float("-inf"), float("inf"), None

    def pushFilters(self, filters):
        """Take over comparisons of timestamp and equality of sha; all others are handed back."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("timestamp",) and isinstance(value, int):
                if isinstance(f, GreaterThan):
                    self.low = max(self.low, value + 1)
                elif isinstance(f, GreaterThanOrEqual):
                    self.low = max(self.low, value)
                elif isinstance(f, LessThan):
                    self.high = min(self.high, value - 1)
                elif isinstance(f, LessThanOrEqual):
                    self.high = min(self.high, value)
                elif isinstance(f, EqualTo):
                    self.low, self.high = max(self.low, value), min(self.high, value)
                else:
                    yield f
            elif column == ("sha",) and isinstance(f, (EqualTo, In)):
                some = {*value} if isinstance(f, In) else {value}
                self.shas = some if self.shas is None else self.shas & some
            else:
                yield f

    def partitions(self):
        found = []
        for name, size in files_of(self.path):
            first, last = window_of(name)
            if first <= self.high and last >= self.low:
                found += ranges(name, 0, size, self.split)
        return found or [Range("", 0, 0)]

    def read(self, part: Range):
        if part.end > part.start:
            bounded = (self.low, self.high) != (float("-inf"), float("inf"))
            for record in records(self.path, part, self.mark):
                found = head(record)
                if found is None or (self.shas is not None and found[0] not in self.shas):
                    continue
                if bounded and (found[1] is None or not self.low <= found[1] <= self.high):
                    continue
                yield *found, record.decode(errors="replace")


class LogStream(DataSourceStreamReader):
    """Reads what files have gained since the last batch; an offset is a JSON object of bytes read by file."""

    def __init__(self, options: dict):
        self.reader = LogReader(options)

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(dict(files_of(self.reader.path)), sort_keys=True)}

    def partitions(self, start: dict, end: dict):
        before, found = json.loads(start["files"]), []
        for name, size in json.loads(end["files"]).items():
            found += ranges(name, before.get(name, 0), size, self.reader.split)
        return found or [Range("", 0, 0)]

    def read(self, part: Range):
        return self.reader.read(part)

    def commit(self, end: dict) -> None:
        pass


class CommitLog(DataSource):
    """Format commit_log; options path, mark and splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "commit_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStream:
        return LogStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with its filters pushed down."""
    spark.dataSource.register(CommitLog)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def scan(spark: SparkSession, path: str, **options) -> DataFrame:
    """sha, timestamp and value of a log's records; filters on the first two reach the reader."""
    register(spark)
    return spark.read.format("commit_log").options(path=path, **options).load()


def commits_between(spark: SparkSession, path: str, after: int | None = None, until: int | None = None, shas: list[str] | None = None, **options) -> DataFrame:
    """Parsed commits later than `after` and not later than `until`, of the given shas; None: all."""
    rows = scan(spark, path, **options)
    if after is not None:
        rows = rows.filter(F.col("timestamp") > after)
    if until is not None:
        rows = rows.filter(F.col("timestamp") <= until)
    if shas is not None:
        rows = rows.filter(F.col("sha").isin(shas))
    return parse_records(rows)


def commits_after(spark: SparkSession, path: str, sha: str, **options) -> DataFrame:
    """Parsed commits that are newer than a known commit, by time and then sha; none if the sha is unknown."""
    base = scan(spark, path, shas=sha, **options).filter(F.col("sha") == sha).select("timestamp").first()  # at most one record is read
    if base is None:
        return commits_between(spark, path, shas=[], **options)
    later = commits_between(spark, path, after=base["timestamp"] - 1, **options)
    return later.filter((F.col("timestamp") > base["timestamp"]) | (F.col("sha") > sha))


def stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """sha, timestamp and value of records as they are appended to a log."""
    register(spark)
    return spark.readStream.format("commit_log").options(path=path, **options).load()


def write_log(records_: DataFrame, path: str, width: int, mark: str = COMMIT_MARK) -> None:
    """Write records (timestamp, value) as a folder of logs, one folder for each `width` seconds, in order of time."""
    first = F.floor(F.col("timestamp") / width) * width
    window = F.concat_ws("-", first.cast("long"), (first + width - 1).cast("long"))
    rows = records_.select(window.alias("window"), "timestamp", F.concat(F.lit(mark), F.lit("\n"), F.regexp_replace("value", r"^\s+", "")).alias("value"))
    rows.repartition("window").sortWithinPartitions("window", "timestamp").drop("timestamp").write.mode("overwrite").partitionBy("window").text(path)
