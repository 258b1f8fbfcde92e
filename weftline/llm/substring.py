"""Removal of passages that repeat across documents, by Rabin-Karp hashes of fixed-length windows.

Every window of `window` words gets a rolling hash.  Shuffling one row for each word of a corpus
would move more than the corpus, so windows are thinned first, without loss:

1.  A window's anchor is the least hash among the short windows (`anchor` words) inside it.  Equal
    windows have equal anchors, and neighbouring windows mostly share theirs, so a document has few.
    Anchors are counted in Spark; only documents with an anchor that another document has go on.
2.  Neighbouring windows with one anchor form a run.  The hash of all words of a run is counted; a
    run that a smaller document has too is removed whole, as each of its windows occurs there.
3.  Of the runs left, those whose anchor two documents still have give their windows' hashes to be
    counted one by one.  Runs removed in step 2 need not stand for others here: the smallest
    document with such a run keeps it among the runs left.

Covered words of removed windows merge into maximal intervals.  Hashes have 128 bits.  Counting is
min/max aggregation, combined before each shuffle, so a passage in a third of all documents is one
row for each task; per document only that document's own anchors, runs and starts are gathered.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, parts, reliable, table

#: Rows that a key may always have before it counts as hot, and ids up to which they are broadcast.
HOT_ROWS, FEW = 1000, 1_000_000

#: Odd multipliers of the two rolling hashes (mod 2**64).
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Seed of the second hash of a word, so that words that collide in one do not in the other.
SECOND_SEED = 1


def mixed(h):
    """Finish a hash so that all bits depend on all others."""
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Rolling hashes of word windows; powers of the bases are kept and grow on demand."""

    def __init__(self):
        import numpy as np
        import xxhash

        self.np, self.word = np, xxhash.xxh3_64_intdigest
        self.room = 0

    def _grow(self, n: int) -> None:
        np = self.np
        self.room = max(n + 1, 2 * self.room, 1 << 14)

        def powers(base):
            p = np.full(self.room, base, dtype=np.uint64)
            p[0] = 1
            return np.cumprod(p)

        self.up = [powers(b) for b in BASES]
        self.down = [powers(pow(b, -1, 1 << 64)) for b in BASES]

    def sums(self, words: list[bytes], both: bool):
        """Prefix sums from which the hash of any window follows, one array for each hash."""
        np, n = self.np, len(words)
        if n >= self.room:
            self._grow(n)
        out = []
        for k in range(1 + both):
            word = (lambda w: self.word(w, SECOND_SEED)) if k else self.word
            s = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(np.fromiter(map(word, words), dtype=np.uint64, count=n) * self.up[k][:n], out=s[1:])
            out.append(s)
        return out

    def span(self, sums, k: int, start, end):
        """Hash k of the words from start to end (arrays), the same wherever they stand."""
        return mixed((sums[k][end] - sums[k][start]) * self.down[k][start])

    def anchors(self, sums, n: int, window: int, anchor: int):
        """Anchor of every window of n words."""
        np = self.np
        at = np.arange(n - anchor + 1)
        m, have, want = self.span(sums, 0, at, at + anchor), 1, window - anchor + 1
        while have < want:
            step = min(have, want - have)
            m = np.minimum(m[:-step], m[step:])
            have += step
        return m


def runs_of(anchor_of):
    """First and one past the last window of each run of neighbours with one anchor."""
    import numpy as np

    change = (anchor_of[1:] != anchor_of[:-1]).nonzero()[0] + 1
    return np.concatenate(([0], change)), np.concatenate((change, [len(anchor_of)]))


def covered(n: int, starts, ends):
    """Maximal intervals covered by half-open intervals over n places, as a boolean array."""
    import numpy as np

    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, ends, 1)
    return np.cumsum(edge[:-1]) > 0


def with_shared(rows: DataFrame, n_rows: int, *keys: str, how: str = "inner") -> DataFrame:
    """rows with lo, the smallest doc_id of their keys, for keys that two documents have (others: dropped, or null if how is left).

    A key with more than a thousandth of all rows is hot; there are at most a thousand, so they are
    broadcast and their rows stay where they are.  Only rows of other keys are shuffled, and no task
    gets many of one key.
    """
    found = rows.groupBy(*keys).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).filter("lo < hi").drop("hi")
    found, most = reliable(found), max(HOT_ROWS, n_rows // 1000)
    hot = F.broadcast(found.filter(F.col("n") > most).select(*keys, "lo"))
    cold = found.filter(F.col("n") <= most).select(*keys, "lo")
    return rows.join(hot, list(keys)).unionByName(rows.join(hot, list(keys), "left_anti").join(cold, list(keys), how))


def remove_repeats(docs: DataFrame, window: int = 50, anchor: int = 20, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (text) and removed ([start, end) word intervals).

    A word goes if a window of `window` words that covers it also starts in a document with a
    smaller doc_id.  kept is the words left, joined by one space, or null where nothing went.
    Null and empty texts have no words; documents shorter than a window and documents without
    doc_id neither lose words nor make others lose any; rows with one doc_id count as one document
    for comparison and each gets its own result; an empty table gives none; other columns are ignored.
    """
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("row_key", F.xxhash64("doc_id", "text"))

    def scan(batches):
        import numpy as np
        import pyarrow as pa

        roll = Rolling()
        for batch in (part for whole in batches for part in parts(whole, 2)):
            n, sha, found = [], [], []
            for raw in as_bytes(batch.column(2)):
                words = raw.split()
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                found.append(np.unique(roll.anchors(roll.sums(words, False), len(words), window, anchor)).view(np.int64) if len(words) >= window else np.empty(0, np.int64))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "row_key": batch.column(1), "n_words": pa.array(n, pa.int64()), "sha": pa.array(sha), "anchors": pa.array(found, pa.list_(pa.int64()))})

    summary = reliable(base.select("doc_id", "row_key", "text").mapInArrow(scan, "doc_id long, row_key long, n_words long, sha string, anchors array<long>"))

    marks = summary.filter("doc_id is not null").select("doc_id", "row_key", F.explode("anchors").alias("mark"))
    n_marks = summary.agg(F.coalesce(F.sum(F.size("anchors")), F.lit(0)).alias("n")).first()["n"]
    wanted = reliable(with_shared(marks, n_marks, "mark").groupBy("doc_id", "row_key").agg(F.collect_set("mark").alias("marks")))
    asked = base.filter("doc_id is not null")
    if wanted.count() <= FEW:  # 16 bytes a row: other documents' texts then stay where they are
        asked = asked.join(F.broadcast(wanted.select("doc_id", "row_key")), ["doc_id", "row_key"], "left_semi")

    def pack(batches):
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        for batch in (part for whole in batches for part in parts(whole, 2)):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "row_key": batch.column(1), "packed": pa.array([press(t) for t in as_bytes(batch.column(2))], pa.binary())})

    packed = asked.select("doc_id", "row_key", "text").mapInArrow(pack, "doc_id long, row_key long, packed binary")
    affected = reliable(packed.join(wanted, ["doc_id", "row_key"]))

    def unpacked(batch, *lists: str):
        """Ids, words and the named list columns of each row of a batch of affected documents."""
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        columns = [batch.column(c).to_pylist() for c in ("doc_id", "row_key", "packed", "marks", *lists)]
        for doc, key, blob, marks_, *more in zip(*columns):
            yield doc, key, expand(blob).split(), marks_, more

    def candidates(roll, words, marks_):
        """Prefix sums, and of the runs with a shared anchor: ordinal, anchor, first and end window."""
        import numpy as np

        sums = roll.sums(words, True)
        of = roll.anchors(sums, len(words), window, anchor)
        first, end = runs_of(of)
        run = np.isin(of[first].view(np.int64), np.array(marks_, dtype=np.int64)).nonzero()[0]
        return sums, run, of[first[run]], first[run], end[run]

    def emit(doc, key, **columns):
        import numpy as np
        import pyarrow as pa

        n = len(next(iter(columns.values())))
        same = {"doc_id": pa.array(np.full(n, doc, dtype=np.int64)), "row_key": pa.array(np.full(n, key, dtype=np.int64))}
        return pa.RecordBatch.from_pydict(same | {k: pa.array(v.view(np.int64) if v.dtype == np.uint64 else v.astype(np.int32)) for k, v in columns.items()})

    def joined(made):
        """Small record batches put together."""
        import pyarrow as pa

        held, rows = [], 0
        for one in made:
            held.append(one)
            rows += one.num_rows
            if rows >= 20_000:
                yield pa.concat_batches(held)
                held, rows = [], 0
        if held:
            yield pa.concat_batches(held)

    def to_runs(batches):
        roll = Rolling()

        def made():
            for batch in batches:
                for doc, key, words, marks_, _ in unpacked(batch):
                    sums, run, mark, first, end = candidates(roll, words, marks_)
                    yield emit(doc, key, run=run, mark=mark, h1=roll.span(sums, 0, first, end - 1 + window), h2=roll.span(sums, 1, first, end - 1 + window))

        yield from joined(made())

    runs = reliable(affected.mapInArrow(to_runs, "doc_id long, row_key long, run int, mark long, h1 long, h2 long"))
    n_runs = runs.count()
    judged = reliable(with_shared(runs, n_runs, "h1", "h2", how="left").select("doc_id", "row_key", "run", "mark", F.coalesce(F.col("doc_id") > F.col("lo"), F.lit(False)).alias("whole")))
    left = judged.filter("not whole")
    doubtful = with_shared(left, n_runs, "mark").select("doc_id", "row_key", "run", F.lit(False).alias("whole"))
    todo = judged.filter("whole").select("doc_id", "row_key", "run", "whole").unionByName(doubtful)
    todo = todo.groupBy("doc_id", "row_key").agg(F.collect_set(F.when(F.col("whole"), F.col("run"))).alias("gone"), F.collect_set(F.when(~F.col("whole"), F.col("run"))).alias("open"))
    work = reliable(affected.join(todo, ["doc_id", "row_key"]))

    def to_windows(batches):
        import numpy as np

        roll = Rolling()

        def made():
            for batch in batches:
                for doc, key, words, marks_, (open_,) in unpacked(batch, "open"):
                    if not open_:
                        continue
                    sums, run, _, first, end = candidates(roll, words, marks_)
                    pick = np.isin(run, np.array(open_))
                    size = end[pick] - first[pick]
                    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[pick], size)
                    yield emit(doc, key, start=at, h1=roll.span(sums, 0, at, at + window), h2=roll.span(sums, 1, at, at + window))

        yield from joined(made())

    windows = reliable(work.mapInArrow(to_windows, "doc_id long, row_key long, start int, h1 long, h2 long"))
    starts = with_shared(windows, windows.count(), "h1", "h2").filter("doc_id > lo").groupBy("doc_id", "row_key").agg(F.collect_set("start").alias("starts"))

    def finish(batches):
        import numpy as np
        import pyarrow as pa

        roll = Rolling()
        for batch in (part for whole in batches for part in parts(whole, 2, 1 << 20)):
            out: dict[str, list] = {k: [] for k in ("doc_id", "row_key", "n_removed", "kept", "removed")}
            for doc, key, words, marks_, (gone, starts_) in unpacked(batch, "gone", "starts"):
                _, run, _, first, end = candidates(roll, words, marks_)
                whole = np.isin(run, np.array(gone, dtype=np.int64))
                at = np.array(starts_ or [], dtype=np.int64)
                off = covered(len(words), np.concatenate((first[whole], at)), np.concatenate((end[whole] - 1 + window, at + window)))
                edge = np.diff(np.concatenate(([0], off.astype(np.int8), [0])))
                out["doc_id"].append(doc)
                out["row_key"].append(key)
                out["n_removed"].append(int(off.sum()))
                out["kept"].append(b" ".join([w for w, o in zip(words, off.tolist()) if not o]))
                out["removed"].append(np.column_stack(((edge == 1).nonzero()[0], (edge == -1).nonzero()[0])).tolist())
            types = {"doc_id": pa.int64(), "row_key": pa.int64(), "n_removed": pa.int64(), "kept": pa.binary(), "removed": pa.list_(pa.list_(pa.int32()))}
            columns = {k: pa.array(v, types[k]) for k, v in out.items()}
            columns["kept"] = columns["kept"].cast(pa.string())
            columns["sha"] = pa.array([hashlib.sha256(k).hexdigest() for k in out["kept"]], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    cut = work.join(starts, ["doc_id", "row_key"], "left").mapInArrow(finish, "doc_id long, row_key long, n_removed long, kept string, removed array<array<int>>, sha string")
    cut = cut.dropDuplicates(["doc_id", "row_key"]).withColumnRenamed("sha", "cut_sha")
    return summary.drop("anchors").join(cut, ["doc_id", "row_key"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("cut_sha", "sha").alias("kept_sha256"), "kept", "removed"
    )


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
