"""Exact de-duplication with a cuckoo-filter index of the digests of live texts.

A text's digest belongs to a shard; a shard has a cuckoo filter over its live digests and, bucketed by
digest, their contents (packed).  A digest that the filter does not know is new and is inserted without
a look at the contents; a hit is compared with the contents in its bucket.  Deleting a text takes its
fingerprint out of the filter.  A filter that overflows is built anew, twice as large, from the digests
stored in the buckets, as fingerprints alone do not say where a digest would go.

Copies that a task meets are put together before anything is shuffled, so a text in a third of all
rows is one row for each task and slice.  Each such row has an id (op), and documents find their
class by it, so no join is on a hot key.  Shards are as many as the packed bytes ask for.
"""

from __future__ import annotations

import hashlib
from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, parts, reliable, table

#: Packed bytes and digests of a shard, and packed bytes and digests that a scanning task holds.
SHARD_BYTES, SHARD_KEYS, HELD_BYTES, HELD_KEYS = 16 << 20, 50_000, 8 << 20, 50_000

SCANNED = "op long, row_no long, doc_id long, sha string, digest binary, packed binary, n long"
LIVE = "shard int, digest binary, packed binary, doc_id long, row_no long, n long, slots binary"
APPLIED = f"{LIVE}, op long, known boolean"


class CuckooFilter:
    """A multiset of fingerprints in buckets of four; a digest may lie in either of two buckets."""

    SLOTS, KICKS, MIX = 4, 200, 0x5BD1E995

    def __init__(self, buckets: int = 64):
        self.mask = buckets - 1
        self.slots = array("H", bytes(2 * self.SLOTS * buckets))

    @classmethod
    def of(cls, digests, buckets: int) -> CuckooFilter:
        """A filter of at least so many buckets that holds all digests (distinct)."""
        while True:
            made = cls(buckets)
            if all(map(made.add, digests)):
                return made
            buckets *= 2

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        made = cls(len(raw) // (2 * cls.SLOTS))
        made.slots = array("H", raw)
        return made

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "big") or 1
        at = int.from_bytes(digest[:8], "big") & self.mask
        return mark, at, at ^ (mark * self.MIX & self.mask)

    def _find(self, mark: int, bucket: int) -> int:
        """Slot of the bucket that holds a mark (0: a free one), or -1."""
        at = bucket * self.SLOTS
        for k in range(at, at + self.SLOTS):
            if self.slots[k] == mark:
                return k
        return -1

    def __contains__(self, digest: bytes) -> bool:
        mark, one, two = self._places(digest)
        return self._find(mark, one) >= 0 or self._find(mark, two) >= 0

    def add(self, digest: bytes) -> bool:
        """Insert a digest; False: there was no room, a fingerprint is lost and the filter is to be built anew."""
        mark, one, two = self._places(digest)
        for bucket in (one, two):
            if (k := self._find(0, bucket)) >= 0:
                self.slots[k] = mark
                return True
        bucket = two
        for kick in range(self.KICKS):
            k = bucket * self.SLOTS + (mark + kick) % self.SLOTS
            mark, self.slots[k] = self.slots[k], mark
            bucket ^= mark * self.MIX & self.mask
            if (k := self._find(0, bucket)) >= 0:
                self.slots[k] = mark
                return True
        return False

    def discard(self, digest: bytes) -> None:
        """Take one fingerprint of a digest out; only for digests that are in."""
        mark, one, two = self._places(digest)
        for bucket in (one, two):
            if (k := self._find(mark, bucket)) >= 0:
                self.slots[k] = 0
                return


class Shard:
    """The filter and the bucketed contents of a shard; a content is [packed, doc_id, row_no, n]."""

    def __init__(self, filter_: CuckooFilter | None = None):
        self.filter, self.contents = filter_ or CuckooFilter(), {}

    def hit(self, digest: bytes, packed: bytes):
        """The live content equal to packed, or None; contents are looked at only if the filter knows the digest."""
        if digest in self.filter:
            for content in self.contents.get(digest, ()):
                if content[0] == packed:
                    return content
        return None

    def insert(self, digest: bytes, packed: bytes, doc_id, row_no: int, n: int):
        """The content after so many rows with it came, whose largest is (doc_id, row_no); and whether it was live before."""
        content = self.hit(digest, packed)
        if content is None:
            content = [packed, doc_id, row_no, n]
            others = self.contents.setdefault(digest, [])
            others.append(content)
            if len(others) == 1 and not self.filter.add(digest):
                self.filter = CuckooFilter.of(self.contents, 2 * (self.filter.mask + 1))
            return content, False
        content[3] += n
        if larger(doc_id, row_no) > larger(content[1], content[2]):
            content[1:3] = doc_id, row_no
        return content, True

    def delete(self, digest: bytes, packed: bytes):
        """The content taken out, or None if it is not live."""
        content = self.hit(digest, packed)
        if content is not None:
            self.contents[digest].remove(content)
            if not self.contents[digest]:
                del self.contents[digest]
                self.filter.discard(digest)
        return content


def larger(doc_id, row_no):
    """Order of documents: by doc_id, null first, then by row."""
    return doc_id is not None, doc_id, row_no


def scanned(docs: DataFrame, text: str = "text", digest=hashlib.sha256) -> DataFrame:
    """Checkpointed rows of two kinds: documents (op, row_no, doc_id, sha), and ops (op, digest, packed, n, and
    the largest doc_id and row_no among them): texts that a task met, each once for a slice of its rows."""
    base = docs.select(F.monotonically_increasing_id().alias("row_no"), docs["doc_id"].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))

    def run(batches):
        import pyarrow as pa
        import zstandard

        press, held, room = zstandard.ZstdCompressor(level=1).compress, {}, HELD_BYTES
        types = {"op": pa.int64(), "row_no": pa.int64(), "doc_id": pa.int64(), "sha": pa.string(), "digest": pa.binary(), "packed": pa.binary(), "n": pa.int64()}
        shape = lambda **columns: pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(len(columns["op"]), t) for k, t in types.items()], names=list(types))

        def ops():
            ids, rows, docs_, keys, blobs, ns = zip(*held.values())
            held.clear()
            return shape(op=ids, row_no=rows, doc_id=docs_, digest=keys, packed=blobs, n=ns)

        for batch in (part for whole in batches for part in parts(whole, 2)):
            out_op, out_sha = [], []
            rows, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row, doc, raw in zip(rows, ids, as_bytes(batch.column(2))):
                low = raw.lower()  # of bytes: A-Z only
                key, packed = digest(low), press(low)
                at = key.digest(), packed
                if at not in held:
                    held[at] = [row, row, doc, *at, 0]
                    room -= len(packed)
                found = held[at]
                found[5] += 1
                if larger(doc, row) > larger(found[2], found[1]):
                    found[1:3] = row, doc
                out_op.append(found[0])
                out_sha.append(key.hexdigest())
            yield shape(op=out_op, row_no=rows, doc_id=ids, sha=out_sha)
            if room <= 0 or len(held) >= HELD_KEYS:
                yield ops()
                room = HELD_BYTES
        if held:
            yield ops()

    return reliable(base.mapInArrow(run, SCANNED))


def applied(live: DataFrame, ops: DataFrame, shards: int, delete: bool = False, look: bool = False, keep: bool = True) -> DataFrame:
    """What each op (op, digest, packed, doc_id, row_no, n) meets in its shard of the index, and the index after it (keep).

    Rows with an op: known (the content was live before) and its doc_id, row_no and n; with `look` as
    before, null if not live.  Rows without: as in `live`, where a row without digest holds the filter.
    """
    part = F.conv(F.hex(F.substring("digest", 11, 4)), 16, 10).cast("long") % shards
    ops = ops.select(part.cast("int").alias("shard"), "op", "digest", "packed", "doc_id", "row_no", "n")

    def run(key, old, new):
        import pyarrow as pa

        blank = [r["slots"] for r in old.select(["slots"]).to_pylist() if r["slots"] is not None]
        shard = Shard(CuckooFilter.from_bytes(blank[0]) if blank else None)
        for r in old.to_pylist():
            if r["digest"] is not None:
                shard.contents.setdefault(r["digest"], []).append([r["packed"], r["doc_id"], r["row_no"], r["n"]])
        met, old_contents = [], {id(c) for contents in shard.contents.values() for c in contents}
        for r in sorted(new.to_pylist(), key=lambda r: r["op"]):
            if delete or look:
                content = (shard.delete if delete else shard.hit)(r["digest"], r["packed"])
                met.append((r["op"], content is not None, content))
            else:
                content, _ = shard.insert(r["digest"], r["packed"], r["doc_id"], r["row_no"], r["n"])
                met.append((r["op"], id(content) in old_contents, content))
        rows = [(key[0].as_py(), None, None, *(c[1:] if c else (None, None, None)), None, op, known) for op, known, c in met]
        if keep:
            rows += [(key[0].as_py(), d, *c, None, None, None) for d, contents in shard.contents.items() for c in contents]
            rows.append((key[0].as_py(), None, None, None, None, None, shard.filter.to_bytes(), None, None))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_())
        names = ["shard", "digest", "packed", "doc_id", "row_no", "n", "slots", "op", "known"]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return live.groupBy("shard").cogroup(ops.groupBy("shard")).applyInArrow(run, APPLIED)


def shards_for(ops: DataFrame) -> int:
    """Shards that so many ops need."""
    size = ops.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("packed")), F.lit(0)).alias("b")).first()
    return max(1, -(-size["b"] // SHARD_BYTES), -(-size["n"] // SHARD_KEYS))


def exact_groups(docs: DataFrame, text: str = "text", digest=hashlib.sha256, shards: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row; texts are equal if equal after A-Z are lower-cased.

    Of equal texts the row with the largest doc_id stays; rows without doc_id come before all others,
    and of rows with one doc_id the last read stays, so exactly one row of a group is kept.  Null and
    empty texts are equal; other columns are ignored; an empty table gives none.
    """
    rows = scanned(docs, text, digest)
    ops = rows.filter("n is not null")
    live = docs.sparkSession.createDataFrame([], LIVE)
    met = applied(live, ops, shards or shards_for(ops), keep=False)
    # an op sees its class as it is when the op comes; the last one sees all of it
    last = met.select("op", F.col("doc_id").alias("keep_id"), F.col("row_no").alias("keep_row"), F.col("n").alias("group_size"))
    return (
        rows.filter("n is null").join(last, "op")
        .select("doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))
    )


def drop_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the rows that exact_groups does not keep, all columns as they are."""
    sha = lambda c: F.sha2(F.translate(F.coalesce(c.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256)
    stay = exact_groups(docs, text).filter("kept").select(F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("keep_sha"))
    whole = docs.select(docs["doc_id"].cast("long").alias("row_id"), sha(docs[text]).alias("row_sha"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    same = (F.col("row_sha") == F.col("keep_sha")) & F.col("row_id").eqNullSafe(F.col("keep_id"))
    one = whole.join(stay, same, "left_semi").groupBy("row_id", "row_sha").agg(F.any_value("row").alias("row"))
    return one.select("row.*")


class CuckooIndex:
    """A stored index of live texts: batches of documents are inserted, looked up and deleted.

    A change writes a new version beside the old one, whose folder counts once its marker of success
    is there; a change that fails leaves the version before.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = 64):
        self.spark, self.path, self.shards = spark, path, shards

    def _version(self) -> int:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/version=*/_SUCCESS")
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
        return max((int(f.getPath().getParent().getName().removeprefix("version=")) for f in found or []), default=0)

    def live(self) -> DataFrame:
        """The index as of its last version: contents, and for each shard a row with its filter."""
        n = self._version()
        return self.spark.read.schema(LIVE).parquet(f"{self.path}/version={n}") if n else self.spark.createDataFrame([], LIVE)

    def _answer(self, rows: DataFrame, met: DataFrame) -> DataFrame:
        answer = met.filter("op is not null").select("op", "known", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"))
        return rows.filter("n is null").join(answer, "op").select("doc_id", "known", "keep_id", "group_size")

    def _change(self, docs: DataFrame, **how) -> DataFrame:
        rows = scanned(docs)
        met = reliable(applied(self.live(), rows.filter("n is not null"), self.shards, **how))
        met.filter("op is null").drop("op", "known").repartition("shard").write.mode("overwrite").parquet(f"{self.path}/version={self._version() + 1}")
        return self._answer(rows, met)

    def insert(self, docs: DataFrame) -> DataFrame:
        """doc_id, known (live before this batch), keep_id and group_size (all rows so far) of each row."""
        return self._change(docs)

    def delete(self, docs: DataFrame) -> DataFrame:
        """Take the texts of docs out, whatever their doc_id; known says which were live."""
        return self._change(docs, delete=True)

    def lookup(self, docs: DataFrame) -> DataFrame:
        """doc_id, known, keep_id and group_size, the last two null for texts that are not live."""
        rows = scanned(docs)
        return self._answer(rows, applied(self.live(), rows.filter("n is not null"), self.shards, look=True, keep=False))


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))
