"""Keyed tables in Parquet that change together: insert if absent, upsert, delete, soft delete, rewrite of a key's rows.

A store has tables, each in buckets by a hash of its (leading) keys, and one manifest that says which
folders hold each bucket.  A transaction writes the buckets that its changes touch into folders of a new version and
puts a new manifest beside the old one last, so readers see all of its changes or none; one that fails
leaves folders that no manifest names.  A transaction may carry a batch number: a batch that is already
in is not applied again.  Rows may also be appended, as one more folder of a bucket, and folders merged
later.  Buckets can be dealt anew when a table has grown.  One writer at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.operators.graph import checkpoint

BUCKET = "key_bucket"
EMPTY = {"version": 0, "batch": None, "tables": {}, "meta": {}}


def without(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of table whose key is not in gone, null being a key like any other."""
    other = gone.select(*[F.col(k).alias(f"_{k}") for k in keys])
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return table.join(other, on, "left_anti")


def inserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table and those rows whose key it does not have, one row (the least) for each key; null is a key like any other."""
    least = rows.groupBy(*keys).agg(F.min(F.struct(*[c for c in table.columns if c not in keys] or [F.lit(0)])).alias("_r")).select(*keys, "_r.*")
    return table.unionByName(without(least, table, keys).select(*table.columns))


def upserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows in place of its rows of equal key, one row (the greatest) for each key."""
    last = rows.groupBy(*keys).agg(F.max(F.struct(*[c for c in table.columns if c not in keys] or [F.lit(0)])).alias("_r")).select(*keys, "_r.*")
    return without(table, last, keys).select(*table.columns).unionByName(last.select(*table.columns))


def deleted(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """table without the rows of the given keys."""
    return without(table, gone.select(*keys).distinct(), keys).select(*table.columns)


class Folder:
    """A folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self) -> list[str]:
        if not self.fs.exists(self.root):
            return []
        return [f.getPath().getName() for f in self.fs.listStatus(self.root)]

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Put a file in place at once: written under another name, then renamed; an error if it is there."""
        out = self.fs.create(self.at(f"_{name}"), True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(self.at(name)) or not self.fs.rename(self.at(f"_{name}"), self.at(name)):
            raise FileExistsError(f"{self.path}/{name}: another writer was here")

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


class Store:
    """Tables below a folder, and the manifest that names their files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.kinds: dict[str, tuple[StructType, list[str], int]] = {}
        self.leading: dict[str, list[str]] = {}
        self.manifests = Folder(spark, f"{path}/manifests")

    def define(self, table: str, schema: str, keys: list[str], buckets: int = 64, by: int | None = None) -> None:
        """Say what a table is; it is empty until something is written to it.

        by: so many leading keys say the bucket (None: all).  buckets counts for a new table only.
        """
        self.kinds[table], self.leading[table] = (StructType.fromDDL(schema), keys, buckets), keys[:by]

    def versions(self) -> list[int]:
        """Versions whose manifest is there, oldest first."""
        return sorted(int(n.removesuffix(".json")) for n in self.manifests.names() if n.endswith(".json") and n[0] not in "._")

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, of the last if none is named."""
        found = self.versions()
        if not found:
            return EMPTY
        return json.loads(self.manifests.read(f"{version if version is not None else found[-1]:08d}.json"))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """Rows of a table as of a version."""
        return self._rows(table, self.manifest(version))

    def meta(self) -> dict:
        return self.manifest()["meta"]

    def _rows(self, table: str, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = self.kinds[table][0]
        at = manifest["tables"].get(table, {"folders": {}})["folders"]
        folders = [f for b, some in at.items() if buckets is None or int(b) in buckets for f in some]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def of_keys(self, table: str, wanted: DataFrame, version: int | None = None) -> DataFrame:
        """Rows of the buckets that some (few) values of the leading keys fall in; no other folder is opened."""
        tx = Transaction(self, None, {}, version)
        touched = [r[0] for r in wanted.select(tx._bucket(table)).distinct().collect()]  # at most as many as buckets
        return self._rows(table, tx.manifest, touched)

    def begin(self, batch: int | None = None, meta: dict | None = None) -> Transaction:
        """A transaction; to be used with `with`, its `done` saying whether the batch is in already."""
        return Transaction(self, batch, meta or {})

    def rebucket(self, table: str, buckets: int) -> None:
        """Deal a table's rows to so many buckets, at once for all readers."""
        with self.begin() as tx:
            rows = checkpoint(tx.read(table))
            tx.manifest["tables"][table] = {"buckets": buckets, "folders": {}}
            tx._put(table, rows, None)

    def merge(self, table: str, most: int = 8, how=None) -> None:
        """Make one folder of each bucket that has more than `most`, its rows changed by `how` (rows to rows)."""
        with self.begin() as tx:
            full = [int(b) for b, some in tx._of(table)["folders"].items() if len(some) > most]
            if full:
                rows = self._rows(table, tx.manifest, full)
                tx._put(table, how(rows) if how else rows, full)

    def vacuum(self, keep: int = 2) -> None:
        """Delete what the last `keep` manifests do not name."""
        found = self.versions()
        last = [self.manifest(v) for v in found[-keep:]]
        for v in found[:-keep]:
            self.manifests.delete(f"{v:08d}.json")
        for table in self.kinds:
            used = {f.split("/")[1] for m in last for some in m["tables"].get(table, {"folders": {}})["folders"].values() for f in some}
            folder = Folder(self.spark, f"{self.path}/{table}")
            for name in folder.names():
                if name not in used:
                    folder.delete(name)


class Transaction:
    """Changes of a store's tables that become visible together."""

    def __init__(self, store: Store, batch: int | None, meta: dict, version: int | None = None):
        self.store, self.batch = store, batch
        self.manifest = json.loads(json.dumps(store.manifest(version)))
        self.done = batch is not None and self.manifest["batch"] is not None and batch <= self.manifest["batch"]
        self.base = self.manifest["version"]
        # folders of a version that never came to be are written over
        self.version, self.step = self.base + 1, 0
        self.manifest["meta"] |= meta

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None and not self.done:
            self.commit()

    def commit(self) -> None:
        if self.store.manifest()["version"] != self.base:
            raise FileExistsError(f"{self.store.path}: another writer committed meanwhile")
        self.manifest |= {"version": self.version} | ({"batch": self.batch} if self.batch is not None else {})
        self.store.manifests.write(f"{self.version:08d}.json", json.dumps(self.manifest, sort_keys=True))
        self.done = True

    def read(self, table: str) -> DataFrame:
        """Rows of a table with what this transaction has changed so far."""
        return self.store._rows(table, self.manifest)

    def _of(self, table: str) -> dict:
        return self.manifest["tables"].setdefault(table, {"buckets": self.store.kinds[table][2], "folders": {}})

    def _bucket(self, table: str) -> Column:
        keys = self.store.leading[table]
        marked = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for k in keys]
        return F.pmod(F.xxhash64(*marked), F.lit(self._of(table)["buckets"])).cast("int")

    def _put(self, table: str, rows: DataFrame, touched: list[int] | None, spread: bool = True) -> None:
        """Write rows as all that the touched buckets hold (None: all buckets; none: beside what they hold).

        A bucket's rows are spread by key over as many tasks as their size asks for.  The bucket follows from
        the keys, so rows that were just grouped by them are not shuffled again.  spread=False: each task
        writes the rows it has, for rows that are dealt over tasks by other columns already.
        """
        of, (schema, keys, _) = self._of(table), self.store.kinds[table]
        self.step += 1
        folder = f"{table}/v={self.version:08d}-{self.step}"
        out = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]).withColumn(BUCKET, self._bucket(table))
        out = out.repartition(*keys) if spread else out
        out.sortWithinPartitions(BUCKET, *keys).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.store.path}/{folder}")
        for b in touched if touched is not None else list(of["folders"]):
            of["folders"].pop(str(b), None)
        for name in Folder(self.store.spark, f"{self.store.path}/{folder}").names():
            if name.startswith(f"{BUCKET}="):
                of["folders"].setdefault(name.removeprefix(f"{BUCKET}="), []).append(f"{folder}/{name}")

    def change(self, table: str, rows: DataFrame, change) -> None:
        """Apply change(rows of the touched buckets, rows); rows need the keys of the table."""
        if self.done:
            return
        rows = checkpoint(rows)
        touched = [r[0] for r in rows.select(self._bucket(table)).distinct().collect()]  # at most as many as buckets
        if touched:
            self._put(table, change(self.store._rows(table, self.manifest, touched), rows), touched)

    def append(self, table: str, rows: DataFrame, spread: bool = True) -> None:
        """Add rows without a look at those that are there; spread=False: without a shuffle."""
        if not self.done:
            self._put(table, rows, [], spread)

    def insert_absent(self, table: str, rows: DataFrame) -> None:
        """Add rows whose key is not there yet."""
        schema, keys, _ = self.store.kinds[table]
        self.change(table, rows.select(*schema.names), lambda old, new: inserted(old, new, keys))

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Add rows in place of those with equal keys."""
        schema, keys, _ = self.store.kinds[table]
        self.change(table, rows.select(*schema.names), lambda old, new: upserted(old, new, keys))

    def delete(self, table: str, gone: DataFrame) -> None:
        """Take out the rows of the keys."""
        keys = self.store.kinds[table][1]
        self.change(table, gone.select(*keys), lambda old, some: deleted(old, some, keys))

    def mark(self, table: str, some: DataFrame, column: str, value) -> None:
        """Set a column of the rows of the keys (a soft delete: alive to false)."""
        schema, keys, _ = self.store.kinds[table]

        def set_(old: DataFrame, hit: DataFrame) -> DataFrame:
            changed = old.join(hit.distinct().toDF(*[f"_{k}" for k in keys]), self._equal(keys), "left_semi")
            return without(old, hit, keys).unionByName(changed.withColumn(column, F.lit(value).cast(schema[column].dataType)))

        self.change(table, some.select(*keys), set_)

    @staticmethod
    def _equal(keys: list[str]) -> Column:
        out = F.lit(True)
        for k in keys:
            out &= F.col(k).eqNullSafe(F.col(f"_{k}"))
        return out

    def rewrite(self, table: str, part: list[str], rows: DataFrame, parts: DataFrame | None = None) -> None:
        """Put rows in place of all rows that have the same values in `part`, some of the keys (a commit's links, a file's tags).

        parts: the values to clear, where some are to lose all their rows; None: those of rows.
        """
        if self.done:
            return
        schema, keys, _ = self.store.kinds[table]
        wanted, new = (parts if parts is not None else rows).select(*part).distinct(), checkpoint(rows.select(*schema.names))
        if set(self.store.leading[table]) <= set(part):  # only the buckets of the parts are read
            wanted = wanted.unionByName(new.select(*part)).distinct()
            self.change(table, wanted, lambda old, some: upserted(without(old, some, part), new, keys))
            return
        old = self.read(table).join(wanted.toDF(*[f"_{k}" for k in part]), self._equal(part), "left_semi").select(*keys)
        self.change(table, old.unionByName(new.select(*keys)).distinct(), lambda table_, gone: upserted(deleted(table_, gone, keys), new, keys))


class KeyedTable:
    """A store of one table, each change a transaction of its own."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64):
        self.store = Store(spark, path)
        self.store.define("rows", schema, keys, buckets)

    def create(self) -> None:
        """An empty table, unless there is one."""
        if not self.store.versions():
            self.store.begin().commit()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the table."""
        return self.store.read("rows", version)

    def insert_absent(self, rows: DataFrame) -> None:
        with self.store.begin() as tx:
            tx.insert_absent("rows", rows)

    def upsert(self, rows: DataFrame) -> None:
        with self.store.begin() as tx:
            tx.upsert("rows", rows)

    def delete(self, keys: DataFrame) -> None:
        with self.store.begin() as tx:
            tx.delete("rows", keys)

    def mark(self, keys: DataFrame, column: str, value) -> None:
        with self.store.begin() as tx:
            tx.mark("rows", keys, column, value)

    def rewrite(self, part: list[str], rows: DataFrame, parts: DataFrame | None = None) -> None:
        with self.store.begin() as tx:
            tx.rewrite("rows", part, rows, parts)
