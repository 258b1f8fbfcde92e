"""Helpers shared by the training-data operators: table access, checkpoints, worker-side state."""

from __future__ import annotations

import sys
import tempfile
import types

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import weftline

# Functions shipped to executors travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(weftline)

#: Rows that a key may always have before it counts as hot.
HOT_ROWS = 1000

#: Fixed value: what counts as a word wherever a contract speaks of words.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table through Spark, whatever file system holds it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reliable(df: DataFrame) -> DataFrame:
    """Cut lineage with a replicated checkpoint in the shared folder named by the session.

    A temporary folder is set only where the session names none and all runs on one machine; a
    cluster without a named folder is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weftline-"))
    return df.checkpoint(eager=True)


def with_hot(rows: DataFrame, one: DataFrame, keys: list[str], n_rows: int, how: str = "inner") -> DataFrame:
    """rows joined to one by keys; one.n says how many of the n_rows rows have its key.

    A key with more than a thousandth of all rows is hot; there are at most a thousand, so they are
    broadcast and their rows stay where they are.  Only rows of other keys are shuffled, and no task
    gets many of one key.
    """
    most = max(HOT_ROWS, n_rows // 1000)
    hot = F.broadcast(one.filter(F.col("n") > most).drop("n"))
    cold = one.filter(F.col("n") <= most).drop("n")
    return rows.join(hot, keys).unionByName(rows.join(hot, keys, "left_anti").join(cold, keys, how), allowMissingColumns=True)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the third of documents that no model may learn from; a null id is held out too."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce((F.crc32(c.cast("string").cast("binary")) % 3) == 1, F.lit(True))


def n_words(text: str | Column = "text") -> Column:
    """Number of words of a text, 0 for null, computed in the JVM.

    A word starts at every non-blank preceded by a blank or by the start: replacing each word by
    one character and dropping blanks leaves a string whose length is the count.
    """
    c = F.col(text) if isinstance(text, str) else text
    blank = r"[\x20\x09-\x0D]+"
    marked = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\x20\x09-\x0D]++", "w"), blank, "")
    return F.length(marked).cast("long")


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker, for tables loaded once per process."""
    mod = sys.modules.setdefault("_weftline_worker", types.ModuleType("_weftline_worker"))
    return mod.__dict__.setdefault("state", {})


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that columns an operator adds cannot clash with them."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns])


def parts(batch, column: int, most: int = 2 << 20):
    """Slices of an Arrow batch with at most so many bytes in a string or binary column, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // most
    cut = (part[1:] != part[:-1]).nonzero()[0] + 1
    for i, j in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
        if j > i:
            yield batch.slice(i, j - i)
    give_back()


def give_back() -> None:
    """Return freed memory to the system; workers are reused, and an executor's memory is shared."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def as_bytes(column) -> list:
    """Arrow string column to a list of bytes; nulls become empty."""
    import pyarrow as pa

    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]
