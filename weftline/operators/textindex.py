"""An inverted index with positions: postings by term and block of documents, in the buckets of a store.

A posting row holds a term's occurrences in a block of 1,024 document numbers: offsets of documents in
the block and places in the text, as two parallel arrays in order.  A frequent term is many rows, one for
each block, so no row and no task grows with the corpus.  Appending writes one more segment; segments are
merged bucket by bucket.  A search opens only the buckets of its terms, drops blocks that lack a term
before any posting is looked at, and intersects arrays inside the rows of a block; texts are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources.store import Store

BLOCK_BITS = 10
POSTINGS = "term string, block long, docs array<smallint>, places array<int>"


def define(store: Store, table: str = "postings", buckets: int = 64) -> None:
    store.define(table, POSTINGS, ["term", "block"], buckets, by=1)


def words(text: Column) -> Column:
    """Lower-case alphanumeric tokens in order, with repeats."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def _arrays(packed: Column) -> list[Column]:
    """docs and places of sorted numbers that hold an offset above a place."""
    return [F.transform(packed, lambda x: F.shiftright(x, 32).cast("smallint")).alias("docs"), F.transform(packed, lambda x: x.bitwiseAND((1 << 31) - 1).cast("int")).alias("places")]


def _packed(offset: Column, place: Column) -> Column:
    return F.shiftleft(offset.cast("long"), 32) + place


def postings(texts: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """Posting rows of texts; doc is a number of its own for each, null texts and documents without number have none.

    Texts are dealt by block, so what is shuffled is texts, not a row for each word with its place; a
    block's postings are then made where it lies, an occurrence being one number.
    """
    rows = texts.filter(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("_d"), F.shiftright(F.col(doc).cast("long"), BLOCK_BITS).alias("block"), F.col(text).alias("_t")).repartition("block")
    found = rows.select("block", F.col("_d").bitwiseAND((1 << BLOCK_BITS) - 1).alias("_o"), F.posexplode(words(F.col("_t"))).alias("_p", "term"))
    held = found.groupBy("block", "term").agg(F.sort_array(F.collect_list(_packed(F.col("_o"), F.col("_p")))).alias("_h"))
    return held.select("term", "block", *_arrays(F.col("_h")))


def merged(rows: DataFrame) -> DataFrame:
    """One row for each term and block of several segments'.

    Rows are gathered as they are, arrays and all, and sorted once they are together.
    """
    held = rows.groupBy("term", "block").agg(F.flatten(F.collect_list("docs")).alias("d"), F.flatten(F.collect_list("places")).alias("p"))
    return held.select("term", "block", F.sort_array(F.zip_with("d", "p", _packed)).alias("_h")).select("term", "block", *_arrays(F.col("_h")))


def of_terms(store: Store, terms: list[str], table: str = "postings") -> DataFrame:
    """Posting rows of some terms; only their buckets are opened, and files sorted by term are skipped inside them."""
    wanted = store.spark.createDataFrame([(t,) for t in terms], "term string")
    return store.of_keys(table, wanted).filter(F.col("term").isin(terms))


def _doc(block: Column, offset: Column) -> Column:
    return F.shiftleft(block, BLOCK_BITS) + offset


def _meet(rows: DataFrame, n: int, keys) -> DataFrame:
    """Documents of the blocks that have all n terms: keys(row) of each term's row, intersected block by block."""
    whole = rows.groupBy("block", "term").agg(F.flatten(F.collect_list("docs")).alias("docs"), F.flatten(F.collect_list("places")).alias("places"))
    blocks = whole.groupBy("block").agg(F.collect_list(keys).alias("k")).filter(F.size("k") == n)
    left = F.reduce(F.slice("k", 2, F.lit(1 << 30)), F.col("k")[0], lambda a, b: F.array_intersect(a, b))
    return blocks.select("block", F.explode(left).alias("key"))


def match_all(store: Store, terms: list[str], table: str = "postings") -> DataFrame:
    """doc of the texts that have every term; none for no terms."""
    terms = list(dict.fromkeys(terms))
    if not terms:
        return store.spark.createDataFrame([], "doc long")
    hits = _meet(of_terms(store, terms, table), len(terms), F.array_distinct("docs"))
    return hits.select(_doc(F.col("block"), F.col("key")).alias("doc"))


def match_phrase(store: Store, terms: list[str], table: str = "postings") -> DataFrame:
    """doc of the texts that have the terms one after the other (a term may come twice); none for no terms."""
    if not terms:
        return store.spark.createDataFrame([], "doc long")
    step = store.spark.createDataFrame(list(enumerate(terms)), "nth int, term string")
    rows = of_terms(store, list(dict.fromkeys(terms)), table).join(F.broadcast(step), "term").withColumn("term", F.concat_ws(" ", "nth", "term"))  # as many as the phrase has words
    at = F.split("term", " ")[0].cast("int")
    fits = F.filter(F.arrays_zip("docs", "places"), lambda x: x["places"] >= at)  # a phrase begins at its text's first word or later
    starts = F.transform(fits, lambda x: F.shiftleft(x["docs"].cast("long"), 32) + (x["places"] - at))
    hits = _meet(rows, len(terms), F.array_distinct(starts))
    return hits.select(_doc(F.col("block"), F.shiftright("key", 32)).alias("doc")).distinct()


def frequency(store: Store, terms: list[str], table: str = "postings") -> DataFrame:
    """term, texts and occurrences of some terms, from the index alone."""
    rows = of_terms(store, terms, table).groupBy("term", "block").agg(F.flatten(F.collect_list("docs")).alias("docs"))
    return rows.groupBy("term").agg(F.sum(F.size(F.array_distinct("docs"))).alias("texts"), F.sum(F.size("docs")).alias("occurrences"))
