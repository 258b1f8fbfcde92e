"""Ranked lexical search over a bit-sliced impact index.

Documents lie in shards in the order of their ids.  For each term a shard has the places of the documents
that hold it and, over these, one bitmap for each bit of the term's impact there.  Whole numbers are added
and multiplied on bitmaps only: an item's sum is kept as two sets of slices, and a term's slices go in
through carry-save addition (a sum and a carry bitmap for each bit), so a term costs a handful of
operations on whole bitmaps however many documents hold it.  The ten best are found from the most
significant slice down: documents with the bit set go before all others, or, if there are too many of
them, the others drop out.

The impacts in the index do not depend on how frequent a term is in the corpus; that weight is multiplied
in when an item is looked up, by shifted additions for each of its bits.  So the index needs only the
number and the mean length of documents, and a term's weight may follow the corpus without a new index.
"""

from __future__ import annotations

from array import array
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, parts, reliable, table

#: Documents and postings of a shard at most, and items looked up at a time in a shard.
SHARD_DOCS, SHARD_POSTINGS, BLOCK_ITEMS = 16_384, 2_000_000, 256

#: Terms of items, and bytes of them and of the items that have them, that are broadcast at most.
FEW_TERMS, FEW_BYTES = 200_000, 16 << 20

#: Fixed values of the score: weight's scale, impact's scale, and how far length counts (in hundredths).
WEIGHT, IMPACT, FREQUENCY, NORM, LENGTH = 1000, 1_000_000_000, 1000, 8, 90

#: Fixed value: what a term is.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Bytes to terms: ASCII letters and digits and all of other characters, A-Z lower-cased, the rest blanks.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())

INDEX = "shard string, term string, n int, size int, places binary, slices binary, ids array<long>"
WORD_BITS = 64


def terms_of(raw: bytes) -> list[bytes]:
    """Terms of a UTF-8 text, with repeats."""
    return raw.translate(FOLD).split()


def corpus_counts(docs: DataFrame, text: str = "text") -> tuple[DataFrame, int, int]:
    """term and df of all terms (checkpointed), the number of documents with a term, and of all terms with repeats."""

    def run(batches):
        import pyarrow as pa

        df, n, total = Counter(), 0, 0

        def flush():
            nonlocal df, n, total
            out = pa.RecordBatch.from_pydict({"term": pa.array([None, *df], pa.binary()).cast(pa.string()), "df": pa.array([n, *df.values()], pa.int64()), "total": pa.array([total] + [0] * len(df), pa.int64())})
            df, n, total = Counter(), 0, 0
            return out

        for batch in (part for whole in batches for part in parts(whole, 0)):
            for raw in as_bytes(batch.column(0)):
                terms = terms_of(raw)
                if terms:
                    n, total = n + 1, total + len(terms)
                    df.update(set(terms))
            if len(df) > 500_000:
                yield flush()
        yield flush()

    rows = docs.select(docs[text].cast("string").alias("text")).mapInArrow(run, "term string, df long, total long")
    counts = reliable(rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")))
    whole = counts.filter("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
    return counts.filter("term is not null").select("term", "df"), whole["n"], whole["total"]


def pack(bits):
    """Bitmaps as 64-bit words from an array of 0 and 1 along its last axis, padded to whole words."""
    import numpy as np

    raw = np.packbits(bits, axis=-1, bitorder="little")
    return np.pad(raw, [(0, 0)] * (raw.ndim - 1) + [(0, -raw.shape[-1] % 8)]).view(np.uint64)


def unpack(words, n: int):
    """The first n bits of each bitmap, as 0 and 1."""
    import numpy as np

    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1, bitorder="little", count=n)


class Sliced:
    """A whole number for each of many places, as bitmaps of its bits: a sum and a carry that are not yet added up."""

    def __init__(self, words: int, bits: int = 1):
        import numpy as np

        self.np, self.most = np, 0
        self.sum, self.carry = np.zeros((bits, words), np.uint64), np.zeros((bits, words), np.uint64)

    def add(self, slices, shift: int = 0) -> None:
        """Add numbers given by their slices, times two to the shift; the three bitmaps of a bit become two again."""
        np = self.np
        self.most += ((1 << len(slices)) - 1) << shift
        if (more := self.most.bit_length() - len(self.sum)) > 0:  # no sum can be larger, so no carry is lost
            self.sum, self.carry = (np.pad(x, ((0, more + 4), (0, 0))) for x in (self.sum, self.carry))
        at = slice(shift, shift + len(slices))
        both = self.sum ^ self.carry
        held = self.sum & self.carry
        held[at] |= slices & both[at]
        both[at] ^= slices
        self.sum = both
        self.carry[0] = 0
        self.carry[1:] = held[:-1]

    def slices(self):
        """One bitmap for each bit, least significant first: carries are taken upwards until none is left."""
        np = self.np
        out, carry = np.empty_like(self.sum), np.zeros_like(self.sum[0])
        for k, (a, b) in enumerate(zip(self.sum, self.carry)):
            both = a ^ b
            out[k], carry = both ^ carry, (a & b) | (carry & both)
        return out

    @classmethod
    def product(cls, slices, factor: int):
        """Slices of numbers times a factor, by shifted additions."""
        made = cls(slices.shape[1], len(slices) + factor.bit_length())
        for bit in range(factor.bit_length()):
            if factor >> bit & 1:
                made.add(slices, bit)
        return made.slices()


def top(slices, n: int, k: int):
    """Places of the k largest numbers above 0 among n, in no order; of equal ones the first places."""
    import numpy as np

    left = np.bitwise_or.reduce(slices, axis=0)  # numbers above 0
    sure = np.zeros_like(left)
    for one in slices[::-1]:
        with_bit = left & one
        if (found := int(np.bitwise_count(with_bit).sum())) > k:
            left = with_bit
        else:
            sure, left, k = sure | with_bit, left & ~one, k - found
    return np.concatenate((unpack(sure, n).nonzero()[0], unpack(left, n).nonzero()[0][:k]))


def values(slices, places):
    """Numbers at some places."""
    import numpy as np

    at = places.astype(np.uint64)
    bits = (slices[:, at // np.uint64(WORD_BITS)] >> (at % np.uint64(WORD_BITS))) & np.uint64(1)
    return (bits << np.arange(len(slices), dtype=np.uint64)[:, None]).sum(axis=0, dtype=np.uint64).astype(np.int64)


def built(docs: DataFrame, n_docs: int, n_terms: int, text: str = "text") -> DataFrame:
    """The index of docs (shard, term, n, places, slices); a row without term has the doc_ids of its shard.

    n_docs and n_terms are the counts of the corpus.  Shards are cut from what a task reads, by documents
    and by postings, so nothing is shuffled and a long text only makes its shard smaller.
    """
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"), F.spark_partition_id().alias("part"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, sizes, lengths, vocabulary = [], array("i"), array("q"), {}
        terms, tfs, serial = array("i"), array("i"), 0

        def flush(part):
            doc = np.array([np.iinfo(np.int64).max if i is None else i for i in ids])
            order = np.argsort(doc, kind="stable")  # places in order of ids, so that the first of equal scores is the least id
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            held = np.frombuffer(sizes, np.int32)
            at, tf, term = np.repeat(place, held), np.frombuffer(tfs, np.int32).astype(np.int64), np.frombuffer(terms, np.int32)
            m = 100 - LENGTH + LENGTH * np.frombuffer(lengths, np.int64) * n_docs // n_terms
            impact = IMPACT * tf // (FREQUENCY * tf + NORM * np.repeat(m, held))
            sort = np.lexsort((at, term))
            at, term, impact = at[sort], term[sort], impact[sort]
            count = np.bincount(term, minlength=len(vocabulary))
            first = np.concatenate(([0], np.cumsum(count)))
            words = -(-count // WORD_BITS)  # each term's bitmap begins at a whole word
            begin = np.concatenate(([0], np.cumsum(words)))
            bit = (begin[:-1] * WORD_BITS)[term] + np.arange(len(at)) - first[term]
            room, depth = int(begin[-1]), max(1, int(impact.max(initial=0)).bit_length())
            slices = np.empty((depth, room), np.uint64)
            for k in range(depth):
                bits = np.zeros(room * WORD_BITS, np.uint8)
                bits[bit] = impact >> k & 1
                slices[k] = pack(bits)
            at = at.astype(np.uint16)
            name, rows = f"{part}-{serial}", [[] for _ in range(7)]

            def put(*row):
                for column, value in zip(rows, row):
                    column.append(value)

            def batch():
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
                out = pa.RecordBatch.from_arrays(list(map(pa.array, rows, kinds)), names=["shard", "term", "n", "size", "places", "slices", "ids"])
                for column in rows:
                    column.clear()
                return out

            put(name, None, len(ids), len(ids), None, None, [ids[i] for i in order.tolist()])
            for k, word in enumerate(vocabulary):
                own = slices[:, begin[k] : begin[k + 1]]
                own = own[: max(1, int(impact[first[k] : first[k + 1]].max()).bit_length())]
                put(name, word.decode(), int(count[k]), len(ids), at[first[k] : first[k + 1]].tobytes(), own.tobytes(), None)
                if len(rows[0]) >= 5000:
                    yield batch()
            yield batch()

        part = None
        for batch in (cut for whole in batches for cut in parts(whole, 1)):
            for doc, raw, part in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                found = Counter(terms_of(raw))
                if not found:
                    continue
                ids.append(doc)
                sizes.append(len(found))
                lengths.append(found.total())
                terms.extend([vocabulary.setdefault(w, len(vocabulary)) for w in found])
                tfs.extend(found.values())
                if len(ids) >= SHARD_DOCS or len(terms) >= SHARD_POSTINGS:
                    yield from flush(part)
                    ids, sizes, lengths, vocabulary = [], array("i"), array("q"), {}
                    terms, tfs, serial = array("i"), array("i"), serial + 1
        if ids:
            yield from flush(part)

    return base.mapInArrow(run, INDEX)


def search(index: DataFrame, weights: DataFrame, k: int = 10) -> DataFrame:
    """item, rank, doc_id, score of the k best documents of each item.

    weights: item (long), term, weight, each term once for an item.  Items are looked up in blocks; a
    block's terms meet the index by a join on the term, and are broadcast only if counted to be few, so
    a task holds the bitmaps of one shard and one block.
    """
    from pyspark.sql import Window

    block = F.floor(F.col("item") / BLOCK_ITEMS).alias("block")
    wanted = reliable(weights.filter("weight > 0").groupBy("term", "weight", block).agg(F.collect_list("item").alias("items")))
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("term") + 8 * F.size("items")), F.lit(0)).alias("b")).first()
    if size["n"] <= FEW_TERMS and size["b"] <= FEW_BYTES:  # only what is asked for is kept, and the names of documents
        index = rows = reliable(index.join(F.broadcast(wanted), "term", "left").filter("term is null or weight is not null"))
    else:
        index = reliable(index)
        rows = index.join(wanted, "term")
    rows = rows.filter("term is not null").select("shard", "block", "n", "size", "places", "slices", "weight", "items")
    names = index.filter("term is null").select("shard", "ids")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        now, sums, size = None, {}, 0

        def close():
            out = [[], [], []]
            for item, total in sums.items():
                slices = total.slices()
                at = top(slices, size, k)
                out[0] += [item] * len(at)
                out[1] += at.tolist()
                out[2] += values(slices, at).tolist()
            kinds = (pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([now[0]] * len(out[0]), pa.string()), *map(pa.array, out, kinds)], names=["shard", "item", "place", "score"])

        for batch in batches:
            for shard, block, n, width, places, raw, weight, items in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)]):
                if (shard, block) != now:
                    if now is not None:
                        yield from close()
                    now, sums, size = (shard, block), {}, width
                at = np.frombuffer(places, np.uint16)
                own = np.frombuffer(raw, np.uint64).reshape(-1, -(-n // WORD_BITS))
                product = unpack(Sliced.product(own, weight), n)  # over the documents that hold the term, then over all
                wide = np.zeros((len(product), size), np.uint8)
                wide[:, at] = product
                slices = pack(wide)
                for item in items:
                    if item not in sums:
                        sums[item] = Sliced(slices.shape[1])
                    sums[item].add(slices)
        if now is not None:
            yield from close()

    found = rows.repartition("shard", "block").sortWithinPartitions("shard", "block").mapInArrow(run, "shard string, item long, place int, score long")
    found = found.join(names, "shard").select("item", F.get("ids", F.col("place")).alias("doc_id"), "score")
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", nth).filter(F.col("rank") <= k)


def item_weights(items: DataFrame, df: DataFrame, n_docs: int, text: str = "text") -> DataFrame:
    """item, term, weight of the distinct terms of each item's text (column item: a number) that a document has."""
    low = F.translate(F.coalesce(items[text].cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = items.select("item", F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(TERM), F.lit(0)))).alias("term"))
    share = F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)
    return terms.join(df, "term").select("item", "term", F.floor(WEIGHT * F.log(share)).cast("long").alias("weight"))


def rank(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for each row of items, equal scores by doc_id.

    Null and empty texts have no terms, match nothing and are no part of the counts; documents without
    doc_id come last among equal scores; rows that repeat a doc_id are documents of their own, as are
    items that repeat an item_id; other columns are ignored; an empty table on either side gives none.
    """
    df, n_docs, n_terms = corpus_counts(docs, text)
    asked = reliable(items.select(F.monotonically_increasing_id().alias("item"), items["item_id"].cast("long").alias("item_id"), items[text].cast("string").alias("text")))
    found = search(built(docs, n_docs, n_terms, text), item_weights(asked, df, n_docs), k)
    return found.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
