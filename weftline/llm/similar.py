"""Near duplicates by shingle similarity: SimHash and its Gray-order index propose, whole sets decide.

Two texts are linked if the sets of their shingles have a Jaccard similarity of at least 4/5.  Equal
sets become one class first.  Under any one order of all shingles, two linked sets share one of their
first n - ceil(4n / 5) + 1 shingles, so a class goes to the shards of those shingles; the order puts
shingles that a sample shows to be common last, which changes the cost and never the result.  In a
shard the Gray-order index of 256-bit fingerprints joins the classes that differ in few bits.  At a
similarity of 4/5 fingerprints differ in about 39 bits (standard deviation 5.7, up to 48 and 6.3 for the
smallest sets) and in about 128 without any.  With hashes taken as random bits, the radii let less
than one link in a million pass at any sizes of sets (worst: 0.55 in a million).

A shard reports a forest, never its pairs.  What the forests of all shards join is a group, so both ends
of a link are in one group.  Each class then goes with its whole text to its group, once, where the
index proposes pairs that are not joined yet and whole sets decide, in integers, in the task that
holds them.  A group of over GROUP shingles is cut in pieces that meet pairwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, give_back, parts, reliable, with_hot
from .simhash import components_of, cut_groups, fingerprint, groups_of, in_shards, indexed, shingle_hashes, unite

#: Least similarity of a link as a fraction; sets below LEAST shingles are linked only to equal ones.
NUM, DEN = 4, 5
LEAST = NUM // (DEN - NUM)
#: Words of a fingerprint; bits in which fingerprints of links differ at most, for sets of fewer than SMALL
#: shingles and for others, and bits within which a first round joins groups.
WORDS, SMALL, SMALL_RADIUS, RADIUS, FIRST_RADIUS = 4, 24, 80, 70, 44
#: Documents and shingles that the order of shingles is estimated from, and their least count.
SAMPLE, COMMON, SEEN = 6_000, 100_000, 3
#: Ids of wanted texts up to which they are broadcast (their texts never are).
FEW = 1_000_000
#: Parts that shards of shingles seen in the sample are cut in, so that none is one task's work.
SALTS = 64
#: Shingles of a group up to which it is one part, and what a class counts beside its shingles; shingles of
#: the groups that a task takes together; pairs sought and shingles gathered at once.  They bound a task's memory.
GROUP, EACH, TOGETHER, PAIRS, GATHERED = 2_000_000, 64, 250_000, 500_000, 500_000

PRINTS = [f"f{k}" for k in range(WORDS)]


def common_shingles(texts: DataFrame, width: int):
    """Shingles that occur in several texts of a sample, ascending, and their counts."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        for batch in (part for whole in batches for part in parts(whole, 1)):
            sets = [np.unique(shingle_hashes(raw, width)) for raw in as_bytes(batch.column(1))]
            if sets:
                yield pa.RecordBatch.from_pydict({"item": pa.array(np.concatenate(sets).view(np.int64))})

    n = texts.count()
    drawn = texts.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(max(n, SAMPLE))) < SAMPLE)
    counts = drawn.mapInArrow(run, "item long").groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= SEEN)
    rows = counts.orderBy(F.desc("n"), "item").limit(COMMON).collect()
    item, n = np.array([r["item"] for r in rows], dtype=np.int64).view(np.uint64), np.array([r["n"] for r in rows], dtype=np.int64)
    order = np.argsort(item)
    return item[order], n[order]


def summaries(texts: DataFrame, width: int, common, counts) -> DataFrame:
    """doc_id, t, n, key (k0, k1) and fingerprint of the shingle set, and its first shingles (8 bytes each).

    The lowest bit of a first shingle says whether the sample knows it.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in (part for whole in batches for part in parts(whole, 1)):
            ns, keys, prints, heads = [], [], [], []
            for raw in as_bytes(batch.column(1)):
                s = np.unique(shingle_hashes(raw, width))
                ns.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                prints.append(fingerprint(s, WORDS))
                weight = np.zeros(len(s), dtype=np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    weight = np.where(common[at] == s, counts[at], 0)
                k = len(s) - -(-NUM * len(s) // DEN) + 1 if len(s) >= LEAST else 0
                first = np.lexsort((s, weight))[:k]
                heads.append(((s[first] & ~np.uint64(1)) | (weight[first] > 0)).tobytes())
            if not ns:
                continue
            k, f = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2), np.array(prints).view(np.int64)
            columns = {"doc_id": batch.column(0), "t": batch.column(2), "n": pa.array(ns, pa.int64()), "k0": pa.array(np.ascontiguousarray(k[:, 0])), "k1": pa.array(np.ascontiguousarray(k[:, 1]))}
            columns |= {name: pa.array(np.ascontiguousarray(f[:, i])) for i, name in enumerate(PRINTS)}
            yield pa.RecordBatch.from_pydict(columns | {"head": pa.array(heads, pa.binary())})

    return texts.mapInArrow(run, "doc_id long, t long, n long, k0 long, k1 long, " + ", ".join(f"{p} long" for p in PRINTS) + ", head binary")


def meetings(summary: DataFrame) -> DataFrame:
    """item, k0: first shingles that several classes have, with each of those classes once."""

    def spread(batches):
        import numpy as np
        import pyarrow as pa

        for batch in (part for whole in batches for part in parts(whole, 1)):
            heads = as_bytes(batch.column(1))
            k0 = np.repeat(batch.column(0).to_numpy(), [len(h) // 8 for h in heads])
            item = np.frombuffer(b"".join(heads), dtype=np.int64)
            order = np.lexsort((k0, item))  # rows of one class in a batch once
            item, k0 = item[order], k0[order]
            new = np.concatenate(([True], (item[1:] != item[:-1]) | (k0[1:] != k0[:-1])))[: len(item)]
            yield pa.RecordBatch.from_pydict({"item": pa.array(item[new]), "k0": pa.array(k0[new])})

    def shared(batches):
        import numpy as np
        import pyarrow as pa

        held, given = np.empty((0, 2), dtype=np.int64), False  # the row before, and whether it is out already
        for batch in batches:
            rows = np.concatenate((held, np.column_stack([batch.column(c).to_numpy() for c in (0, 1)])))
            if not len(rows):
                continue
            rows = rows[np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))]
            again = rows[1:, 0] == rows[:-1, 0]
            out = np.concatenate(([False], again)) | np.concatenate((again, [False])) | (rows[:, 0] & 1 == 1)
            held, last = rows[-1:], bool(out[-1])
            out[0] &= not given
            given = last
            yield pa.RecordBatch.from_pydict({"item": pa.array(rows[out, 0]), "k0": pa.array(rows[out, 1])})

    rows = summary.filter(F.col("n") >= LEAST).select("k0", "head").mapInArrow(spread, "item long, k0 long")
    salt = F.when(F.col("item").bitwiseAND(F.lit(1)) == 1, F.pmod(F.shiftright("k0", 20), F.lit(SALTS))).otherwise(F.lit(0))
    rows = rows.repartition("item", salt).sortWithinPartitions("item", "k0")
    return rows.mapInArrow(shared, "item long, k0 long")


def grouped(met: DataFrame, n_rows: int) -> DataFrame:
    """node, component: classes that chains of pairs within the radius join in shards; no link leaves a component.

    met: item, k0, n and fingerprint.  A task reports a forest over the classes of the shards it reads
    together, so rows grow with classes, never with pairs.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for rows in groups_of(batches, 2):
            found = [np.empty((0, 2), dtype=np.int64)]
            for fit, radius in ((NUM * rows[:, 3] < DEN * SMALL, SMALL_RADIUS), (rows[:, 3] >= SMALL, RADIUS)):
                some, index = indexed(rows[fit], 2, 4) if fit.any() else (None, None)
                if index is not None:
                    labels = index.components(radius)
                    at = (labels != np.arange(len(labels))).nonzero()[0]
                    found.append(np.column_stack((some[at, 2], some[labels[at], 2])))
            ident, at = np.unique(np.concatenate(found), return_inverse=True)
            at = at.reshape(-1, 2)
            labels = unite(np.arange(len(ident)), at[:, 0], at[:, 1])
            at = (labels != np.arange(len(labels))).nonzero()[0]
            yield pa.RecordBatch.from_pydict({"a": pa.array(ident[at]), "b": pa.array(ident[labels[at]])})
            del rows, found, ident, at, labels
            give_back()

    rows = in_shards(met, ["item"], "k0", n_rows).select("item", "part", "k0", "n", *PRINTS)
    found = components_of(rows.mapInArrow(run, "a long, b long"))
    return reliable(found.unionByName(found.select(F.col("component").alias("node"), "component").distinct()))


def alike(sets: list):
    """A function of rows (a, b) that says of each pair whether its whole sets are similar enough."""
    import numpy as np

    n = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    start = np.cumsum(n) - n
    number = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    mark = np.zeros(len(number), dtype=bool)

    def test(a, b):
        out = np.zeros(len(a), dtype=bool)
        order = np.lexsort((b, a))
        first = np.concatenate(([True], a[order][1:] != a[order][:-1]))[: len(a)].nonzero()[0].tolist()
        for i, j in zip(first, [*first[1:], len(a)]):
            x = a[order[i]]
            mine = number[start[x] : start[x] + n[x]]
            mark[mine] = True
            block = np.cumsum(n[b[order[i:j]]]) // GATHERED
            cut = [i, *((block[1:] != block[:-1]).nonzero()[0] + i + 1).tolist(), j]
            for lo, hi in zip(cut, cut[1:]):
                y = b[order[lo:hi]]
                ends = np.cumsum(n[y])
                at = np.arange(ends[-1]) + np.repeat(start[y] - ends + n[y], n[y])
                both = np.add.reduceat(mark[number[at]], ends - n[y], dtype=np.int64)
                out[order[lo:hi]] = (NUM + DEN) * both >= NUM * (n[x] + n[y])
            mark[mine] = False
        return out

    return test


def confirmed(groups: DataFrame, width: int) -> DataFrame:
    """a, b: links between classes of a group, confirmed on whole sets, as a forest in each part of a group.

    groups: component, part, k0, n, fingerprint and text (compressed).  In a part the index finds the
    classes near each other: a forest within a small radius is confirmed first, then all pairs that
    are not joined yet.  Pairs are made a few at a time and stay in the task.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress

        def links(held: list, sets: list):
            rows, index = indexed(np.array(held, dtype=np.int64), 2, 5)
            if index is None:
                return
            ident, n, test = rows[:, 2], rows[:, 3], alike([sets[k] for k in rows[:, 4].tolist()])
            joined, labels = np.arange(len(rows)), index.components(FIRST_RADIUS)
            at = (labels != joined).nonzero()[0]
            hit = test(labels[at], at)
            joined = unite(joined, labels[at[hit]], at[hit])
            for a, b in index.pairs(SMALL_RADIUS if n.min() < SMALL else RADIUS, joined, PAIRS // len(rows)):
                ok = DEN * np.minimum(n[a], n[b]) >= NUM * np.maximum(n[a], n[b])
                ok &= (np.minimum(n[a], n[b]) < SMALL) | (np.bitwise_count(index.bits[a] ^ index.bits[b]).sum(axis=1) <= RADIUS)
                a, b = a[ok], b[ok]
                hit = test(a, b)
                joined[:] = unite(joined, a[hit], b[hit])  # the next pairs are sought among what is left
            at = (ident != ident[joined]).nonzero()[0]
            yield pa.RecordBatch.from_pydict({"a": pa.array(ident[joined[at]]), "b": pa.array(ident[at])})

        held: list = []
        sets: list = []
        size = 0
        for batch in (part for whole in batches for part in parts(whole, 8)):
            for *row, blob in zip(*[c.to_pylist() for c in batch.columns]):
                if size >= TOGETHER and row[:2] != held[-1][:2]:
                    yield from links(held, sets)
                    held, sets, size = [], [], 0
                sets.append(np.unique(shingle_hashes(expand(blob), width)))
                held.append([*row[:4], len(held), *row[4:]])
                size += len(sets[-1])
        if held:
            yield from links(held, sets)

    rows = groups.select("component", "part", "k0", "n", *PRINTS, "text").repartition("component", "part").sortWithinPartitions("component", "part")
    return rows.mapInArrow(run, "a long, b long")


def similar_texts(docs: DataFrame, width: int = 5, text: str = "text") -> DataFrame:
    """doc_id and component_id, the smallest doc_id linked, for every row.

    Texts shorter than a shingle count as one shingle, and texts without words have none: such texts
    and others of fewer than LEAST shingles are linked only to equal sets, null counting as empty.
    Rows with one doc_id count as one document.  Rows without doc_id keep a null component if no row
    with a doc_id has the same set.  An empty table gives none; extra columns are ignored.
    """

    def pack(first: str):
        def run(batches):
            import pyarrow as pa
            import zstandard

            press = zstandard.ZstdCompressor(level=3).compress
            for batch in (part for whole in batches for part in parts(whole, 1)):
                columns = {first: batch.column(0)} | ({"t": batch.column(2)} if first == "doc_id" else {})
                yield pa.RecordBatch.from_pydict(columns | {"text": pa.array([press(t) for t in as_bytes(batch.column(1))], pa.binary())})

        return run

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("t", F.xxhash64("text"))  # tells rows of one doc_id apart
    summary = reliable(summaries(texts, width, *common_shingles(texts, width)))
    classes = summary.groupBy("k0", "k1").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "t"))).alias("of"), F.count("*").alias("n_rows"), *[F.first(c).alias(c) for c in ("n", *PRINTS)])
    classes = reliable(classes.filter("of is not null").select("*", F.col("of.doc_id").alias("rep"), F.col("of.t").alias("t")).drop("of"))
    # k0 alone stands for a class where links are sought
    met = meetings(summary).join(classes.select("k0", "n", "rep", "t", *PRINTS), "k0")
    met = reliable(met.select("item", "k0", "n", "rep", "t", *PRINTS))
    members = grouped(met.select("item", "k0", "n", *PRINTS), met.count()).withColumnRenamed("node", "k0")
    wanted = reliable(met.select("k0", F.col("rep").alias("doc_id"), "t").distinct().join(members.select("k0"), "k0", "left_semi"))
    if wanted.count() <= FEW:  # texts stay where they are if the ids of few are wanted, 24 bytes a row
        found = texts.join(F.broadcast(wanted), ["doc_id", "t"]).select("k0", "text", "t").mapInArrow(pack("k0"), "k0 long, text binary")
    else:
        found = texts.select("doc_id", "text", "t").mapInArrow(pack("doc_id"), "doc_id long, t long, text binary").join(wanted, ["doc_id", "t"]).select("k0", "text")
    members = members.join(classes.select("k0", "n", *PRINTS).dropDuplicates(["k0"]), "k0")
    members = cut_groups(members, ["component"], "k0", F.sum(F.col("n") + EACH), GROUP)
    links = reliable(confirmed(found.distinct().join(members, "k0"), width))
    # from classes to documents; rows with one doc_id and different texts link their classes
    reps = classes.select("k0", "rep")
    edges = links.join(reps.toDF("a", "u"), "a").join(reps.toDF("b", "v"), "b").select("u", "v")
    several = summary.groupBy("doc_id").agg(F.min(F.struct("k0", "k1")).alias("lo"), F.max(F.struct("k0", "k1")).alias("hi")).filter("doc_id is not null and lo <> hi").select("doc_id")
    same = summary.select("doc_id", "k0", "k1").join(several, "doc_id", "left_semi").join(classes.select("k0", "k1", "rep"), ["k0", "k1"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    found = components_of(edges.unionByName(same).toDF("a", "b")).withColumnRenamed("node", "rep")
    named = classes.join(found, "rep", "left").select("k0", "k1", F.coalesce("component", "rep").alias("component_id"), F.col("n_rows").alias("n"))
    return with_hot(summary.select("doc_id", "k0", "k1"), named, ["k0", "k1"], summary.count(), "left").select("doc_id", "component_id")
