"""SimHash near-duplicate groups with a Gray-order hierarchical index.

A fingerprint takes each bit from the majority of its shingles' hashes.  Equal fingerprints become
one class first.  Classes that may link agree on some choice of blocks of bits, so each class goes,
once for each choice, to the shard of those blocks' bits, and no link is lost; the larger the
corpus, the more blocks and the longer the keys.  In a shard fingerprints are sorted by Gray rank,
which puts those with common leading bits and few differences side by side.  Runs of neighbours
share an upper node that holds the bits all of them agree on (a mask and a pattern); nodes have
upper nodes in turn, and bits that an upper node holds are left out below.  A probe accumulates its
differences from the root down, leaves a whole group as soon as the agreed bits alone differ too
much, and takes a whole group as soon as even its free bits cannot make it differ too much.  What
a shard reports is a forest over its classes, never all pairs; components across shards come from
alternating large-star and small-star rounds, checkpointed in the shared folder.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, parts, reliable, table, whole_row, with_hot

#: Ids up to which they are broadcast.
FEW = 2_000_000
#: Children of an index node, rows indexed together, and probes between two looks at what is joined.
FAN_OUT, SHARD_ROWS, PROBES = 8, 100_000, 8_192
#: Pairs of a probe and a node that go down a level together, and links found before they are joined;
#: they bound the memory of a search, however dense a group is.
WIDE, LINKS = 1 << 14, 50_000


def shingle_hashes(raw: bytes, width: int):
    """XXH64 (seed 42) of every shingle of a text, repeats included, as unsigned 64-bit integers."""
    import numpy as np
    import xxhash

    words = raw.lower().split()  # of bytes: A-Z only, and ASCII blanks only
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[i:j], 42) for i, j in zip(starts, ends[-n:].tolist())), dtype=np.uint64, count=n)


def fingerprint(hashes, n_words: int):
    """Majority bits of the hashes as n_words unsigned 64-bit integers; further words remix the hashes."""
    import numpy as np

    out = np.zeros(n_words, dtype=np.uint64)
    if not len(hashes):
        return out
    for k in range(n_words):
        h = hashes
        if k:
            h = hashes + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
        count = np.zeros(64, dtype=np.int64)
        for at in range(0, len(h), 1 << 16):
            part = np.ascontiguousarray(h[at : at + (1 << 16)])
            count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * count > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, width: int, n_words: int = 1, distinct: bool = False, text: str = "text") -> DataFrame:
    """doc_id and the fingerprint's words f0, f1, ... (signed) of every whole text; null is empty."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in (part for whole in batches for part in parts(whole, 1)):
            rows = []
            for raw in as_bytes(batch.column(1)):
                hashes = shingle_hashes(raw, width)
                rows.append(fingerprint(np.unique(hashes) if distinct else hashes, n_words))
            bits = np.array(rows, dtype=np.uint64).reshape(-1, n_words).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | {f"f{k}": pa.array(np.ascontiguousarray(bits[:, k])) for k in range(n_words)})

    schema = "doc_id long, " + ", ".join(f"f{k} long" for k in range(n_words))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, schema)


def gray_rank(words):
    """Rank of each code word in the reflected Gray order."""
    import numpy as np

    r = words.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def unite(labels, a, b):
    """Labels (the smallest index of a component) after joining a[i] with b[i] for every i."""
    import numpy as np

    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            break
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


class GrayIndex:
    """Hierarchical index of fingerprints in groups; links only within a group.

    A node holds the bits that all its rows agree on less those that an upper node holds already, so
    on its way down a probe looks at each bit once and carries its differences along.
    """

    def __init__(self, group, bits):
        """group: nondecreasing ints; bits: (n, words) unsigned, sorted by Gray rank in each group."""
        import numpy as np

        self.np, self.bits = np, bits
        n = len(group)
        first = np.concatenate(([True], group[1:] != group[:-1]))
        found = []  # from the leaves up: (lo, hi, agreed, ones, first child)
        lo, hi, ones, zeros, own = np.arange(n), np.arange(n) + 1, bits, ~bits, np.cumsum(first) - 1
        while True:
            start = np.concatenate(([True], own[1:] != own[:-1])).nonzero()[0]
            size = np.diff(np.append(start, len(own)))
            if size.max() == 1:
                break
            index = np.arange(len(own)) - np.repeat(start, size)
            head = (index % FAN_OUT == 0).nonzero()[0]
            kids = np.append(head, len(own))
            ones = np.bitwise_and.reduceat(ones, head, axis=0)
            zeros = np.bitwise_and.reduceat(zeros, head, axis=0)
            lo, hi = lo[head], hi[kids[1:] - 1]
            own = own[head]
            found.append((lo, hi, ones | zeros, ones, kids))
        # one node for each group is left, so at the top a node's number is its group's
        self.group = np.cumsum(first) - 1
        self.levels = []  # (lo, hi, bits of its own, their values, free bits, first child)
        for level, (lo, hi, agreed, ones, kids) in enumerate(found):
            own = agreed
            if level + 1 < len(found):
                own = agreed & ~np.repeat(found[level + 1][2], np.diff(found[level + 1][4]), axis=0)
            self.levels.append((lo, hi, own, ones, np.bitwise_count(~agreed).sum(axis=1, dtype=np.int64), kids))
        # what the lowest nodes leave open is looked at row by row
        self.open = ~np.repeat(found[0][2], np.diff(found[0][4]), axis=0) if found else None

    def components(self, radius: int):
        """Label of each row: the smallest row reachable by links of at most radius bits."""
        np = self.np
        labels = np.arange(len(self.group))
        for at, same in self._rounds(lambda: labels):
            found: list[tuple] = []
            self._probe(len(self.levels) - 1, *at, radius, labels, same, found, True)
            self._join(labels, found)
        return labels

    def _join(self, labels, found) -> None:
        """Join in labels, in place, what was found, and forget it.

        What a round knows of its nodes stays right: a label that a probe still has was joined to no smaller
        one, so all rows that had it have it still.
        """
        if found:
            labels[:] = unite(labels, self.np.concatenate([a for a, _ in found]), self.np.concatenate([b for _, b in found]))
            found.clear()

    def pairs(self, radius: int, labels, probes: int = PROBES):
        """Arrays of all rows (a, b), a before b, that differ in at most radius bits and have different labels.

        Labels that the caller joins in place between two arrays count from the next on; an array has the
        pairs of so many probes at most.
        """
        np = self.np
        for at, same in self._rounds(lambda: labels, min(PROBES, max(1, probes))):
            found: list[tuple] = []
            self._probe(len(self.levels) - 1, *at, radius, labels, same, found, False)
            if found:
                a, b = np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
                apart = labels[a] != labels[b]
                yield a[apart], b[apart]

    def _rounds(self, labels, probes: int = PROBES):
        """Probes in blocks, and which nodes hold only one label when a block begins."""
        np = self.np
        n = len(self.group)
        for at in range(0, n if self.levels else 0, probes):
            q = np.arange(at, min(n, at + probes))
            same, now = [], labels()
            for lo, *_ in self.levels:
                least = np.minimum.reduceat(now, lo)
                same.append(np.where(least == np.maximum.reduceat(now, lo), least, -1))
            yield (q, self.group[q], np.zeros(len(q), dtype=np.int64)), same

    def _probe(self, level, q, node, differ, radius, labels, same, found, joined) -> None:
        """differ: bits in which each probe differs from what the upper nodes of its node agree on."""
        np = self.np
        lo, hi, own, ones, free, kids = self.levels[level]
        # rows before and up to the probe met it already
        ahead = (hi[node] > q + 1) & (same[level][node] != labels[q])
        q, node, differ = q[ahead], node[ahead], differ[ahead]
        if not len(q):
            return
        if len(q) > WIDE:
            half = len(q) // 2
            self._probe(level, q[:half], node[:half], differ[:half], radius, labels, same, found, joined)
            self._probe(level, q[half:], node[half:], differ[half:], radius, labels, same, found, joined)
            return
        differ = differ + np.bitwise_count((self.bits[q] ^ ones[node]) & own[node]).sum(axis=1, dtype=np.int64)
        near = differ <= radius
        if joined:
            all_near = near & (differ + free[node] <= radius)
            if all_near.any():
                whole = node[all_near]
                found.append((q[all_near], lo[whole]))
                whole = np.unique(whole)
                size = hi[whole] - lo[whole]
                member = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[whole], size)
                found.append((np.repeat(lo[whole], size), member))
                near &= ~all_near
        q, node, differ = q[near], node[near], differ[near]
        if not len(q):
            return
        size = kids[node + 1] - kids[node]
        child = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(kids[node], size)
        q, differ = np.repeat(q, size), np.repeat(differ, size)
        if level:
            self._probe(level - 1, q, child, differ, radius, labels, same, found, joined)
            return
        ahead = (child > q) & (labels[child] != labels[q])
        q, child, differ = q[ahead], child[ahead], differ[ahead]
        link = differ + np.bitwise_count((self.bits[q] ^ self.bits[child]) & self.open[child]).sum(axis=1, dtype=np.int64) <= radius
        found.append((q[link], child[link]))
        if joined and sum(len(a) for a, _ in found) > LINKS:
            self._join(labels, found)


def keys_of(names: list[str], n_blocks: int, radius: int) -> list[Column]:
    """Shard keys: two fingerprints within radius agree on n_blocks - radius of n_blocks blocks of bits at least.

    Each choice of that many blocks gives a struct of its number (band) and of their bits or, for
    several blocks, a hash of them (value).
    """
    bits = 64 * len(names)
    edges = [bits * i // n_blocks for i in range(n_blocks + 1)]

    def piece(lo: int, hi: int) -> Column:
        parts_ = []
        while lo < hi:
            n = min(hi, (lo // 64 + 1) * 64) - lo
            parts_.append(F.shiftrightunsigned(F.col(names[lo // 64]), lo % 64).bitwiseAND(F.lit((1 << n) - 1 if n < 64 else -1).cast("long")))
            lo += n
        return parts_[0] if len(parts_) == 1 else F.xxhash64(*parts_)

    blocks = [piece(lo, hi) for lo, hi in zip(edges, edges[1:])]
    values = [c[0] if len(c) == 1 else F.xxhash64(*c) for c in combinations(blocks, n_blocks - radius)]
    return [F.struct(F.lit(k).alias("band"), v.alias("value")) for k, v in enumerate(values)]


def blocks_for(n: int, bits: int, radius: int) -> int:
    """The least number of blocks with which shards stay small for n fingerprints: keys grow with the corpus."""
    blocks = radius + 1
    while blocks < radius + 4 and n >> (bits * (blocks - radius) // blocks) > SHARD_ROWS // 64:
        blocks += 1
    return blocks


def cut_groups(rows: DataFrame, keys: list[str], ident: str, size: Column, most: int) -> DataFrame:
    """rows with a column part; size is the aggregate that measures a group.

    A group of a size over most is cut in p pieces, and each row goes to the p parts that pair its
    piece with each piece: any two rows of a group meet in a part, and no part is much larger than
    most.  Groups are measured first.
    """
    large = rows.groupBy(*keys).agg(size.alias("in_group")).filter(F.col("in_group") > most)
    large = large.select(*keys, F.ceil(2 * F.col("in_group") / most).cast("int").alias("p"))  # fewer than a row for each most
    rows = rows.join(F.broadcast(large), keys, "left").withColumn("piece", F.pmod(F.xxhash64(ident, F.lit(9)), F.col("p")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda j: F.least("piece", j) * F.col("p") + F.greatest("piece", j))
    return rows.withColumn("part", F.explode(F.when(F.col("p").isNull(), F.array(F.lit(0))).otherwise(others))).drop("p", "piece")


def in_shards(rows: DataFrame, keys: list[str], ident: str, n_rows: int) -> DataFrame:
    """rows with a column part, sorted by keys and part in each task.

    Groups of over SHARD_ROWS rows are cut in parts, unless all rows together are few.
    """
    rows = rows.withColumn("part", F.lit(0)) if n_rows <= SHARD_ROWS else cut_groups(rows, keys, ident, F.count("*"), SHARD_ROWS)
    return rows.repartition(*keys, "part").sortWithinPartitions(*keys, "part")


def groups_of(batches, n_keys: int):
    """Arrays of the rows of Arrow batches sorted by their first n_keys columns, cut only where those change."""
    import numpy as np

    held, count = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
        count += len(held[-1])
        if count >= SHARD_ROWS:
            rows = np.concatenate(held)
            other = (rows[:, :n_keys] != rows[-1, :n_keys]).any(axis=1).nonzero()[0]
            cut = other[-1] + 1 if len(other) else 0
            if cut:
                yield rows[:cut]
            held, count = [rows[cut:]], len(rows) - cut if cut else 0
    if held:
        yield np.concatenate(held)


def indexed(rows, n_keys: int, first_bit: int):
    """(rows, GrayIndex) of the groups of at least two rows: bits from column first_bit on, in Gray order."""
    import numpy as np

    group = np.concatenate(([0], np.cumsum((rows[1:, :n_keys] != rows[:-1, :n_keys]).any(axis=1))))
    many = np.bincount(group)[group] > 1
    rows, group = rows[many], group[many]
    if not len(rows):
        return rows, None
    bits = rows[:, first_bit:].view(np.uint64)
    order = np.lexsort((*[gray_rank(bits[:, k]) for k in range(bits.shape[1])][::-1], group))
    rows = rows[order]
    return rows, GrayIndex(group[order], np.ascontiguousarray(rows[:, first_bit:]).view(np.uint64))


def components_of(edges: DataFrame) -> DataFrame:
    """Component of every node of edges (a, b) as (node, component), the smallest node reachable.

    Large-star and small-star rounds until nothing changes; minima are pre-aggregated before each
    shuffle, edges of hubs stay where they are, and every round is checkpointed, so a lost executor
    costs one round.
    """
    edges = reliable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == mark or not now["n"]:
            break
        mark = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = with_hot(both.filter("v > u"), least, ["u"], 2 * now["n"]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = reliable(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = with_hot(large, least, ["u"], 2 * now["n"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = reliable(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, width: int = 4, n_words: int = 1, n_bands: int | None = None, radius: int = 4, distinct: bool = False, text: str = "text") -> DataFrame:
    """doc_id, fingerprint words f0.. and component_id, the smallest doc_id linked, for every row.

    width: words of a shingle.  n_words: 64-bit words of a fingerprint.  n_bands: blocks of bits that
    shard keys are chosen from, more than radius; by default as many as the number of fingerprints
    asks for.  radius: most differing bits of a link.  distinct: count a repeated shingle once.
    No link is lost, whatever the blocks.

    Null and empty texts have fingerprint zero and link like others; texts shorter than a shingle
    count as one; repeated rows get equal results; rows without doc_id keep a null component if no
    row with a doc_id is linked to them; an empty table gives none; extra columns are ignored.
    """
    names = [f"f{k}" for k in range(n_words)]
    prints = reliable(fingerprints(docs, width, n_words, distinct, text))
    classes = reliable(prints.groupBy(*names).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("rep is not null"))
    n_classes = classes.count()
    n_blocks = n_bands or blocks_for(n_classes, 64 * n_words, radius)
    if n_blocks <= radius:
        raise ValueError("links would be lost: there must be more blocks than differing bits")
    keys = keys_of(names, n_blocks, radius)
    sharded = classes.select(F.explode(F.array(*keys)).alias("at"), "rep", *names).select("at.band", "at.value", "rep", *names)
    sharded = in_shards(sharded, ["band", "value"], "rep", n_classes).select("band", "value", "part", "rep", *names)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for rows in groups_of(batches, 3):
            rows, index = indexed(rows, 3, 4)
            if index is None:
                continue
            labels = index.components(radius)
            linked = labels != np.arange(len(labels))
            if linked.any():
                yield pa.RecordBatch.from_pydict({"a": pa.array(rows[linked, 3]), "b": pa.array(rows[labels[linked], 3])})

    edges = sharded.mapInArrow(run, "a long, b long")
    found = components_of(edges).withColumnRenamed("node", "rep")
    named = classes.join(found, "rep", "left").select(*names, F.coalesce("component", "rep").alias("component_id"), "n")
    return with_hot(prints, named, names, prints.count(), "left").select("doc_id", *names, "component_id")


def keep_first(docs: DataFrame, find=None, **how) -> DataFrame:
    """The rows of documents of which no near duplicate has a smaller doc_id, columns unchanged.

    find(docs, **how) gives doc_id and component_id, the smallest doc_id of its group, for every row;
    by default groups of similar texts.
    Rows with equal doc_id count as one document, of which the row with the smallest text stays;
    rows without doc_id stay.
    """
    if find is None:
        from .similar import similar_texts as find
    found = find(docs, **how).filter("doc_id is not null").groupBy(F.col("doc_id").alias("id"))
    ids = reliable(found.agg(F.count("*").alias("n"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays")))
    rows = docs.select(whole_row(docs).alias("row"), docs["doc_id"].cast("long").alias("id"))
    gone, several = ids.filter("not stays").select("id"), ids.filter("stays and n > 1").select("id")
    n_gone, n_several = ids.agg(F.expr("count_if(not stays)"), F.expr("count_if(stays and n > 1)")).first()
    others = F.to_json(F.struct(*[F.col("row")[c].cast("string").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]))
    order = Window.partitionBy("id").orderBy(F.col("row")["text"], others)

    def first_of(rows: DataFrame) -> DataFrame:
        return rows.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("row.*")

    if max(n_gone, n_several) > FEW:
        return first_of(rows.join(ids.filter("stays").select("id"), "id")).unionByName(docs.filter(docs["doc_id"].isNull()))
    # ids of those that go, 8 bytes each, are broadcast, and texts stay where they are
    rows = rows.join(F.broadcast(gone), "id", "left_anti")
    if not n_several:
        return rows.select("row.*")
    return rows.join(F.broadcast(several), "id", "left_anti").select("row.*").unionByName(first_of(rows.join(F.broadcast(several), "id")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), width=4, n_words=1, radius=4, distinct=False)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
