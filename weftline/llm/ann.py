"""Approximate nearest neighbours by inner product: one navigable small-world hierarchy per shard.

Equal vectors are one class, so copies cannot crowd a graph; vectors of a shard are lifted to equal
norm by one more coordinate, which turns the largest inner product into the smallest distance.
Nodes are ordered by level, so each layer holds a prefix of them; a layer is a flat array of
neighbour numbers, -1 where there is none.  Nodes enter in batches and searches advance whole
batches of queries with array operations; while a shard is small, the nodes nearest to a new one
come from a matrix product with those before it, which is exact and cheaper than a walk.  Indexes
are checkpointed rows; queries visit every shard in broadcast blocks, and the shards' best are
merged by window functions.  Work grows with queries times shards, so shards grow with the table
up to what a worker holds.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import reliable, table, with_hot

#: Nodes up to which a new node's neighbours come from a matrix product, not from a walk.
EXACT = 16_384
#: Rows of a shard, at most and at least on average, and bytes of the query vectors of a block.
SHARD_ROWS, LEAST_ROWS, BLOCK_BYTES = 131_072, 2_048, 32 << 20


class SmallWorld:
    """Layers of neighbour arrays over lifted vectors, all in order of level."""

    def __init__(self, vectors, sizes=None, layers=None, m: int = 16, ef_build: int = 48):
        import numpy as np

        self.np, self.m = np, m
        norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        lift = np.sqrt(np.maximum(norm.max(initial=0) ** 2 - norm**2, 0))
        self.x = np.column_stack((vectors, lift)).astype(np.float32)
        if layers is not None:
            self.sizes, self.layers = sizes, layers
            return
        n = len(vectors)
        self.sizes = [n]  # from the bottom layer up
        while self.sizes[-1] > 4 * m:
            self.sizes.append(max(1, self.sizes[-1] // m))
        self.layers: list = [None] * len(self.sizes)
        for level in reversed(range(len(self.sizes))):
            self._build(level, ef_build)

    def near(self, q, ids):
        """Inner products of each row of q with its row of ids."""
        return self.np.einsum("abd,ad->ab", self.x[ids], q)

    def walk(self, graph, q, entry, ef: int, wide: int = 8):
        """The ef nearest nodes of a layer for each query, nearest first: (ids, products)."""
        np, b, n = self.np, len(q), len(graph)
        ids = np.full((b, ef), -1, dtype=np.int64)
        sim = np.full((b, ef), -np.inf, dtype=np.float32)
        new = np.zeros((b, ef), dtype=bool)  # not yet expanded
        seen = np.zeros((b, n), dtype=bool)
        k = min(entry.shape[1], ef)
        row = np.arange(b)[:, None]
        ids[:, :k], sim[:, :k], new[:, :k] = entry[:, :k], self.near(q, entry[:, :k]), True
        seen[row, entry[:, :k]] = True
        live = np.arange(b)
        while len(live):
            score = np.where(new[live], sim[live], -np.inf)
            w = min(wide, ef)
            pick = np.argpartition(-score, w - 1, axis=1)[:, :w]
            got = np.take_along_axis(score, pick, axis=1) > -np.inf
            go = got.any(axis=1)
            live, pick, got = live[go], pick[go], got[go]
            if not len(live):
                break
            new[live[:, None], pick] = False
            nodes = np.where(got, ids[live[:, None], pick], 0)
            nbr = np.where(got[:, :, None], graph[nodes], -1).reshape(len(live), -1)
            nbr[seen[live[:, None], nbr] & (nbr >= 0)] = -1
            nbr.sort(axis=1)
            nbr[:, 1:][nbr[:, 1:] == nbr[:, :-1]] = -1
            a, c = (nbr >= 0).nonzero()
            seen[live[a], nbr[a, c]] = True
            s = np.full(nbr.shape, -np.inf, dtype=np.float32)
            s[a, c] = np.einsum("ad,ad->a", self.x[nbr[a, c]], q[live[a]])
            all_ids = np.concatenate((ids[live], nbr), axis=1)
            all_sim = np.concatenate((sim[live], s), axis=1)
            all_new = np.concatenate((new[live], nbr >= 0), axis=1)
            top = np.argpartition(-all_sim, ef - 1, axis=1)[:, :ef]
            ids[live] = np.take_along_axis(all_ids, top, axis=1)
            sim[live] = np.take_along_axis(all_sim, top, axis=1)
            new[live] = np.take_along_axis(all_new, top, axis=1)
        order = np.argsort(-sim, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sim, order, axis=1)

    def diverse(self, base, ids, most: int):
        """Of candidates (nearest first, -1: none), those nearer to base than to any chosen before; then the nearest others."""
        np = self.np
        b, c = ids.shape
        x = self.x[ids]
        to_base = np.where(ids >= 0, np.einsum("acd,ad->ac", x, self.x[base]), -np.inf)
        between = np.matmul(x, x.transpose(0, 2, 1))
        chosen = np.zeros((b, c), dtype=bool)
        closest = np.full((b, c), -np.inf, dtype=np.float32)  # to any chosen
        left = np.full(b, most)
        for k in range(c):
            take = (ids[:, k] >= 0) & (left > 0) & (closest[:, k] < to_base[:, k])
            chosen[:, k] = take
            left -= take
            closest = np.where(take[:, None], np.maximum(closest, between[:, k]), closest)
        rest = (ids >= 0) & ~chosen
        rank = np.cumsum(rest, axis=1)
        chosen |= rest & (rank <= left[:, None])
        order = np.argsort(~chosen, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(np.where(chosen, ids, -1), order, axis=1)
        if out.shape[1] < most:
            out = np.concatenate((out, np.full((b, most - out.shape[1]), -1)), axis=1)
        return out

    def _entries(self, level: int, q):
        """Entry points of a layer from the layers above."""
        np = self.np
        at = np.zeros((len(q), 1), dtype=np.int64)
        for up in reversed(range(level + 1, len(self.sizes))):
            at = self.walk(self.layers[up], q, at, min(4, self.sizes[up]), 1)[0]
            at = np.where(at >= 0, at, 0)[:, :1] if up > level + 1 else np.where(at >= 0, at, at[:, :1])
        return at

    def _build(self, level: int, ef: int) -> None:
        np, n = self.np, self.sizes[level]
        width = 2 * self.m if level == 0 else self.m
        graph = np.full((n, width), -1, dtype=np.int64)
        self.layers[level] = graph
        above = self.sizes[level + 1] if level + 1 < len(self.sizes) else 0
        done = 1
        while done < n:
            batch = np.arange(done, min(n, done + min(max(16, done), 256)))
            q = self.x[batch]
            if batch[-1] <= EXACT:
                cand = self._before(q, batch, ef)
            else:
                inside = np.where(np.arange(len(batch))[None, :] < np.arange(len(batch))[:, None], q @ q.T, -np.inf)
                k = min(ef // 4, len(batch))
                peers = np.argpartition(-inside, k - 1, axis=1)[:, :k]
                peers = np.where(np.take_along_axis(inside, peers, axis=1) > -np.inf, batch[peers], -1)
                entry = np.zeros((len(batch), 1), dtype=np.int64)
                if above and done >= above:
                    entry = self._entries(level, q)
                found, _ = self.walk(graph[:done], q, entry, min(ef, done))
                cand = np.concatenate((found, peers), axis=1)
            sim = np.where(cand >= 0, self.near(q, cand), -np.inf)
            order = np.argsort(-sim, axis=1, kind="stable")[:, :ef]
            links = self.diverse(batch, np.take_along_axis(cand, order, axis=1), self.m)
            graph[batch, : self.m] = links
            a, c = (links >= 0).nonzero()
            self._back(graph, links[a, c], batch[a])
            done = int(batch[-1]) + 1

    def _before(self, q, batch, most: int):
        """The nearest of all nodes that entered before each node of a batch, by one matrix product; -1: none."""
        np = self.np
        sim = q @ self.x[: batch[-1] + 1].T
        sim[:, batch[0] :][np.arange(len(batch))[None, :] >= np.arange(len(batch))[:, None]] = -np.inf
        k = min(most, sim.shape[1])
        got = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        return np.where(np.take_along_axis(sim, got, axis=1) > -np.inf, got, -1)

    def _back(self, graph, node, other, together: int = 8) -> None:
        """Add other to node's neighbours, some for each node at a time, choosing anew where a list is full."""
        np = self.np
        order = np.argsort(node, kind="stable")
        node, other = node[order], other[order]
        first = np.concatenate(([True], node[1:] != node[:-1])).nonzero()[0]
        size = np.diff(np.append(first, len(node)))
        nth = np.arange(len(node)) - np.repeat(first, size)
        for at in range(0, int(size.max(initial=0)), together):
            rows = (size > at).nonzero()[0]
            put = np.full((len(rows), together), -1, dtype=np.int64)
            pick = (nth >= at) & (nth < at + together)
            put[np.repeat(np.arange(len(rows)), np.minimum(size[rows] - at, together)), nth[pick] - at] = other[pick]
            of = node[first[rows]]
            cand = np.concatenate((graph[of], put), axis=1)
            cand = np.take_along_axis(cand, np.argsort(cand < 0, axis=1, kind="stable"), axis=1)
            full = cand[:, graph.shape[1]] >= 0
            graph[of[~full]] = cand[~full, : graph.shape[1]]
            if full.any():
                of, cand = of[full], cand[full]
                sim = np.where(cand >= 0, self.near(self.x[of], cand), -np.inf)
                cand = np.take_along_axis(cand, np.argsort(-sim, axis=1, kind="stable"), axis=1)
                graph[of] = self.diverse(of, cand, graph.shape[1])

    def search(self, queries, ef: int):
        """The ef best nodes found for each query (rows of plain vectors), best first; -1 where there are fewer."""
        np = self.np
        q = np.column_stack((queries, np.zeros(len(queries)))).astype(np.float32)
        return self.walk(self.layers[0], q, self._entries(0, q), min(ef, self.sizes[0]))[0]


def ef_of(n_shards: int, rows: float) -> int:
    """Nodes that a search keeps in each shard: fewer the more shards share the k best, more in large ones."""
    return round(max(64.0, 192 / n_shards**0.45) * max(1.0, rows / 8192) ** 0.25)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, ef: int | None = None, m: int = 16, shard_rows: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found for each query.

    vectors, queries: vec_id, embedding.  Nearness is the largest inner product in double precision,
    ties to the smaller vec_id; rows with a query's own vec_id are left out.  Rows whose vector is
    null, empty, zero or holds a null or a component that is not finite take no part; vectors of
    another length than the query's are not compared.  Equal rows count once; one vec_id with
    different vectors gives candidates of their own, and as a query asks with each of them; other
    columns are ignored; an empty table gives none.

    Graphs are walked in single precision; all that a walk found is scored in double precision
    before any is left out.  shard_rows: rows of a shard, by default as many as use the cluster's
    cores, between LEAST_ROWS and SHARD_ROWS.  Queries go to all tasks in blocks of at most
    BLOCK_BYTES, so a block is broadcast whatever their number.
    """
    sc = vectors.sparkSession.sparkContext

    def sound(df: DataFrame) -> DataFrame:
        df = df.select(df["vec_id"].cast("long").alias("vec_id"), df["embedding"].cast("array<double>").alias("embedding"))
        finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        df = df.filter(F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False)))
        return df.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))  # one zero

    # a class of equal vectors: a query needs no more than its k + 1 smallest ids, itself among them
    by_id = Window.partitionBy("embedding").orderBy("vec_id")
    members = sound(vectors).distinct().withColumn("nth", F.row_number().over(by_id)).filter(F.col("nth") <= k + 1)
    members = members.withColumn("k0", F.xxhash64("embedding")).withColumn("k1", F.xxhash64(F.lit("second"), "embedding"))
    members = reliable(members.withColumn("last", F.lead("nth").over(by_id).isNull()))
    reps = members.filter("nth = 1").select("k0", "k1", "vec_id", "embedding", F.size("embedding").alias("dim"), (~F.col("last")).alias("more"))
    n = reps.count()
    if shard_rows is None:
        shard_rows = min(SHARD_ROWS, max(LEAST_ROWS, math.ceil(n / max(1, sc.defaultParallelism))))
    n_shards = max(1, math.ceil(n / shard_rows))
    keep = ef or ef_of(n_shards, n / n_shards)

    def build(frame):
        import numpy as np
        import pandas as pd

        frame = frame.sort_values(["place", "k0", "k1"])
        x = np.array(frame["embedding"].tolist(), dtype=np.float64)
        world = SmallWorld(x, m=m)
        whole = lambda c: [frame[c].to_numpy().astype(np.int64).tobytes()]
        return pd.DataFrame({
            "dim": [x.shape[1]], "k0": whole("k0"), "k1": whole("k1"), "ids": whole("vec_id"), "more": whole("more"), "vectors": [x.tobytes()],
            "sizes": [np.array(world.sizes, dtype=np.int64).tobytes()], "layers": [[g.astype(np.int32).tobytes() for g in world.layers]],
        })

    placed = reps.withColumn("shard", F.pmod("k0", F.lit(n_shards))).withColumn("place", F.xxhash64("k0", F.lit(1)))
    index = placed.groupBy("dim", "shard").applyInPandas(build, "dim int, k0 binary, k1 binary, ids binary, more binary, vectors binary, sizes binary, layers array<binary>")
    index = reliable(index)

    asked = reliable(sound(queries).distinct().withColumn("dim", F.size("embedding")))
    size = asked.groupBy("dim").agg(F.count("*").alias("n")).collect()  # one row for each length of vectors
    # a query leaves out all rows of its vec_id, which may stand in several classes
    most = k + (asked.groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1)
    keep = max(keep, most)
    n_blocks = max(1, math.ceil(sum(8 * r["dim"] * r["n"] for r in size) / BLOCK_BYTES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n_blocks)))

    def hits_of(block: int) -> DataFrame:
        import numpy as np

        by_dim: dict[int, tuple] = {}
        rows = asked.filter(F.col("block") == block).orderBy("vec_id", "embedding").select("dim", "vec_id", "embedding").toArrow()  # BLOCK_BYTES on average
        for dim in {r["dim"] for r in size}:
            mine = rows.filter(np.equal(rows.column("dim").to_numpy(), dim))
            if mine.num_rows:
                flat = mine.column("embedding").combine_chunks().flatten().to_numpy()
                by_dim[dim] = mine.column("vec_id").to_numpy(), flat.reshape(-1, dim)
        sent = sc.broadcast(by_dim)

        def search(batches):
            import pyarrow as pa

            for batch in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
                row = batch.to_pylist()[0]
                asked_ids, q = sent.value.get(row["dim"], ((), None))
                if not len(asked_ids):
                    continue
                whole = {c: np.frombuffer(row[c], dtype=np.int64) for c in ("k0", "k1", "ids", "more", "sizes")}
                x = np.frombuffer(row["vectors"], dtype=np.float64).reshape(len(whole["ids"]), -1)
                layers = [np.frombuffer(g, dtype=np.int32).reshape(n, -1) for g, n in zip(row["layers"], whole["sizes"])]
                world = SmallWorld(x, whole["sizes"].tolist(), layers, m=m)
                for at in range(0, len(q), 256):
                    part = q[at : at + 256]
                    got = world.search(part, keep)
                    score = np.where(got >= 0, np.einsum("abd,ad->ab", x[got], part), -np.inf)
                    order = np.lexsort((whole["ids"][got], -score), axis=1)[:, :most]
                    got, score = np.take_along_axis(got, order, axis=1), np.take_along_axis(score, order, axis=1)
                    a, c = (score > -np.inf).nonzero()
                    node = got[a, c]
                    columns = {"query_id": asked_ids[at + a], "asked": at + a, "k0": whole["k0"][node], "k1": whole["k1"][node], "vec_id": whole["ids"][node], "more": whole["more"][node] != 0, "score": score[a, c]}
                    yield pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in columns.items()})

        found = index.mapInArrow(search, "query_id long, asked long, k0 long, k1 long, vec_id long, more boolean, score double")
        best = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
        found = reliable(found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= most).drop("n", "asked"))
        sent.unpersist()
        return found

    hits = hits_of(0)
    for block in range(1, n_blocks):
        hits = hits.unionByName(hits_of(block))
    # only classes of several rows are looked up; one that most queries hit must not be one task's work
    several = hits.filter("more").select("query_id", "k0", "k1", "score")
    n_hits = several.groupBy("k0", "k1").agg(F.count("*").alias("n"))
    others = members.filter("nth > 1 or not last").select("k0", "k1", "vec_id").join(n_hits, ["k0", "k1"])
    columns = ["query_id", "vec_id", "k0", "k1", "score"]
    every = hits.filter("not more").select(columns).unionByName(with_hot(several, others, ["k0", "k1"], several.count()).select(columns))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    # one vec_id may stand with several vectors, each a candidate; a query that asks twice gets each once
    every = every.filter("vec_id <> query_id").groupBy("query_id", "vec_id", "k0", "k1").agg(F.max("score").alias("score"))
    return every.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
