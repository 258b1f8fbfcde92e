"""Directed graphs as edge tables (src, dst): reachability, cycles, longest paths, importers, call trees."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """root, node, depth (least) of everything reachable from seeds (column node), seeds at depth 0.

    max_depth: only what is at most so many steps away; None: all.
    A frontier loop: each round joins only the nodes found in the round before and drops those seen,
    checkpointed so that plans do not grow and a lost executor costs one round.
    """
    step = edges.select("src", "dst").distinct()
    seen = checkpoint(seeds.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")).distinct())
    front = seen
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        nxt = met(front, step, front["node"] == step["src"]).select("root", F.col("dst").alias("node")).distinct()
        front = checkpoint(met(nxt, seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors share, as the session names it.

    A temporary one only where none is named and all runs on one machine; else that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        import tempfile

        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weftline-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder."""
    from uuid import uuid4

    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Replicated checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder and read back.

    For loops whose rounds join a table with itself: a checkpoint keeps the estimate of its size, which such
    a loop squares every round until planning is slower than the work; a written table has its true size.
    """
    path = scratch(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """left joined to right by a shuffle of both.

    For loops over a whole graph: a round's table is small in its files, so each round would send it to all
    machines through the driver.
    """
    return left.join(right.hint("merge"), on, how)


def reversed_edges(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Edges turned round; with nodes (column node), only between known ones."""
    out = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if nodes is not None:
        for end in ("src", "dst"):
            out = out.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    return out.select("src", "dst")


ROOT = "\x00root"


def jumped(pointers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pointers (node, to, d; one for each node) led to where they end: (node, to, d) and those that run in a circle (None: none).

    Pointer doubling: each round replaces a pointer by the pointer of what it points to, so a chain of n
    nodes takes log2(n) rounds, each with one row for each node.
    """
    now, rounds = pointers.select("node", "to", "d"), None
    for k in count(1):
        inner = now.select(F.col("node").alias("via"), F.col("to").alias("next"), F.col("d").alias("more"))
        led = met(now, inner, F.col("to") == F.col("via"), "left")
        led = written(led.select("node", F.coalesce("next", "to").alias("to"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"), F.col("next").isNotNull().alias("open")))
        now = led.drop("open")
        if led.filter("open").isEmpty():
            return now, None
        if k == 8:  # a longer chain, or a circle: that is known once all nodes could have been passed
            rounds = now.count().bit_length() + 1
        if rounds is not None and k >= rounds:
            return led.filter("not open").drop("open"), led.filter("open").drop("open")


def contracted(edges: DataFrame) -> DataFrame:
    """node, depth: longest path that ends in each node, for nodes that no cycle leads to.

    All sources are one root.  A node with one predecessor hangs on it, and chains of such nodes are
    led to their top by pointer doubling; they leave the graph, their edges going on from the top with
    the length added, the longest for each pair.  That leaves fewer predecessors, and the next round
    finds new nodes with one, as the first node in any order always has.  So rounds count how often
    paths join and part again on the way to a node, not how long they are: few for chains, many for a
    deep mesh.
    """
    rows = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).distinct()
    sources = met(rows.select(F.col("src").alias("node")).distinct(), rows.select(F.col("dst").alias("node")), "node", "left_anti")
    hung = [written(sources.select("node", F.lit(ROOT).alias("to"), F.lit(0).alias("d")))]
    top = hung[0].select(F.col("node").alias("src"), F.lit(ROOT).alias("top"))
    left = met(rows, top, "src", "left").select(F.coalesce("top", "src").alias("src"), "dst", F.lit(1).alias("w"))
    left, circles = written(left.groupBy("src", "dst").agg(F.max("w").alias("w"))), None
    while not left.isEmpty():
        single = left.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.any_value("src").alias("to"), F.any_value("w").alias("d")).filter("n = 1")
        if circles is not None:
            single = met(single, circles, "node", "left_anti")
        found, open_ = jumped(single)
        if open_ is not None:
            more = open_.select("node")
            circles = written(more if circles is None else circles.unionByName(more))
        if found.isEmpty():
            break
        hung.append(found)
        left = met(left, found.select(F.col("node").alias("dst")), "dst", "left_anti")
        led = met(left, found.select(F.col("node").alias("src"), F.col("to").alias("top"), F.col("d").alias("more")), "src", "left")
        led = led.select(F.coalesce("top", "src").alias("src"), "dst", (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"))
        left = written(led.groupBy("src", "dst").agg(F.max("w").alias("w")))
    depths = None
    for found in reversed(hung):  # those that left last hang on the root only
        own = found.filter(F.col("to") == ROOT).select("node", F.col("d").alias("depth"))
        if depths is not None:
            on = met(found, depths.select(F.col("node").alias("to"), "depth"), "to").select("node", (F.col("depth") + F.col("d")).alias("depth"))
            own = depths.unionByName(own).unionByName(on)
        depths = written(own)
    return depths


def all_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


#: Levels that are taken one by one before chains are contracted.
SHALLOW = 16


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes left after peeling, again and again, those nothing leads to: on a cycle or downstream of one.

    Shallow graphs are peeled level by level; what is left of deep ones is contracted.
    """
    left = checkpoint(edges.select("src", "dst").distinct())
    n, now = None, left.count()
    for _ in range(SHALLOW):
        if now == n:
            return all_nodes(left)
        n, left = now, checkpoint(met(left, left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        now = left.count()
    free, nodes = contracted(left).select(F.col("node").alias("_n")), all_nodes(left)
    return met(nodes, free, nodes["node"].cast("string") == F.col("_n"), "left_anti")


def longest_paths(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node, depth: longest path that ends in each node of an acyclic graph, 0 for its sources.

    A cycle is an error that names some of the nodes it reaches, and so is a path longer than max_depth.
    Each round keeps one row for each node that a path of that length reaches, so rows never multiply;
    a graph of more than SHALLOW levels has its chains contracted instead.
    """
    step = checkpoint(edges.select("src", "dst").distinct())
    nodes = all_nodes(step)
    found = nodes.withColumn("depth", F.lit(0))
    front = checkpoint(nodes)
    for depth in range(1, SHALLOW + 1):
        front = checkpoint(met(front, step, front["node"] == step["src"]).select(F.col("dst").alias("node")).distinct())
        if front.isEmpty():
            return found.groupBy("node").agg(F.max("depth").alias("depth"))
        if max_depth is not None and depth > max_depth:
            raise ValueError("the graph has a cycle or a path longer than max_depth")
        found = found.unionByName(front.withColumn("depth", F.lit(depth)))
    deep = contracted(step).withColumnRenamed("node", "_n")
    found = checkpoint(met(nodes, deep, nodes["node"].cast("string") == F.col("_n"), "left").select("node", "depth"))
    lost = [str(r["node"]) for r in found.filter("depth is null").limit(20).collect()]
    if lost:
        raise ValueError(f"the graph has a cycle before {', '.join(sorted(lost))}")
    if max_depth is not None and not found.filter(F.col("depth") > max_depth).isEmpty():
        raise ValueError("the graph has a path longer than max_depth")
    return found


def critical_path(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """One row, path: the longest path, among equals the least as an array; null without edges.

    Every node points to the least of its successors from which the longest way is left; the path is
    what the best node's pointers lead to, found by doubling: after k rounds it has 2**k nodes.  A
    cycle is an error, and so is a path of more than max_depth edges.
    """
    step = checkpoint(edges.select("src", "dst").distinct())
    height = written(longest_paths(step.select(F.col("dst").alias("src"), F.col("src").alias("dst")), max_depth))
    ahead = met(met(step, height.select(F.col("node").alias("src"), F.col("depth").alias("h")), "src"), height.select(F.col("node").alias("dst"), F.col("depth").alias("left")), "dst").filter("h = left + 1")
    jump = written(ahead.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("to")))
    longest = height.agg(F.max("depth").alias("depth")).first()["depth"] or 0
    path = written(height.filter(F.col("depth") == longest).agg(F.min("node").alias("node")).filter("node is not null"))  # one row
    for k in range(longest.bit_length()):
        path = written(path.unionByName(met(path, jump, "node").select(F.col("to").alias("node"))).distinct())
        if k + 1 < longest.bit_length():
            jump = written(met(jump, jump.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to")))
    path = met(path, height, "node").agg(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("k"), "node"))).alias("p"))
    return path.select(F.when(F.size("p") > 0, F.col("p.node")).alias("path"))


def importers(imports: DataFrame, target, max_depth: int | None = None) -> DataFrame:
    """path, direct, barrel: files that import target (distinct), directly or through re-exporting files.

    imports: path, resolved_path, is_re_export.  Only files that re-export what they import are
    passed through, and only files that import for themselves count behind them.
    """
    edges = imports.filter("resolved_path is not null").select(F.col("resolved_path").alias("src"), F.col("path").alias("dst"), "is_re_export").distinct()
    direct = edges.filter(F.col("src") == target).select(F.col("dst").alias("path")).distinct()
    barrels = reachable(edges.filter("is_re_export"), direct.sparkSession.createDataFrame([(target,)], "node string"), max_depth).filter("depth > 0").select(F.col("node").alias("src"))
    behind = edges.filter("not is_re_export").join(barrels, "src", "left_semi").select(F.col("dst").alias("path")).distinct()
    return direct.withColumn("direct", F.lit(True)).join(behind.withColumn("barrel", F.lit(True)), "path", "full").fillna(False)


def unused_exports(exports: DataFrame, imports: DataFrame) -> DataFrame:
    """path, exported_name of exports that no file imports; a wildcard import uses all, re-exporting files are left out.

    exports: path, exported_name, is_barrel; imports: resolved_path, imported_name.
    """
    used = imports.select(F.col("resolved_path").alias("path"), F.col("imported_name").alias("exported_name")).distinct()
    rows = exports.filter("not is_barrel").select("path", "exported_name").distinct()
    return rows.join(used.filter("exported_name = '*'").select("path").distinct(), "path", "left_anti").join(used, ["path", "exported_name"], "left_anti")


def call_tree(calls: DataFrame, root, depth: int = 3, wide: int = 10) -> DataFrame:
    """node, depth (least) and fan_out of what is reached from root over calls (src, dst), depth clamped to 1..5.

    high is set above `wide` successors.
    """
    depth = min(max(depth, 1), 5)
    seeds = calls.sparkSession.createDataFrame([(root,)], ["node"])
    fan = calls.distinct().groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out"))
    rows = reachable(calls, seeds, depth).drop("root").join(fan, "node", "left").fillna(0, ["fan_out"])
    return rows.withColumn("high", F.col("fan_out") > wide)


def mermaid(edges: DataFrame) -> DataFrame:
    """One text row for each edge of a diagram."""
    return edges.select(F.format_string("  %s --> %s", "src", "dst").alias("line"))
