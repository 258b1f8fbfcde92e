"""Graph, dependency and scheduling queries over edges derived from nations, suppliers and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.functions.paths import owners
from weftline.operators import diffs, graph, schedule
from weftline.sources.tables import load

EDGES = "edges AS (SELECT n_nationkey AS src, (7 * n_nationkey + 3) % 25 AS dst FROM nation)"
DAG = "dag AS (SELECT x.n_nationkey AS src, y.n_nationkey AS dst FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey AND (x.n_nationkey * 5 + y.n_nationkey * 3) % 7 = 0)"


def edges(spark, sf_dir):
    return load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("dst"))


def dag(spark, sf_dir):
    nation = load(spark, sf_dir, "nation").select("n_nationkey")
    x, y = nation.toDF("src"), nation.toDF("dst")
    return x.join(F.broadcast(y), (F.col("src") < F.col("dst")) & ((F.col("src") * 5 + F.col("dst") * 3) % 7 == 0))  # nations: 25 rows at any scale


@query("reachability", f"WITH RECURSIVE {EDGES}, w(root, node, depth) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation WHERE n_nationkey IN (0, 5) UNION ALL SELECT root, dst, depth + 1 FROM w JOIN edges ON src = node WHERE depth < 6) SELECT root, node, min(depth) AS depth FROM w GROUP BY ALL")
def reachability(spark, sf_dir):
    seeds = load(spark, sf_dir, "nation").filter("n_nationkey in (0, 5)").select(F.col("n_nationkey").alias("node"))
    return graph.reachable(edges(spark, sf_dir), seeds, 6)


@query("dependents", f"WITH RECURSIVE {DAG}, w(root, node, depth) AS (SELECT 20, 20, 0 UNION ALL SELECT root, src, depth + 1 FROM w JOIN dag ON dst = node) SELECT node, min(depth) AS depth FROM w GROUP BY node")
def dependents(spark, sf_dir):
    seeds = spark.range(20, 21).select(F.col("id").cast("int").alias("node"))
    return graph.reachable(graph.reversed_edges(dag(spark, sf_dir)), seeds).select("node", "depth")


@query(
    "cycle_nodes",
    f"WITH RECURSIVE {EDGES}, w(root, node, depth) AS (SELECT src, dst, 1 FROM edges UNION ALL SELECT root, dst, depth + 1 FROM w JOIN edges ON src = node WHERE depth < 25) SELECT DISTINCT node FROM w WHERE depth = 25",
)
def cycle_nodes(spark, sf_dir):
    return graph.cyclic_nodes(edges(spark, sf_dir))


@query("longest_wave", f"WITH RECURSIVE {DAG}, w(node, depth) AS (SELECT DISTINCT node, 0 FROM (SELECT src AS node FROM dag UNION SELECT dst FROM dag) UNION SELECT dst, depth + 1 FROM w JOIN dag ON src = node) SELECT node, max(depth) AS depth FROM w GROUP BY node")
def longest_wave(spark, sf_dir):
    return graph.longest_paths(dag(spark, sf_dir), 25)


@query(
    "critical_path",
    f"WITH RECURSIVE {DAG}, w(node, path) AS (SELECT node, [node] FROM (SELECT src AS node FROM dag UNION SELECT dst FROM dag) UNION ALL SELECT dst, list_append(path, dst) FROM w JOIN dag ON src = node) SELECT array_to_string(path, '>') AS path FROM w ORDER BY len(path) DESC, path LIMIT 1",
)
def critical_path(spark, sf_dir):
    return graph.critical_path(dag(spark, sf_dir), 25).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


def steps(spark, sf_dir):
    """Edges between parts: each to the next of its thousand, and the first of a thousand to the middle of the next."""
    p = F.col("p_partkey")
    part = load(spark, sf_dir, "part")
    ends = part.select(p.alias("src"), F.explode(F.array_compact(F.array(F.when(p % 1000 != 0, p + 1), F.when(p % 1000 == 1, p + 1500)))).alias("dst"))
    return graph.met(ends, part.select(p.alias("dst")), "dst", "left_semi").select("src", "dst")


STEPS = "e AS (SELECT p_partkey AS src, unnest([CASE WHEN p_partkey % 1000 <> 0 THEN p_partkey + 1 END, CASE WHEN p_partkey % 1000 = 1 THEN p_partkey + 1500 END]) AS dst FROM part), s AS (SELECT src, dst FROM e WHERE dst IN (SELECT p_partkey FROM part))"
#: Longest paths level by level: as many rounds as the longest path has edges.
DEPTHS = f"WITH RECURSIVE {STEPS}, w(node, depth) AS (SELECT src, 0 FROM s WHERE src NOT IN (SELECT dst FROM s) UNION SELECT dst, depth + 1 FROM w JOIN s ON src = node), d AS (SELECT node, max(depth) AS depth FROM w GROUP BY node)"


@query("chain_depths", f"{DEPTHS} SELECT node, depth FROM d")
def chain_depths(spark, sf_dir):
    return graph.longest_paths(steps(spark, sf_dir))


@query("chain_length", f"{DEPTHS} SELECT max(depth) + 1 AS nodes, (SELECT count(*) FROM d) AS every FROM d")
def chain_length(spark, sf_dir):
    found = graph.critical_path(steps(spark, sf_dir)).select(F.size("path").alias("nodes"))
    return found.crossJoin(graph.all_nodes(steps(spark, sf_dir)).agg(F.count("*").alias("every")))  # one row each


TASKS = """t AS (SELECT s_suppkey AS id, s_suppkey % 12 AS a, (s_suppkey * 5 + 1) % 12 AS b, s_nationkey AS m FROM supplier),
touch AS (SELECT id, 'w' AS mode, 'c' || a AS name FROM t UNION SELECT id, 'r', 'c' || b FROM t UNION SELECT id, 'm', 'n' || m FROM t)"""


def tasks(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    name = lambda prefix, c: F.array(F.concat(F.lit(prefix), c.cast("string")))
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("ord"), name("c", F.col("s_suppkey") % 12).alias("writes"), name("c", (F.col("s_suppkey") * 5 + 1) % 12).alias("reads"), name("n", F.col("s_nationkey")).alias("mutexes"))


@query(
    "hazards",
    f"""WITH {TASKS}, p AS (SELECT x.id AS source, y.id AS target, x.mode AS m1, y.mode AS m2, x.name FROM touch x JOIN touch y ON x.name = y.name AND x.id <> y.id)
SELECT DISTINCT CASE WHEN m1 = 'w' AND m2 = 'r' THEN 'RAW' WHEN m1 = 'w' AND m2 = 'w' THEN 'WAW' WHEN m1 = 'r' AND m2 = 'w' THEN 'WAR' ELSE 'MUTEX' END AS type, source, target, name FROM p
WHERE (m1 = 'w' AND m2 = 'r') OR (m1 = m2 AND m1 IN ('w', 'm') AND source < target) OR (m1 = 'r' AND m2 = 'w' AND NOT EXISTS (SELECT 1 FROM touch z WHERE z.id = source AND z.mode = 'w' AND z.name = p.name))""",
)
def hazards(spark, sf_dir):
    return schedule.hazards(tasks(spark, sf_dir))


@query(
    "plan_issues",
    """WITH t AS (SELECT s_suppkey AS id, 'c' || s_suppkey % 12 AS w, 'n' || s_nationkey AS m FROM supplier), lone AS (SELECT m AS name, min(id) AS id FROM t GROUP BY m HAVING count(*) = 1)
SELECT 'unknown_component' AS issue, id, w AS name FROM t WHERE w IN ('c9', 'c10', 'c11') UNION ALL SELECT 'unknown_component', s_suppkey, 'c' || (s_suppkey * 5 + 1) % 12 FROM supplier WHERE (s_suppkey * 5 + 1) % 12 >= 9
UNION ALL SELECT 'write_conflict', x.id, x.w FROM t x JOIN t y ON x.w = y.w AND x.id < y.id UNION ALL SELECT 'lone_mutex', id, name FROM lone""",
)
def plan_issues(spark, sf_dir):
    components = spark.range(9).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("name"), F.array().cast("array<string>").alias("deps"))
    return schedule.plan_issues(tasks(spark, sf_dir), components).select("issue", "id", "name")


@query(
    "owner_prefix",
    r"""WITH f AS (SELECT page_id, regexp_replace(url, '^https?://|[?#].*$', '', 'g') AS file FROM pages), c AS (SELECT DISTINCT split_part(file, '/', 1) AS path FROM f UNION SELECT DISTINCT split_part(file, '/', 1) || '/' || split_part(file, '/', 2) FROM f WHERE split_part(file, '/', 2) < 'f')
SELECT DISTINCT file, arg_max(path, length(path)) AS component FROM f JOIN c ON file = path OR starts_with(file, path || '/') GROUP BY page_id, file""",
)
def owner_prefix(spark, sf_dir):
    files = load(spark, sf_dir, "pages").select(F.regexp_replace("url", r"^https?://|[?#].*$", "").alias("file")).distinct()
    part = F.split("file", "/")
    two = files.filter((F.size(part) > 1) & (part[1] < "f")).select(F.concat_ws("/", part[0], part[1]).alias("path"))
    components = files.select(part[0].alias("path")).unionByName(two).distinct().withColumn("name", F.col("path"))
    return owners(files, components)


DECLARED = "declared AS (SELECT DISTINCT n_nationkey AS src, (n_nationkey * 3 + 1) % 25 AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey + 1) % 25 FROM nation), trade AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL), inferred AS (SELECT src, dst FROM trade WHERE n % 3 = 0)"


def declared(spark, sf_dir):
    n = F.col("n_nationkey")
    return load(spark, sf_dir, "nation").select(n.alias("src"), F.explode(F.array((n * 3 + 1) % 25, (n + 1) % 25)).alias("dst")).distinct()


def trade(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    buyer = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.join(buyer, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("n"))


@query("dep_diff", f"WITH {DECLARED} SELECT src, dst, 'missing' AS status FROM (SELECT * FROM inferred EXCEPT SELECT * FROM declared) UNION ALL SELECT src, dst, 'extra' FROM (SELECT * FROM declared EXCEPT SELECT * FROM inferred)")
def dep_diff(spark, sf_dir):
    return diffs.edge_diff(declared(spark, sf_dir), trade(spark, sf_dir).filter("n % 3 = 0"))


@query("unused_both", f"WITH {DECLARED} SELECT src, dst FROM declared WHERE src IN (SELECT src FROM trade) AND (src, dst) NOT IN (SELECT (src, dst) FROM inferred) AND (src, dst) NOT IN (SELECT (src, dst) FROM trade WHERE n % 2 = 0)")
def unused_both(spark, sf_dir):
    met = trade(spark, sf_dir)
    return diffs.unused_by_both(declared(spark, sf_dir), met.filter("n % 3 = 0"), met.filter("n % 2 = 0"), met)


SNAP = "old AS (SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment FROM customer WHERE c_custkey % 10 <> 0), new AS (SELECT c_custkey AS id, c_nationkey AS nation, CASE WHEN c_custkey % 7 = 0 THEN 'MOVED' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 11 <> 0)"


@query(
    "snapshot_diff",
    f"WITH {SNAP}, j AS (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.segment = n.segment THEN 'same' ELSE 'modified' END AS status FROM old o FULL JOIN new n ON o.id = n.id) SELECT id, status, CASE WHEN status = 'modified' THEN 'segment' ELSE '' END AS fields FROM j",
)
def snapshot_diff(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    new = c.filter("id % 11 <> 0").withColumn("segment", F.when(F.col("id") % 7 == 0, "MOVED").otherwise(F.col("segment")))
    return diffs.table_diff(c.filter("id % 10 <> 0"), new, ["id"], ["nation", "segment"]).withColumn("fields", F.array_join("fields", ","))


@query("call_tree", f"WITH RECURSIVE {DAG}, w(node, depth) AS (SELECT 0, 0 UNION ALL SELECT dst, depth + 1 FROM w JOIN dag ON src = node WHERE depth < 3), d AS (SELECT node, min(depth) AS depth FROM w GROUP BY node) SELECT d.node, depth, (SELECT count(*) FROM dag WHERE src = d.node) AS fan_out, (SELECT count(*) FROM dag WHERE src = d.node) > 2 AS high FROM d")
def call_tree(spark, sf_dir):
    return graph.call_tree(dag(spark, sf_dir), 0, 3, wide=2).select(F.col("node").cast("int").alias("node"), "depth", "fan_out", "high")


@query("diagram", f"WITH {DAG} SELECT '  ' || src || ' --> ' || dst AS line FROM dag")
def diagram(spark, sf_dir):
    return graph.mermaid(dag(spark, sf_dir).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")))
