"""Coupling, hotspot and trend queries.  Components are nations of suppliers and customers, files parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.operators import cochange, coupling
from weftline.plans.history import LINKS, PAIRS, edges, links
from weftline.sources.tables import load

#: Behavioural weight: supplier nations that meet in an order; structural weight: trade between a
#: customer's and a supplier's nation.
MATRIX = """on_ AS (SELECT DISTINCT l_orderkey AS g, s_nationkey AS i FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
beh AS (SELECT x.i AS a, y.i AS b, count(*)::DOUBLE AS behavioral FROM on_ x JOIN on_ y ON x.g = y.g AND x.i < y.i GROUP BY ALL),
str AS (SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, count(*)::DOUBLE AS structural FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL),
both_ AS (SELECT a, b, coalesce(structural, 0) AS structural, coalesce(behavioral, 0) AS behavioral FROM str FULL JOIN beh USING (a, b)),
line AS (SELECT coalesce(median(structural) FILTER (structural > 0), 0) AS s, coalesce(median(behavioral) FILTER (behavioral > 0), 0) AS t FROM both_),
matrix AS (SELECT a, b, structural, behavioral, CASE WHEN structural >= s AND behavioral >= t THEN 'explicit_module' WHEN structural >= s THEN 'stable_interface' WHEN behavioral >= t THEN 'hidden_coupling' ELSE 'unrelated' END AS classification FROM both_, line)"""


def matrix(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    nation = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    trade = line.join(nation, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey")
    # one row for each nation of an order: at most as many as there are nations
    sets = trade.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("s_nationkey")).alias("items"))
    pairs = F.flatten(F.transform("items", lambda x, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    behavioral = sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").cast("double").alias("behavioral"))
    buyer = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    met = trade.join(buyer, F.col("l_orderkey") == F.col("o_orderkey")).filter("c_nationkey <> s_nationkey")
    structural = met.groupBy(F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b")).agg(F.count("*").cast("double").alias("structural"))
    return coupling.coupling_matrix(structural, behavioral)


@query("coupling_matrix", f"WITH {MATRIX} SELECT * FROM matrix")
def coupling_matrix(spark, sf_dir):
    return matrix(spark, sf_dir)


@query("hidden_coupling", f"WITH {MATRIX} SELECT * FROM matrix WHERE classification = 'hidden_coupling'")
def hidden_coupling(spark, sf_dir):
    return coupling.hidden_coupling(matrix(spark, sf_dir))


@query("component_profile", f"WITH {MATRIX} SELECT * FROM matrix WHERE a = 3 OR b = 3")
def component_profile(spark, sf_dir):
    return coupling.component_profile(matrix(spark, sf_dir), 3)


@query("behaviour_lift", f"WITH {PAIRS}, e AS (SELECT a, b, sum(w) AS w FROM pairs GROUP BY a, b) SELECT least(p.p_brand, q.p_brand) AS a, greatest(p.p_brand, q.p_brand) AS b, round(sum(w), 4) AS behavioral FROM e JOIN part p ON p.p_partkey = e.a JOIN part q ON q.p_partkey = e.b WHERE p.p_brand <> q.p_brand GROUP BY 1, 2")
def behaviour_lift(spark, sf_dir):
    owner = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("component"))
    return coupling.lifted(edges(spark, sf_dir), owner).withColumn("behavioral", F.round("behavioral", 4))


@query("hotspots", "SELECT l_partkey AS item, count(DISTINCT l_orderkey) AS n, p_size AS size, count(DISTINCT l_orderkey) * p_size AS score FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 0 GROUP BY l_partkey, p_size")
def hotspots(spark, sf_dir):
    sizes = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_size").alias("size"))
    return coupling.hotspots(cochange.frequencies(links(spark, sf_dir), "l_orderkey", "l_partkey"), sizes)


@query(
    "trend_half_split",
    "WITH r AS (SELECT l_partkey AS item, l_quantity AS v, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS k, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem), m AS (SELECT item, max(n) AS n, avg(v) FILTER (k <= n // 2) AS a, avg(v) FILTER (k > n // 2) AS b FROM r GROUP BY item), d AS (SELECT item, n, CASE WHEN n < 2 THEN 0.0 ELSE b - a END AS d FROM m) SELECT item, n, CASE WHEN d > 1 THEN 'increasing' WHEN d < -1 THEN 'decreasing' ELSE 'stable' END AS direction, round(abs(d), 2) AS magnitude FROM d",
)
def trend_half_split(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "item")
    return coupling.half_trend(rows, "item", "l_quantity", "l_shipdate", "l_orderkey", "l_linenumber")


@query(
    "neighborhood",
    f"WITH {PAIRS}, e AS (SELECT a, b, sum(w) AS w, count(*) AS n FROM pairs GROUP BY a, b), d AS (SELECT a AS item, b AS neighbour, w, n FROM e UNION ALL SELECT b, a, w, n FROM e) SELECT neighbour, round(w, 6) AS weight, n, CASE WHEN round(w, 6) >= 0.5 THEN 'direct' WHEN w > 0 THEN 'moderate' ELSE 'structural' END AS tier FROM d WHERE item = 11",
)
def neighborhood(spark, sf_dir):
    rows = cochange.neighbours_of(links(spark, sf_dir), "l_orderkey", "l_partkey", 11).withColumn("weight", F.round("weight", 6))
    return coupling.neighbourhood(rows, line=0.5).select("neighbour", "weight", "n", "tier")


@query(
    "edge_classes",
    f"WITH {LINKS}, e AS (SELECT x.i AS a, y.i AS b, count(*) AS n FROM links x JOIN links y ON x.g = y.g AND x.i < y.i GROUP BY ALL) SELECT CASE WHEN p.p_brand = q.p_brand THEN 'explicit_module' WHEN p.p_type = q.p_type AND n >= 2 THEN 'explicit_module' WHEN p.p_type = q.p_type THEN 'stable_interface' WHEN n >= 2 THEN 'hidden_coupling' ELSE 'unrelated' END AS class, count(*) AS edges FROM e JOIN part p ON p.p_partkey = a JOIN part q ON q.p_partkey = b GROUP BY 1",
)
def edge_classes(spark, sf_dir):
    part = load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    rows = edges(spark, sf_dir).join(part.toDF("a", "brand_a", "type_a"), "a").join(part.toDF("b", "brand_b", "type_b"), "b")
    kind = F.when(F.col("brand_a") == F.col("brand_b"), "explicit_module").otherwise(coupling.classify((F.col("type_a") == F.col("type_b")).cast("int"), F.col("n"), F.lit(1), F.lit(2)))
    return rows.groupBy(kind.alias("class")).agg(F.count("*").alias("edges"))
