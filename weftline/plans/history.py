"""Change-history queries.  A commit is an order, an artifact a part, a link their distinct pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.operators import cochange, index
from weftline.operators.sized import dealt
from weftline.sources.tables import load

LINKS = "links AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS i FROM lineitem)"
SIZED = LINKS + ", sized AS (SELECT g, i, count(*) OVER (PARTITION BY g) AS k FROM links)"
PAIRS = SIZED + ", pairs AS (SELECT x.g, x.i AS a, y.i AS b, 1.0::DOUBLE / (x.k - 1) AS w FROM sized x JOIN sized y ON x.g = y.g AND x.i < y.i WHERE x.k BETWEEN 2 AND 50)"
TYPE_WEIGHTS = {"1-URGENT": 1.0, "2-HIGH": 0.8, "3-MEDIUM": 0.6, "4-NOT SPECIFIED": 0.4, "5-LOW": 0.2}


def links(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")


def edges(spark, sf_dir):
    return cochange.edges(links(spark, sf_dir), "l_orderkey", "l_partkey")


@query("cochange_edges", f"WITH {PAIRS} SELECT a, b, round(sum(w), 6) AS weight, count(*) AS n FROM pairs GROUP BY a, b")
def cochange_edges(spark, sf_dir):
    return edges(spark, sf_dir).select("a", "b", F.round("weight", 6).alias("weight"), "n")


@query(
    "cochange_edges_typed",
    f"WITH {PAIRS} SELECT a, b, round(sum(w * CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TYPE_WEIGHTS.items()) + " ELSE 1.0 END), 6) AS weight, count(*) AS n FROM pairs JOIN orders ON o_orderkey = g GROUP BY a, b",
)
def cochange_edges_typed(spark, sf_dir):
    share = F.create_map(*[F.lit(x) for kv in TYPE_WEIGHTS.items() for x in kv])
    weights = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("g"), F.coalesce(share[F.col("o_orderpriority")], F.lit(1.0)).alias("m"))
    rows = cochange.edges(links(spark, sf_dir), "l_orderkey", "l_partkey", weights=weights)
    return rows.select("a", "b", F.round("weight", 6).alias("weight"), "n")


@query("file_frequencies", "SELECT l_partkey AS item, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1")
def file_frequencies(spark, sf_dir):
    return cochange.frequencies(links(spark, sf_dir), "l_orderkey", "l_partkey")


@query(
    "filtered_commits",
    "WITH c AS (SELECT o_orderkey, o_orderpriority, count(*) AS files FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) SELECT o_orderpriority AS subject, count(*) AS kept, sum(files)::BIGINT AS files FROM c WHERE files <= 5 AND NOT contains(lower(o_orderpriority), 'low') GROUP BY 1",
)
def filtered_commits(spark, sf_dir):
    commits = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    commits = commits.groupBy("o_orderkey", F.col("o_orderpriority").alias("subject")).agg(F.collect_list("l_partkey").alias("files"))
    kept = cochange.filter_commits(commits, 5, ("low",))
    return kept.groupBy("subject").agg(F.count("*").alias("kept"), F.sum(F.size("files")).alias("files"))


JACCARD = """, total AS (SELECT i, count(*) AS n FROM links GROUP BY i),
shared AS (SELECT x.i AS target, y.i AS other, count(*) AS shared FROM links x JOIN links y ON x.g = y.g AND x.i <> y.i WHERE x.i {0} GROUP BY ALL),
neighbours AS (SELECT target, other, shared, shared::DOUBLE / (a.n + b.n - shared) AS jaccard FROM shared JOIN total a ON a.i = target JOIN total b ON b.i = other)"""


@query("jaccard_neighbors", f"WITH {LINKS}{JACCARD.format('= 1')} SELECT target, other, shared, round(jaccard, 9) AS jaccard FROM neighbours ORDER BY shared DESC, other LIMIT 20")
def jaccard_neighbors(spark, sf_dir):
    targets = spark.range(1, 2).select(F.col("id").alias("target"))
    rows = cochange.jaccard_neighbours(links(spark, sf_dir), targets, "l_orderkey", "l_partkey")
    return cochange.top_k(rows, 20, F.desc("shared"), F.col("other")).withColumn("jaccard", F.round("jaccard", 9))


@query(
    "jaccard_lift",
    f"WITH {LINKS}{JACCARD.format('IS NOT NULL')} SELECT p.p_brand AS src, q.p_brand AS dst, count(*) AS n, round(max(jaccard), 9) AS jaccard FROM neighbours JOIN part p ON p.p_partkey = target JOIN part q ON q.p_partkey = other WHERE jaccard >= 0.015 AND p.p_brand <> q.p_brand GROUP BY ALL",
)
def jaccard_lift(spark, sf_dir):
    owner = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("component"))
    rows = cochange.jaccard_lift(links(spark, sf_dir), owner, "l_orderkey", "l_partkey", 0.015)
    return rows.withColumn("jaccard", F.round("jaccard", 9))


@query(
    "weighted_neighbors",
    f"WITH {PAIRS}, e AS (SELECT a, b, sum(w) AS w, count(*) AS n FROM pairs GROUP BY a, b), t AS (SELECT CASE WHEN a = 7 THEN b ELSE a END AS p, w, n FROM e WHERE a = 7 OR b = 7) SELECT p_name AS neighbour, p AS partkey, round(w, 6) AS weight, n FROM t JOIN part ON p_partkey = p ORDER BY round(w, 6) DESC, p LIMIT 20",
)
def weighted_neighbors(spark, sf_dir):
    rows = cochange.neighbours_of(links(spark, sf_dir), "l_orderkey", "l_partkey", 7).withColumn("weight", F.round("weight", 6))
    rows = cochange.top_k(rows, 20, F.desc("weight"), F.col("neighbour"))
    return rows.join(load(spark, sf_dir, "part"), F.col("neighbour") == F.col("p_partkey")).select(F.col("p_name").alias("neighbour"), F.col("p_partkey").alias("partkey"), "weight", "n")


@query(
    "top5_neighbors",
    f"WITH {PAIRS}, e AS (SELECT a, b, round(sum(w), 6) AS w FROM pairs GROUP BY a, b), d AS (SELECT a AS item, b AS neighbour, w FROM e UNION ALL SELECT b, a, w FROM e) SELECT item, neighbour, w AS weight FROM d QUALIFY row_number() OVER (PARTITION BY item ORDER BY w DESC, neighbour) <= 5",
)
def top5_neighbors(spark, sf_dir):
    rows = cochange.both_ways(edges(spark, sf_dir)).withColumn("weight", F.round("weight", 6))
    rows = dealt(rows, 4 * links(spark, sf_dir).count(), "item")
    return cochange.top_k(rows, 5, F.desc("weight"), F.col("neighbour"), per=["item"]).select("item", "neighbour", "weight")


@query("provenance", "SELECT DISTINCT l_partkey AS item, o_orderkey AS commit, o_orderdate AS ts, o_orderpriority AS kind FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey IN (1, 2, 3)")
def provenance(spark, sf_dir):
    rows = index.provenance(links(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey"), load(spark, sf_dir, "orders"), spark.range(1, 4).select(F.col("id").alias("l_partkey")), "l_partkey", "o_orderkey")
    return rows.select(F.col("l_partkey").alias("item"), F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("kind"))


@query(
    "artifact_card",
    "WITH h AS (SELECT DISTINCT l_partkey AS item, o_orderkey AS commit, o_orderdate AS ts FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT item, commit, ts, count(*) OVER (PARTITION BY item) AS total, row_number() OVER (PARTITION BY item ORDER BY ts DESC, commit DESC)::BIGINT AS nth, count(*) OVER (PARTITION BY item) > 5 AS truncated FROM h QUALIFY nth <= 5",
)
def artifact_card(spark, sf_dir):
    history = links(spark, sf_dir).distinct().join(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    history = history.select(F.col("l_partkey").alias("item"), F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("ts"))
    return index.artifact_card(history, "item", "ts", "commit").withColumn("nth", F.col("nth").cast("long"))


TAGS = "tags AS (SELECT DISTINCT p_partkey AS item, unnest(list_concat([p_brand], string_split(p_name, ' '))) AS tag FROM part)"


def part_tags(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("item"), F.explode(F.concat(F.array("p_brand"), F.split("p_name", " "))).alias("tag")).distinct()


@query("all_tags_match", f"WITH {TAGS}, t AS (SELECT min(tag) AS x FROM tags WHERE tag LIKE 'Brand%'), w AS (SELECT tag FROM tags WHERE tag NOT LIKE 'Brand%' GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 1), hit AS (SELECT item FROM tags WHERE tag IN (SELECT x FROM t UNION SELECT tag FROM w) GROUP BY item HAVING count(*) = 2) SELECT item, string_agg(tag, ',' ORDER BY tag) AS tags FROM tags WHERE item IN (SELECT item FROM hit) GROUP BY item")
def all_tags_match(spark, sf_dir):
    tags = part_tags(spark, sf_dir)
    brand = tags.filter("tag like 'Brand%'").agg(F.min("tag").alias("tag"))
    word = index.tag_counts(tags.filter("tag not like 'Brand%'")).orderBy(F.desc("n"), "tag").limit(1).select("tag")
    wanted = [r["tag"] for r in brand.unionByName(word).collect()]  # two rows
    return index.with_all_tags(tags, wanted)


@query("tag_counts", f"WITH {TAGS} SELECT tag, count(*) AS n FROM tags GROUP BY tag")
def tag_counts(spark, sf_dir):
    return index.tag_counts(part_tags(spark, sf_dir))


@query(
    "index_status",
    "SELECT (SELECT count(*) FROM orders) AS commits, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS alive, (SELECT count(*) FROM part) - (SELECT count(DISTINCT l_partkey) FROM lineitem) AS dead, (SELECT count(DISTINCT p_brand) FROM part) AS tags, (SELECT arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) FROM orders) AS last_commit",
)
def index_status(spark, sf_dir):
    commits = load(spark, sf_dir, "orders").agg(F.count("*").alias("commits"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_commit"))
    parts = load(spark, sf_dir, "part").agg(F.count("*").alias("_all"), F.count_distinct("p_brand").alias("tags"))
    alive = links(spark, sf_dir).agg(F.count_distinct("l_partkey").alias("alive"))
    rows = commits.crossJoin(F.broadcast(parts)).crossJoin(F.broadcast(alive))  # one row each
    return rows.select("commits", "alive", (F.col("_all") - F.col("alive")).alias("dead"), "tags", "last_commit")


@query("tag_replay", "WITH o AS (SELECT user_id, event_type, arg_max(CASE WHEN value > 50 THEN 'add' ELSE 'remove' END, struct_pack(a := ts, b := event_id)) AS op FROM events GROUP BY ALL) SELECT user_id, event_type FROM o WHERE op = 'add'")
def tag_replay(spark, sf_dir):
    ops = load(spark, sf_dir, "events").withColumn("op", F.when(F.col("value") > 50, "add").otherwise("remove"))
    return index.replay(ops, ["user_id", "event_type"], "op", "ts", "event_id")


@query("liveness", "SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type FROM events GROUP BY 1")
def liveness(spark, sf_dir):
    return index.liveness(load(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id")


@query("artifact_page", "SELECT p_partkey, p_name FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) % 2 = 0) AND p_size > 3 ORDER BY p_name, p_partkey LIMIT 100 OFFSET 40")
def artifact_page(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    ignored = part.groupBy("p_brand").agg(F.count("*").alias("n")).filter("n % 2 = 0").select("p_brand")
    return index.page(part.filter("p_size > 3"), ignored, "p_brand", 40, 100, F.col("p_name"), F.col("p_partkey")).select("p_partkey", "p_name")


@query(
    "incremental_equals_batch",
    "SELECT user_id AS item, count(*) AS n, round(sum(value), 4) AS weight FROM events GROUP BY 1",
)
def incremental_equals_batch(spark, sf_dir):
    events = load(spark, sf_dir, "events").select(F.col("user_id").alias("a"), F.col("user_id").alias("b"), "event_id", "value")
    part = lambda odd: events.filter(F.col("event_id") % 2 == odd).groupBy("a", "b").agg(F.sum("value").alias("weight"), F.count("*").alias("n"))
    return cochange.merge_edges(part(0), part(1)).select(F.col("a").alias("item"), "n", F.round("weight", 4).alias("weight"))
