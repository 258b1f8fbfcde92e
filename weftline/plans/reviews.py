"""Review queries.  A finding is an event with a minute interval; its rule is the type, its file the user."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.operators import findings, freshness
from weftline.sources.tables import load

SEVERITY = "CASE WHEN value >= 90 THEN 'critical' WHEN value >= 60 THEN 'high' WHEN value >= 30 THEN 'medium' WHEN value >= 10 THEN 'low' ELSE 'informational' END"
SPANS = "f AS (SELECT event_id, event_type, user_id, floor(epoch_us(ts) / 60000000)::BIGINT AS s, floor(epoch_us(ts) / 60000000)::BIGINT + event_id % 30 AS e FROM events)"


def spans(spark, sf_dir):
    minute = F.floor(F.unix_timestamp("ts") / 60).cast("long")
    return load(spark, sf_dir, "events").select("event_id", "event_type", "user_id", minute.alias("s"), (minute + F.col("event_id") % 30).alias("e"))


@query("overlap_pairs", f"WITH {SPANS} SELECT x.event_type, x.user_id, x.event_id AS left_id, y.event_id AS right_id FROM f x JOIN f y ON x.event_type = y.event_type AND x.user_id = y.user_id AND x.event_id < y.event_id AND x.s <= y.e AND y.s <= x.e")
def overlap_pairs(spark, sf_dir):
    return findings.overlap_pairs(spans(spark, sf_dir), ["event_type", "user_id"], "s", "e", "event_id", width=60)


@query(
    "overlap_groups",
    f"WITH {SPANS}, m AS (SELECT *, max(e) OVER (PARTITION BY event_type, user_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM f) SELECT event_type, count(*) AS rows_, count(*) FILTER (r IS NULL OR r < s) AS groups_ FROM m GROUP BY 1",
)
def overlap_groups(spark, sf_dir):
    rows = findings.overlap_groups(spans(spark, sf_dir), ["event_type", "user_id"], "s", "e")
    per = rows.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.max("grp").alias("g"))
    return per.groupBy("event_type").agg(F.sum("n").alias("rows_"), F.sum("g").alias("groups_"))


def severe(spark, sf_dir):
    v = F.col("value")
    s = F.when(v >= 90, "critical").when(v >= 60, "high").when(v >= 30, "medium").when(v >= 10, "low").otherwise("informational")
    return load(spark, sf_dir, "events").withColumn("severity", s)


@query("severity_summary", f"WITH f AS (SELECT event_type, {SEVERITY} AS s FROM events) SELECT event_type, count(*) FILTER (s = 'critical') AS critical, count(*) FILTER (s = 'high') AS high, count(*) FILTER (s = 'medium') AS medium, count(*) FILTER (s = 'low') AS low, count(*) FILTER (s = 'informational') AS informational, count(*) AS total FROM f GROUP BY 1")
def severity_summary(spark, sf_dir):
    return findings.severity_summary(severe(spark, sf_dir), "event_type")


@query(
    "suppressed",
    "SELECT event_id, CASE WHEN event_type = 'error' AND user_id::VARCHAR = '7' THEN 'known user' WHEN event_type = 'view' AND regexp_matches(user_id::VARCHAR, '^1[0-9]*$') THEN 'generated' WHEN event_type = 'click' AND EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id) THEN 'bought' END AS reason FROM events e",
)
def suppressed(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("rule_id"), F.col("user_id").cast("string").alias("file"), F.lit(1).alias("start_line"))
    rules = [{"rule": "error", "file": "7", "reason": "known user"}, {"rule": "view", "glob": "1*", "reason": "generated"}]
    notes = rows.filter("rule_id = 'purchase'").select(F.lit("click").alias("rule"), "file", F.lit(1).alias("line"), F.lit("bought").alias("reason"))
    return findings.suppressed(rows, rules, notes).select("event_id", "reason")


@query("coverage", "WITH p AS (SELECT n_nationkey AS component, t.event_type AS rule FROM nation, (SELECT DISTINCT event_type FROM events) t), d AS (SELECT DISTINCT (user_id % 31)::INTEGER AS component, event_type AS rule FROM events WHERE value > 97) SELECT component, rule, EXISTS (SELECT 1 FROM d WHERE d.component = p.component AND d.rule = p.rule) AS checked FROM p")
def coverage(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    rules = events.select(F.col("event_type").alias("rule")).distinct()
    nation = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("component"))
    pairs = rules.crossJoin(F.broadcast(nation))  # the grid asked for: event types times 25 nations
    done = events.filter("value > 97").select((F.col("user_id") % 31).cast("int").alias("component"), F.col("event_type").alias("rule"))
    return findings.coverage(pairs, done, "component", "rule")


@query("weighted_score", "SELECT source, round(coalesce(sum(quality * (1 + toxic)) / nullif(sum(1 + toxic), 0), 0), 9)::DOUBLE AS score FROM documents JOIN labels USING (doc_id) GROUP BY source")
def weighted_score(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", "source").join(load(spark, sf_dir, "labels"), "doc_id").withColumn("w", F.col("toxic") + 1)
    return findings.weighted_score(rows, "quality", "w", "source").withColumn("score", F.round("score", 9))


FRESH = "n AS (SELECT user_id, max((epoch_us(ts) // 1000)) FILTER (event_type = 'click') AS source_ms, max((epoch_us(ts) // 1000)) FILTER (event_type = 'view') AS doc_ms, max((epoch_us(ts) // 1000)) FILTER (event_type = 'purchase') AS ack_ms FROM events GROUP BY 1)"


def fresh(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("component"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    docs = events.groupBy("component").agg(F.max(F.when(F.col("event_type") == "view", F.col("ms"))).alias("doc_ms")).withColumn("doc", F.col("component"))
    acks = events.filter("event_type = 'purchase'").select(F.col("component").alias("doc"), "ms")
    return freshness.report(events.filter("event_type = 'click'").select("component", "ms"), docs, acks)


@query("freshness", f"WITH {FRESH} SELECT user_id AS component, source_ms, doc_ms, ack_ms, source_ms IS NULL OR greatest(doc_ms, ack_ms) IS NULL OR source_ms - greatest(doc_ms, ack_ms) > 5000 AS stale FROM n")
def freshness_(spark, sf_dir):
    return fresh(spark, sf_dir).select("component", "source_ms", "doc_ms", "ack_ms", "stale")


@query("since_filter", f"WITH {FRESH} SELECT user_id AS component FROM n WHERE source_ms > 1706400000000 OR doc_ms > 1706400000000")
def since_filter(spark, sf_dir):
    return freshness.changed_since(fresh(spark, sf_dir), 1_706_400_000_000).select("component")


@query("warm_gate", "SELECT user_id AS component, max((epoch_us(ts) // 1000)) > 1706600000000 AS changed FROM events GROUP BY 1")
def warm_gate(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("component"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return freshness.warm(rows, 1_706_600_000_000)


RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"


@query(
    "dedup_findings",
    f"""WITH RECURSIVE {SPANS}, r AS (SELECT f.event_type || '-' || f.user_id AS rule_id, (event_id % 5)::VARCHAR AS task, {SEVERITY} AS severity, f.event_type AS title, value / 100 AS conf, s, e,
row_number() OVER (PARTITION BY f.event_type, f.user_id ORDER BY (event_id % 5)::VARCHAR, event_id) AS k FROM f JOIN events USING (event_id)),
w(rule_id, k, members) AS (SELECT rule_id, k, [struct_pack(g := 1, s := s, e := e)] FROM r WHERE k = 1 UNION ALL
SELECT r.rule_id, r.k, list_append(w.members, struct_pack(g := coalesce(list_min(list_transform(list_filter(w.members, lambda m: m.s <= r.e AND r.s <= m.e), lambda m: m.g)), 1 + list_max(list_transform(w.members, lambda m: m.g))), s := r.s, e := r.e)) FROM w JOIN r ON r.rule_id = w.rule_id AND r.k = w.k + 1),
g AS (SELECT r.*, w.members[r.k].g AS g, {RANK} AS worst FROM w JOIN r USING (rule_id, k))
SELECT rule_id, arg_min(severity, struct_pack(a := worst, b := -conf, c := k)) AS severity, any_value(title) AS title, count(DISTINCT task) AS tasks, least(1.0, arg_min(conf, struct_pack(a := worst, b := -conf, c := k)) + 0.1 * (count(DISTINCT task) - 1)) AS confidence, count(*) AS members FROM g GROUP BY rule_id, g""",
)
def dedup_findings(spark, sf_dir):
    rows = severe(spark, sf_dir).join(spans(spark, sf_dir).select("event_id", "s", "e"), "event_id")
    location = F.struct(F.col("user_id").cast("string").alias("file"), F.col("s").cast("int").alias("start_line"), F.col("e").cast("int").alias("end_line"))
    rows = rows.select(F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("rule_id"), (F.col("event_id") % 5).cast("string").alias("task_id"), F.col("event_id").alias("ord"), "severity", F.col("event_type").alias("title"), (F.col("value") / 100).alias("confidence"), F.array(location).alias("locations"))
    return findings.deduplicate(rows)


@query(
    "finding_drift",
    f"""WITH RECURSIVE {SPANS}, r AS (SELECT f.event_type AS rule_id, f.user_id::VARCHAR AS file, event_id, {SEVERITY} AS severity, s, e FROM f JOIN events USING (event_id)),
b AS (SELECT rule_id, file, list(struct_pack(o := event_id, s := s, e := e, v := severity) ORDER BY event_id) AS old FROM r WHERE event_id % 2 = 0 GROUP BY ALL),
c AS (SELECT r.*, coalesce(old, []) AS old, row_number() OVER (PARTITION BY rule_id, file ORDER BY event_id) AS k FROM r LEFT JOIN b USING (rule_id, file) WHERE event_id % 2 = 1),
w(rule_id, file, k, severity, used, hit) AS (SELECT DISTINCT rule_id, file, 0::BIGINT, NULL::VARCHAR, []::BIGINT[], NULL::STRUCT(o BIGINT, s BIGINT, e BIGINT, v VARCHAR) FROM c UNION ALL
SELECT rule_id, file, k, severity, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit.o) END, hit FROM (SELECT c.rule_id, c.file, c.k, c.severity, w.used, list_filter(c.old, lambda x: x.s <= c.e AND c.s <= x.e AND NOT list_contains(w.used, x.o))[1] AS hit FROM w JOIN c ON c.rule_id = w.rule_id AND c.file = w.file AND c.k = w.k + 1))
SELECT rule_id, file, CASE WHEN hit IS NULL THEN 'new' WHEN hit.v = severity THEN 'stable' ELSE 'changed' END AS status, hit.v AS before, severity AS after, CASE WHEN hit IS NULL OR hit.v = severity THEN '' ELSE 'severity:' || hit.v || '>' || severity END AS changes FROM w WHERE k > 0
UNION ALL SELECT rule_id, file, 'resolved', severity, NULL, '' FROM r WHERE event_id % 2 = 0 AND event_id NOT IN (SELECT hit.o FROM w WHERE hit IS NOT NULL)""",
)
def finding_drift(spark, sf_dir):
    rows = severe(spark, sf_dir).join(spans(spark, sf_dir).select("event_id", "s", "e"), "event_id")
    rows = rows.select(F.col("event_type").alias("rule_id"), F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("ord"), F.col("s").alias("start_line"), F.col("e").alias("end_line"), "severity", F.lit(0.5).alias("confidence"))
    found = findings.drift(rows.filter("ord % 2 = 0"), rows.filter("ord % 2 = 1"))
    return found.withColumn("changes", F.array_join(F.transform("changes", lambda c: F.concat(c["field"], F.lit(":"), c["old"], F.lit(">"), c["new"])), ","))
