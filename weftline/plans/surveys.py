"""Queries over trees of paths, logs and source texts.  Paths, logs and texts are spelled out from keys of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.functions import code, paths, text
from weftline.operators import audit, cochange, findings, graph, links, schedule, suggest
from weftline.sources import commits, store, symbols
from weftline.sources.tables import load

TOP = ("packages", "src", "shop", "controllers", "services", "apps", "billing")
SUB = ("core", "src", "models", "api", "routes")
END = (".controller.ts", ".service.ts", ".rs", ".py", ".d.ts", ".tsx", ".md", ".go")


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


FILES = f"files AS (SELECT p_partkey AS id, {sql_list(TOP)}[p_partkey % {len(TOP)} + 1] || '/' || {sql_list(SUB)}[p_partkey % {len(SUB)} + 1] || '/f' || p_partkey % 13 || {sql_list(END)}[p_partkey % {len(END)} + 1] AS file FROM part)"


def files(spark, sf_dir):
    k = F.col("p_partkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    return load(spark, sf_dir, "part").select(k.alias("id"), F.concat(pick(TOP), F.lit("/"), pick(SUB), F.lit("/f"), (k % 13).cast("string"), pick(END)).alias("file"))


@query("glob_filter", f"WITH {FILES} SELECT id, file FROM files WHERE regexp_matches(file, '^packages/.*[^/]*\\.ts$') OR regexp_matches(file, '^(.*/)?f[^/]\\.rs$')")
def glob_filter(spark, sf_dir):
    return files(spark, sf_dir).filter(paths.matches_any(F.col("file"), ["packages/**/*.ts", "**/f?.rs"]))


@query("excluded_paths", f"WITH {FILES}, g AS (SELECT id % 50 AS sha, count(*) FILTER (NOT file LIKE '%.d.ts') AS n FROM files GROUP BY 1) SELECT sha, n FROM g")
def excluded_paths(spark, sf_dir):
    grouped = files(spark, sf_dir).groupBy((F.col("id") % 50).alias("sha")).agg(F.collect_list("file").alias("files"))
    return cochange.filter_paths(grouped).select("sha", F.size("files").cast("long").alias("n"))


@query(
    "path_facts",
    f"""WITH {FILES} SELECT id, CASE WHEN file LIKE '%.ts' OR file LIKE '%.tsx' THEN 'typescript' WHEN file LIKE '%.rs' THEN 'rust' WHEN file LIKE '%.py' THEN 'python' WHEN file LIKE '%.go' THEN 'go' ELSE 'unknown' END AS language,
CASE WHEN file LIKE '%.ts' OR file LIKE '%.tsx' THEN regexp_replace(regexp_replace(string_split(file, '/')[-1], '\\.[a-z]+$', ''), '\\.(controller|service)$', '') END AS stem, regexp_replace(file, '/[^/]*$', '') AS dir, string_split(file, '/')[1] || '/' || string_split(file, '/')[2] AS component, 'f' || id AS bare FROM files""",
)
def path_facts(spark, sf_dir):
    f = F.col("file")
    return files(spark, sf_dir).select("id", paths.language(f).alias("language"), paths.stem(f).alias("stem"), paths.dirname(f).alias("dir"), paths.component_key(f).alias("component"), paths.unscoped(F.concat(F.lit("@x/f"), F.col("id").cast("string"))).alias("bare"))


@query("container_dirs", f"WITH {FILES} SELECT DISTINCT string_split(file, '/')[2] AS name, string_split(file, '/')[1] || '/' || string_split(file, '/')[2] AS path FROM files WHERE string_split(file, '/')[1] IN ('packages', 'apps')")
def container_dirs(spark, sf_dir):
    return suggest.containers(files(spark, sf_dir)).select("name", F.col("paths")[0].alias("path"))


@query("indicator_dirs", f"WITH {FILES} SELECT DISTINCT string_split(file, '/')[1] AS name, string_split(file, '/')[1] AS path FROM files WHERE string_split(file, '/')[2] = 'src'")
def indicator_dirs(spark, sf_dir):
    return suggest.indicated(files(spark, sf_dir)).select("name", F.col("paths")[0].alias("path"))


@query("layer_dirs", f"WITH {FILES} SELECT DISTINCT string_split(file, '/')[1] AS layer FROM files WHERE string_split(file, '/')[1] IN ('controllers', 'services')")
def layer_dirs(spark, sf_dir):
    return suggest.layer_dirs(files(spark, sf_dir))


STEM = "regexp_replace(regexp_replace(string_split(file, '/')[-1], '\\.[a-z]+$', ''), '\\.(controller|service)$', '')"


@query("stem_clusters", f"WITH {FILES}, s AS (SELECT DISTINCT string_split(file, '/')[1] AS layer, {STEM} AS name FROM files WHERE string_split(file, '/')[1] IN ('controllers', 'services') AND (file LIKE '%.ts' OR file LIKE '%.tsx')) SELECT name, string_agg(layer, ',' ORDER BY layer) AS paths FROM s GROUP BY name HAVING count(*) >= 2")
def stem_clusters(spark, sf_dir):
    return suggest.stem_clusters(files(spark, sf_dir)).select("name", F.array_join("paths", ",").alias("paths"))


@query("domain_dirs", f"WITH {FILES}, s AS (SELECT DISTINCT string_split(file, '/')[1] AS name, string_split(file, '/')[2] AS sub FROM files WHERE string_split(file, '/')[2] IN ('models', 'api', 'routes')) SELECT name, string_agg(name || '/' || sub, ',' ORDER BY sub) AS paths FROM s GROUP BY name HAVING count(*) >= 2")
def domain_dirs(spark, sf_dir):
    return suggest.domains(files(spark, sf_dir)).select("name", F.array_join("paths", ",").alias("paths"))


@query("first_wins", "WITH r AS (SELECT p_brand AS name, p_partkey % 3 AS priority, p_partkey FROM part), k AS (SELECT name, min(priority) AS priority FROM r GROUP BY name) SELECT name, priority FROM k")
def first_wins(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.array(F.col("p_partkey").cast("string")).alias("paths"), (F.col("p_partkey") % 3).alias("priority"))
    return suggest.first_wins(rows.filter("priority = 0"), rows.filter("priority > 0")).select("name", "priority")


# Commits: an order's log record names its lines' parts as paths; every fifth part is deleted.


def log(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    entry = F.concat(F.when(F.col("l_partkey") % 5 == 0, "D\t").otherwise("M\t"), F.lit("p"), F.col("l_partkey").cast("string"))
    held = line.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(entry)), "\n").alias("entries"))
    rows = load(spark, sf_dir, "orders").join(held, F.col("o_orderkey") == F.col("l_orderkey"))
    head = F.concat_ws("\n", F.col("o_orderkey").cast("string"), F.concat(F.lit("a"), F.col("o_custkey").cast("string")), F.unix_timestamp("o_orderdate").cast("string"), F.concat(F.lit("feat: "), "o_orderpriority"))
    return rows.select(F.concat(head, F.lit("\n"), F.lit(commits.FILES_MARK), F.lit("\n"), "entries").alias("value"))


@query("commit_records", "WITH l AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS p FROM lineitem), c AS (SELECT k, count(*) FILTER (p % 5 <> 0) AS files, count(*) FILTER (p % 5 = 0) AS gone FROM l GROUP BY k) SELECT o_orderkey::VARCHAR AS sha, 'a' || o_custkey AS author, epoch(o_orderdate)::BIGINT AS timestamp, 'feat: ' || o_orderpriority AS subject, files, gone FROM orders JOIN c ON k = o_orderkey")
def commit_records(spark, sf_dir):
    return commits.parse_records(log(spark, sf_dir)).select("sha", "author", "timestamp", "subject", F.size("files").cast("long").alias("files"), F.size("deleted_files").cast("long").alias("gone"))


@query("path_liveness", "WITH l AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS p FROM lineitem) SELECT 'p' || p AS path, p % 5 <> 0 AS alive, count(*) AS commits FROM l GROUP BY p")
def path_liveness(spark, sf_dir):
    rows = commits.changes(commits.parse_records(log(spark, sf_dir)))
    return rows.groupBy("path").agg(F.max_by("alive", F.struct("timestamp", "sha", "seq")).alias("alive"), F.count("*").alias("commits"))


@query("commits_since", "SELECT count(*) AS n, min(o_orderkey)::VARCHAR AS first FROM orders WHERE epoch(o_orderdate) > 820454400 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def commits_since(spark, sf_dir):
    rows = commits.since(commits.parse_records(log(spark, sf_dir)), 820_454_400)
    return rows.agg(F.count("*").alias("n"), F.min(F.col("sha").cast("long")).cast("string").alias("first"))


@query("changed_files", "SELECT DISTINCT 'p' || l_partkey AS file FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE epoch(o_orderdate) > 820454400 AND l_partkey % 5 <> 0")
def changed_files(spark, sf_dir):
    return commits.changed_files(commits.parse_records(log(spark, sf_dir)), 820_454_400)


@query("bounded_history", "SELECT o_orderkey::VARCHAR AS sha FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (1, 2, 3)) ORDER BY epoch(o_orderdate)::BIGINT DESC, o_orderkey::VARCHAR LIMIT 40")
def bounded_history(spark, sf_dir):
    return commits.bounded_history(commits.parse_records(log(spark, sf_dir)), ["p1", "p2", "p3"], 40).select("sha")


@query("numstat", "SELECT l_partkey AS file, sum(l_quantity)::BIGINT AS additions, sum(l_linenumber)::BIGINT AS deletions FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1")
def numstat(spark, sf_dir):
    sha = F.lpad(F.hex("l_orderkey"), 40, "0")
    count = F.when(F.col("l_linenumber") == 3, "-").otherwise(F.col("l_quantity").cast("int").cast("string"))
    value = F.concat(F.lower(sha), F.lit("\n"), F.concat_ws("\t", count, F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")))
    rows = commits.parse_numstat(load(spark, sf_dir, "lineitem").select(value.alias("value")))
    return rows.groupBy(F.col("file").cast("long").alias("file")).agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))


# Components: a nation with its suppliers' tags; links lead from customers' to suppliers' nations.

COMPONENTS = "comp AS (SELECT n_nationkey AS k, 'c' || n_nationkey AS name, 't' || n_nationkey % 7 AS t1, 'u' || n_nationkey % 4 AS t2, 'ENV' || n_nationkey % 5 AS env, 'test ' || n_nationkey % 3 AS test FROM nation)"


def components(spark, sf_dir):
    k = F.col("n_nationkey")
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    return load(spark, sf_dir, "nation").select(name("c", k).alias("name"), F.array(name("t", k % 7), name("u", k % 4)).alias("tags"), F.array(name("ENV", k % 5)).alias("env"), name("test ", k % 3).alias("test"), F.array(name("src/c", k)).alias("path"))


@query("tag_groups", f"WITH {COMPONENTS}, t AS (SELECT name, t1 AS tag FROM comp UNION SELECT name, t2 FROM comp) SELECT tag, string_agg(name, ',' ORDER BY name) AS components FROM t GROUP BY tag")
def tag_groups(spark, sf_dir):
    return audit.tag_groups(components(spark, sf_dir)).select("tag", F.array_join("components", ",").alias("components"))


@query("tag_index", f"WITH {COMPONENTS}, t AS (SELECT t1 AS tag FROM comp UNION SELECT t2 FROM comp) SELECT tag, (row_number() OVER (ORDER BY tag) - 1)::INTEGER AS index FROM t")
def tag_index(spark, sf_dir):
    return audit.tag_index(components(spark, sf_dir))


@query("environment", f"WITH {COMPONENTS} SELECT DISTINCT env AS name, env IN ('ENV1', 'ENV3') AS set FROM comp")
def environment(spark, sf_dir):
    return audit.environment(components(spark, sf_dir), ["ENV1", "ENV3"])


@query("scoped_tests", f"WITH {COMPONENTS} SELECT test AS command, string_agg(DISTINCT env, ',' ORDER BY env) AS env FROM comp WHERE t1 IN ('t1', 't2') GROUP BY test")
def scoped_tests(spark, sf_dir):
    names = [f"c{i}" for i in range(25)]
    return audit.scoped_tests(components(spark, sf_dir), names, ["t1", "t2"]).select("command", F.array_join("env", ",").alias("env"))


@query("component_rules", f"WITH {COMPONENTS}, r(id, w) AS (VALUES ('R1', 't3 flows'), ('R2', 'u'), ('R3', 'zzz')), t AS (SELECT name, t1 AS t FROM comp UNION SELECT name, t2 FROM comp) SELECT DISTINCT name AS component, id AS rule_id FROM t JOIN r ON contains(w, t) OR contains(t, w) UNION SELECT name, 'R4' FROM comp")
def component_rules(spark, sf_dir):
    rules = spark.createDataFrame([("R1", ["t3 flows"]), ("R2", ["u"]), ("R3", ["zzz"]), ("R4", [])], "id string, applies_to array<string>")
    return findings.rules_for_components(components(spark, sf_dir), rules)


@query("file_rules", f"WITH {FILES} SELECT id, 'R1' AS rule_id FROM files WHERE regexp_matches(file, '(?i)route|handler|middleware|server|handlers|http') UNION ALL SELECT id, 'R2' FROM files")
def file_rules(spark, sf_dir):
    rows = files(spark, sf_dir)
    rules = [{"id": "R1", "applies_to": ["HTTP handlers"]}, {"id": "R2", "applies_to": []}, {"id": "R3", "applies_to": ["zzz"]}]
    return audit.rules_for_files(rows.select(F.concat_ws(":", "id", "file").alias("file")), rules).select(F.split("file", ":")[0].cast("long").alias("id"), "rule_id")


AUDITED = [{"id": "A-1", "category": "api", "severity": "High", "applies_to": ["API routes"]}, {"id": "A-2", "category": "api", "severity": "low", "applies_to": []}, {"id": "D-1", "category": "data", "severity": "critical", "applies_to": ["database models"]}]


@query(
    "audit_plan",
    f"""WITH {FILES}, d AS (SELECT file, max(id) AS tokens FROM files GROUP BY file), r AS (SELECT file, tokens, 'A-1' AS rule, 'api' AS category, 1 AS p FROM d WHERE regexp_matches(file, '(?i){audit.rule_patterns(AUDITED)["A-1"].removeprefix("(?i)")}')
UNION ALL SELECT file, tokens, 'A-2', 'api', 3 FROM d UNION ALL SELECT file, tokens, 'D-1', 'data', 0 FROM d WHERE regexp_matches(file, '(?i){audit.rule_patterns(AUDITED)["D-1"].removeprefix("(?i)")}')),
f AS (SELECT file, category, any_value(tokens) AS tokens, string_agg(rule, ',' ORDER BY rule) AS rules, min(p) AS p FROM r GROUP BY ALL)
SELECT string_split(file, '/')[1] || '/' || string_split(file, '/')[2] AS component, category, array_to_string(list_sort(list_distinct(flatten(list(string_split(rules, ','))))), ',') AS rules, count(*) AS files, sum(tokens)::BIGINT AS tokens, min(p) AS priority FROM f GROUP BY ALL""",
)
def audit_plan(spark, sf_dir):
    rows = files(spark, sf_dir).select("file", F.col("id").alias("tokens"))
    return audit.audit_tasks(rows, AUDITED).withColumn("rules", F.array_join("rules", ","))


@query("link_evidence", "WITH e AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b, o_orderkey AS o FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey) SELECT 'c' || a AS src, 'c' || b AS dst, count(*) AS n, md5(string_agg('src/c' || a || '/x.ts:' || o, ',' ORDER BY o::VARCHAR)) AS evidence FROM e GROUP BY a, b")
def link_evidence(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    rows = line.join(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.join(load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey")).join(load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    path = lambda c: F.concat(F.lit("src/c"), F.col(c).cast("string"), F.lit("/x.ts"))
    rows = rows.select(path("c_nationkey").alias("file"), path("s_nationkey").alias("to"), F.col("o_orderkey").cast("string").alias("specifier")).distinct()
    found = links.evidence(links.inferred(rows, components(spark, sf_dir), "file", "to", "specifier"))
    shown = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["file"], e["specifier"])), ",")
    return found.select("src", "dst", "n", F.md5(shown).alias("evidence"))


@query("broken_links", "WITH l AS (SELECT p_partkey AS k, 'docs/f' || (p_partkey * 7) % 3000 || '.md' AS resolved FROM part) SELECT k, resolved FROM l WHERE resolved NOT IN (SELECT 'docs/f' || p_partkey || '.md' FROM part)")
def broken_links(spark, sf_dir):
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    body = F.concat(F.lit("see [x](./f"), ((F.col("k") * 7) % 3000).cast("string"), F.lit(".md#top) and [y](https://z.org)"))
    found = links.resolved_links(part.select(F.concat(F.lit("docs/d"), F.col("k").cast("string"), F.lit(".md")).alias("doc"), body.alias("content")))
    there = part.select(F.concat(F.lit("docs/f"), F.col("k").cast("string"), F.lit(".md")).alias("file"))
    return links.broken_links(found, there).select(F.regexp_extract("doc", r"d(\d+)\.md$", 1).cast("long").alias("k"), "resolved")


# Modules: a part imports the part that a rule of its key names; every third one only re-exports.

IMPORTS = "imp AS (SELECT p_partkey AS path, p_partkey * 3 % 50 + 1 AS resolved_path, 'n' || p_partkey % 4 AS imported_name, p_partkey % 3 = 0 AS is_re_export FROM part)"


def module_imports(spark, sf_dir):
    k = F.col("p_partkey")
    return load(spark, sf_dir, "part").select(k.cast("string").alias("path"), (k * 3 % 50 + 1).cast("string").alias("resolved_path"), F.concat(F.lit("n"), (k % 4).cast("string")).alias("imported_name"), (k % 3 == 0).alias("is_re_export"))


@query(
    "importers",
    f"WITH RECURSIVE {IMPORTS}, b(node) AS (SELECT 7 UNION SELECT path FROM b JOIN imp ON resolved_path = node WHERE is_re_export), d AS (SELECT DISTINCT path FROM imp WHERE resolved_path = 7), s AS (SELECT DISTINCT path FROM imp WHERE NOT is_re_export AND resolved_path IN (SELECT node FROM b WHERE node <> 7)) SELECT coalesce(d.path, s.path)::VARCHAR AS path, d.path IS NOT NULL AS direct, s.path IS NOT NULL AS barrel FROM d FULL JOIN s ON d.path = s.path",
)
def importers(spark, sf_dir):
    return graph.importers(module_imports(spark, sf_dir), "7")


@query("unused_exports", f"WITH {IMPORTS}, e AS (SELECT DISTINCT p_partkey AS path, 'n' || p_partkey % 5 AS exported_name FROM part WHERE p_partkey % 3 <> 0) SELECT path::VARCHAR AS path, exported_name FROM e WHERE NOT EXISTS (SELECT 1 FROM imp WHERE resolved_path = e.path AND imported_name = e.exported_name)")
def unused_exports(spark, sf_dir):
    k = F.col("p_partkey")
    exported = load(spark, sf_dir, "part").select(k.cast("string").alias("path"), F.concat(F.lit("n"), (k % 5).cast("string")).alias("exported_name"), (k % 3 == 0).alias("is_barrel"))
    return graph.unused_exports(exported, module_imports(spark, sf_dir))


@query("barrel_expansion", f"WITH {IMPORTS}, b AS (SELECT DISTINCT path AS p, resolved_path AS to_ FROM imp WHERE is_re_export), x AS (SELECT path, resolved_path, imported_name FROM imp) SELECT DISTINCT path::VARCHAR AS file, coalesce(to_, resolved_path)::VARCHAR AS resolved_path FROM x LEFT JOIN b ON resolved_path = p")
def barrel_expansion(spark, sf_dir):
    rows = module_imports(spark, sf_dir)
    barrels = rows.filter("is_re_export").select("path", "resolved_path")
    return links.through_barrels(rows.select(F.col("path").alias("file"), "resolved_path", F.lit("x").alias("specifier")), barrels).select("file", "resolved_path").distinct()


@query("scope_violations", f"WITH {FILES}, o AS (SELECT file, string_split(file, '/')[1] AS component FROM files WHERE string_split(file, '/')[1] <> 'apps') SELECT DISTINCT f.file, component FROM files f LEFT JOIN o ON f.file = o.file WHERE component IS NULL OR component NOT IN ('src', 'shop')")
def scope_violations(spark, sf_dir):
    rows = files(spark, sf_dir).select("file").distinct()
    owned = rows.select("file", F.split("file", "/")[0].alias("component")).filter("component <> 'apps'")
    return schedule.scope_violations(rows, owned, ["src", "shop"])


@query("suggested_touches", "WITH w AS (SELECT DISTINCT s_nationkey AS c FROM supplier WHERE s_suppkey % 9 = 0), r AS (SELECT DISTINCT (c * 7 + 3) % 25 AS c FROM w) SELECT c AS component, 'w' AS mode FROM w UNION ALL SELECT c, 'r' FROM r WHERE c NOT IN (SELECT c FROM w)")
def suggested_touches(spark, sf_dir):
    owned = load(spark, sf_dir, "supplier").filter("s_suppkey % 9 = 0").select(F.col("s_nationkey").alias("component"))
    deps = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("dst"))
    return schedule.suggested_touches(owned, deps)


@query("restart_strategy", "WITH t AS (SELECT s_suppkey AS id, 'c' || s_suppkey % 12 AS w, 'c' || (s_suppkey * 5 + 1) % 12 AS r, 'n' || s_nationkey AS m, CASE WHEN s_suppkey % 2 = 0 THEN 'completed' ELSE 'pending' END AS state FROM supplier), x AS (SELECT * FROM t WHERE id = 4), a AS (SELECT t.id FROM t, x WHERE t.id <> 4 AND t.state = 'completed' AND (t.r = x.w OR t.m = x.m)) SELECT CASE WHEN count(*) = 0 THEN 'isolated_retry' ELSE 'escalate' END AS strategy, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id), '') AS affected FROM a")
def restart_strategy(spark, sf_dir):
    k, name = F.col("s_suppkey"), lambda prefix, c: F.array(F.concat(F.lit(prefix), c.cast("string")))
    tasks = load(spark, sf_dir, "supplier").select(k.alias("id"), name("c", k % 12).alias("writes"), name("c", (k * 5 + 1) % 12).alias("reads"), name("n", F.col("s_nationkey")).alias("mutexes"), F.when(k % 2 == 0, "completed").otherwise("pending").alias("state"))
    return schedule.restart_strategy(tasks, 4).select("strategy", F.array_join(F.col("affected").cast("array<string>"), ",").alias("affected"))


@query("visible_docs", "WITH t AS (SELECT s_suppkey AS k, s_nationkey AS c, CASE WHEN s_suppkey % 2 = 0 THEN 'w' ELSE 'r' END AS mode FROM supplier), d AS (SELECT n_nationkey AS c, 'n' || n_nationkey || '/README.md' AS doc FROM nation UNION ALL SELECT n_nationkey, 'n' || n_nationkey || '/docs/a.md' FROM nation) SELECT DISTINCT d.c AS component, doc FROM t JOIN d ON t.c = d.c WHERE doc LIKE '%README.md' OR mode = 'w'")
def visible_docs(spark, sf_dir):
    touched = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("component"), F.when(F.col("s_suppkey") % 2 == 0, "w").otherwise("r").alias("mode"))
    prefix = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    docs = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("component"), F.explode(F.array(F.concat(prefix, F.lit("/README.md")), F.concat(prefix, F.lit("/docs/a.md")))).alias("doc"))
    return links.visible_docs(touched, docs)


# Texts as source code.


@query("offsets", "SELECT doc_id, length(string_split(text, chr(10))[1]) + 1 + 3 AS at, 1 + length(left(text, 100)) - length(replace(left(text, 100), chr(10), '')) AS line FROM documents WHERE text IS NOT NULL")
def offsets(spark, sf_dir):
    t = F.col("text")
    return load(spark, sf_dir, "documents").filter("text is not null").select("doc_id", code.offset_of(t, F.lit(1), F.lit(3)).cast("long").alias("at"), code.line_of(t, F.lit(100)).cast("long").alias("line"))


@query(
    "type_names",
    r"""WITH t AS (SELECT p_partkey AS doc_id, 'let x: T' || p_partkey || '<U' || p_partkey % 7 || '> = new Map(); // Promise Error Widget' AS text FROM part),
n AS (SELECT doc_id, list_sort(list_filter(list_distinct(regexp_extract_all(text, '\b[A-Z][A-Za-z0-9_]*\b')), lambda x: x NOT IN ('Map', 'Promise', 'Error'))) AS names FROM t) SELECT doc_id, array_to_string(names, ',') AS names FROM n""",
)
def type_names(spark, sf_dir):
    k = F.col("p_partkey")
    body = F.concat(F.lit("import { type Map } from 'x';\nlet x: T"), k.cast("string"), F.lit("<U"), (k % 7).cast("string"), F.lit("> = new Map(); // Promise Error Widget"))
    rows = load(spark, sf_dir, "part").select(k.alias("doc_id"), body.alias("text"))
    return rows.select("doc_id", F.array_join(F.array_sort(code.type_references(F.col("text"), deep=True)), ",").alias("names"))


@query("editor_tokens", "WITH t AS (SELECT user_id AS file, event_id AS seq, (event_id % 3)::INTEGER AS dl, (event_id % 5 + 1)::INTEGER AS dc FROM events), l AS (SELECT *, sum(dl) OVER (PARTITION BY file ORDER BY seq) AS line FROM t) SELECT file, seq, line::BIGINT AS line, (sum(dc) OVER (PARTITION BY file, line ORDER BY seq))::BIGINT AS character FROM l")
def editor_tokens(spark, sf_dir):
    k = F.col("event_id")
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("file"), k.alias("seq"), (k % 3).alias("d_line"), (k % 5 + 1).alias("d_char"), F.lit(1).alias("length"), F.lit(0).alias("kind"))
    return code.editor_tokens(rows).select("file", "seq", "line", "character")


@query("durations", "SELECT event_id, CASE WHEN event_id < 1000 THEN event_id || 'ms' ELSE printf('%.1fs', event_id / 1000.0) END AS took, event_type || ':<time>:' || user_id AS key FROM events WHERE event_id % 100 <> 50")
def durations(spark, sf_dir):
    rows = load(spark, sf_dir, "events").filter("event_id % 100 <> 50")  # exact halves are rounded either way
    key = text.issue_key(F.col("event_type"), F.lit("2024-01-02T03:04:05.678Z"), F.col("user_id").cast("string"))
    return rows.select("event_id", text.duration(F.col("event_id")).alias("took"), key.alias("key"))


@query("bars", "WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), m AS (SELECT *, round(n::DOUBLE / (SELECT max(n) FROM n) * 10)::INTEGER AS f FROM n) SELECT user_id, repeat('█', f) || repeat('░', 10 - f) AS bar FROM m")
def bars(spark, sf_dir):
    n = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    rows = n.crossJoin(F.broadcast(n.agg(F.max("n").alias("most"))))  # one row
    return rows.select("user_id", code.bar(F.col("n"), F.col("most")).alias("bar"))


# Keyed tables: what is left after inserts, upserts and deletions.


@query("insert_absent", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def insert_absent(spark, sf_dir):
    events = load(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    odd = events.filter("event_id % 2 = 1")
    return store.inserted(odd, events, ["user_id"])


@query("upsert", "WITH o AS (SELECT c_custkey AS id, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS id, -c_acctbal AS v FROM customer WHERE c_custkey % 5 = 0) SELECT coalesce(n.id, o.id) AS id, coalesce(n.v, o.v) AS v FROM o FULL JOIN n ON o.id = n.id WHERE coalesce(n.id, o.id) % 7 <> 0")
def upsert(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    merged = store.upserted(c.filter("id % 3 <> 0"), c.filter("id % 5 = 0").withColumn("v", -F.col("v")), ["id"])
    return store.deleted(merged, c.filter("id % 7 = 0").select("id"), ["id"])


# Symbols of source texts with brackets in every kind of literal; their offsets follow from the lengths of the parts.

PIECES = (
    "/* { */ export function f#(a: {x: string}) { return \"}\" + '{' + /[/}]{2}\"/.source; }\n",
    "class A# { s = \"}\"; m#() { return `}${[1, `{${ {q: 1} }`]}`; } }\n",
    "const r# = 4 / 2 / 1; // }\n",
    "export const t# = (x) => {\n  return `a\n}`;\n};\n",
)
SYMBOL_ROWS = ((0, "f#", "function", True, None), (1, "A#", "class", False, None), (1, "s", "property", False, "A#"), (1, "m#", "method", False, "A#"), (2, "r#", "const", False, None), (3, "t#", "const", True, None))


def _spelled(text: str) -> str:
    return "replace('" + text.replace("'", "''") + "', '#', k)"


def _symbol_sql() -> str:
    before = lambda i: " + ".join(["0", *(f"length({_spelled(p)})" for p in PIECES[:i])])
    lines = lambda i: 1 + sum(p.count("\n") for p in PIECES[:i])
    rows = []
    for i, name, kind, _, parent in SYMBOL_ROWS:
        piece = PIECES[i]
        start = {"f#": "export", "A#": "class", "s": "s =", "m#": "m#(", "r#": "const", "t#": "export"}[name]
        end = {"f#": "; }\n", "A#": " }\n", "s": '";', "m#": "; }", "r#": ";", "t#": "};"}[name]
        to = piece.rindex(end) + (len(end) - end.endswith("\n"))
        up = lambda at: f"length({_spelled(piece[:at])})" if at else "0"  # noqa: E731, B023
        rows.append(f"SELECT k, {_spelled(name)} AS name, '{kind}' AS kind, {_spelled(parent) if parent else 'NULL'} AS parent, {lines(i)} AS line, ({before(i)} + {up(piece.index(start))})::INTEGER AS start, ({before(i)} + {up(to)})::INTEGER AS \"end\" FROM p")
    return "WITH p AS (SELECT p_partkey::VARCHAR AS k FROM part) " + " UNION ALL ".join(rows)


@query("source_symbols", _symbol_sql())
def source_symbols(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    content = F.concat(*[F.replace(F.lit(p), F.lit("#"), k) for p in PIECES])
    rows = load(spark, sf_dir, "part").select(F.concat(k, F.lit(".ts")).alias("file"), content.alias("content"))
    return symbols.nested_symbols(rows).select(F.split("file", "[.]")[0].alias("k"), "name", "kind", "parent", "line", "start", "end")
