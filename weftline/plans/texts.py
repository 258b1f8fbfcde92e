"""Text queries over documents, pages, conversations and the events' JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.functions import paths, text
from weftline.operators import budget, index
from weftline.sources import files, manifests
from weftline.sources.tables import load

#: Words of a query that matches as a whole.
TERMS = ["the", "and", "that"]


@query("fts_match", "WITH t AS (SELECT doc_id, source, list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM documents) SELECT doc_id, source FROM t WHERE list_has_all(w, ['the', 'and', 'that'])")
def fts_match(spark, sf_dir):
    return index.matching_text(load(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text", TERMS).select("doc_id", "source")


@query("line_counts", "SELECT doc_id, len(string_split(text, chr(10)))::INTEGER AS lines, length(text) AS chars, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
def line_counts(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.line_count(F.col("text")).alias("lines"), F.length("text").cast("long").alias("chars"), text.estimate_tokens(F.col("text")).alias("tokens"))


@query(
    "token_chunks",
    """WITH RECURSIVE f AS (SELECT source, doc_id, ceil(length(text) / 4.0)::BIGINT AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
w(source, k, doc_id, tokens, chunk, total, filled) AS (
SELECT source, k, doc_id, least(t, 3600), 0::BIGINT, CASE WHEN t > 3600 THEN 0 ELSE t END, CASE WHEN t > 3600 THEN 2 ELSE 1 END FROM f WHERE k = 1
UNION ALL SELECT f.source, f.k, f.doc_id, least(f.t, 3600), CASE WHEN w.filled = 2 OR f.t > 3600 OR w.total + f.t > 3600 THEN w.chunk + 1 ELSE w.chunk END,
CASE WHEN f.t > 3600 THEN 0 WHEN w.filled = 2 OR w.total + f.t > 3600 THEN f.t ELSE w.total + f.t END, CASE WHEN f.t > 3600 THEN 2 ELSE 1 END FROM w JOIN f ON f.source = w.source AND f.k = w.k + 1)
SELECT source, doc_id, tokens, chunk FROM w""",
)
def token_chunks(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("source", "doc_id", text.estimate_tokens(F.col("text")).alias("t"))
    return budget.token_chunks(docs, "source", ["doc_id"], "t", 4000)


@query(
    "budget_admission",
    """WITH RECURSIVE f AS (SELECT source, doc_id, ceil(length(text) / 4.0)::BIGINT AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
w(source, k, doc_id, tokens, admitted, rest) AS (SELECT source, k, doc_id, t, t <= 6000, CASE WHEN t <= 6000 THEN 6000 - t ELSE 6000 END FROM f WHERE k = 1
UNION ALL SELECT f.source, f.k, f.doc_id, f.t, f.t <= w.rest, CASE WHEN f.t <= w.rest THEN w.rest - f.t ELSE w.rest END FROM w JOIN f ON f.source = w.source AND f.k = w.k + 1)
SELECT source, doc_id, tokens, admitted FROM w""",
)
def budget_admission(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("source", "doc_id", text.estimate_tokens(F.col("text")).alias("t"))
    return budget.admitted(docs, "source", ["doc_id"], "t", 6000)


@query("link_extract", r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"#]+)"', 1)) AS target FROM pages) SELECT target, count(*) AS n, count(DISTINCT page_id) AS pages FROM l WHERE NOT regexp_matches(target, '^https?:') GROUP BY 1""")
def link_extract(spark, sf_dir):
    markdown = F.regexp_replace("html", r'href="([^"#]+)"', r"[link]($1)")
    links = load(spark, sf_dir, "pages").select("page_id", F.explode(text.markdown_links(markdown)).alias("l")).select("page_id", "l.target")
    return links.groupBy("target").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


@query("regex_lines", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), m AS (SELECT * FROM l WHERE regexp_matches(line, '[0-9]{4}') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n) <= 1000)
SELECT doc_id AS file, n::INTEGER AS n, line, (SELECT count(*) > 100 FROM m) AS truncated FROM m ORDER BY doc_id, n LIMIT 100""")
def regex_lines(spark, sf_dir):
    return files.search(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content")), "[0-9]{4}")


@query("role_transitions", "WITH r AS (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT coalesce(before, 'start') AS before, role, count(*) AS n FROM r GROUP BY 1, 2")
def role_transitions(spark, sf_dir):
    from pyspark.sql import Window

    rows = load(spark, sf_dir, "conversations").withColumn("before", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.groupBy(F.coalesce("before", F.lit("start")).alias("before"), "role").agg(F.count("*").alias("n"))


@query("language_group", "SELECT source, count(*) AS files, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages, sum(ceil(length(text) / 4.0))::BIGINT AS tokens FROM documents GROUP BY source")
def language_group(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("source", "lang", text.estimate_tokens(F.col("text")).alias("t"))
    return rows.groupBy("source").agg(F.count("*").alias("files"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"), F.sum("t").alias("tokens"))


@query(
    "parsed_responses",
    """WITH e AS (SELECT event_type AS t, event_id % 4 AS k, least(1.0, greatest(0.0, round(value) / 100)) AS c, user_id FROM events)
SELECT CASE k WHEN 3 THEN 'PARSE-ERROR' ELSE t END AS rule_id, CASE k WHEN 0 THEN 'high' WHEN 3 THEN 'informational' ELSE 'medium' END AS severity, CASE k WHEN 3 THEN '' ELSE 'src/f' || user_id % 10 || '.ts' END AS file, count(*) AS n,
round(sum(CASE WHEN k = 3 THEN 0 WHEN k = 2 OR c = 0 THEN 0.5 ELSE c END), 4) AS confidence FROM e GROUP BY ALL""",
)
def parsed_responses(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    kind = F.col("event_id") % 4
    field = lambda name, value: F.concat(F.lit(f'"{name}": "'), value, F.lit('"'))
    file = F.concat(F.lit("src/f"), (F.col("user_id") % 10).cast("string"), F.lit(".ts"))
    one = F.when(kind == 0, F.concat_ws(", ", field("ruleId", F.col("event_type")), field("severity", F.lit("HIGH")))).otherwise(field("rule_id", F.col("event_type")))
    sure = F.when(kind != 2, F.concat(F.lit(', "confidence": '), (F.round("value") / 100).cast("string"))).otherwise(F.lit(""))
    place = F.concat(F.lit(', "locations": [{'), field("file", file), F.lit(', "startLine": 3}]'))
    raw = F.concat(F.lit('Here it is:\n```json\n{"findings": [{'), one, sure, place, F.when(kind == 3, "").otherwise("}]}"), F.lit("\n```"))
    rows = manifests.parse_responses(e.select(raw.alias("raw")))
    where = F.coalesce(F.get("locations", F.lit(0))["file"], F.lit(""))
    return rows.groupBy("rule_id", "severity", where.alias("file")).agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


@query("json_props", "SELECT event_type, count(*) AS n, sum((json_extract_string(props, '$.k'))::BIGINT)::BIGINT AS k FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query("url_tags", r"""WITH f AS (SELECT page_id, string_split(regexp_replace(url, '^https?://[^/]+/|[?#].*$', '', 'g'), '/') AS p FROM pages) SELECT page_id, array_to_string(list_filter(p[:-2], lambda x: x <> '' AND x NOT IN ('index', 'utils', 'helpers', 'types', '__tests__', 'test', 'tests', 'cache', 'build', 'coverage', '.turbo')), ',') AS tags, CASE WHEN len(p) <= 1 THEN 'root' WHEN len(p) = 2 THEN p[1] ELSE p[1] || '/' || p[2] END AS component FROM f""")
def url_tags(spark, sf_dir):
    path = F.regexp_replace("url", r"^https?://[^/]+/|[?#].*$", "")
    return load(spark, sf_dir, "pages").select("page_id", F.array_join(paths.path_tags(path), ",").alias("tags"), paths.component_key(path).alias("component"))


#: Spellings of severities by the last digit of an id: every name, every alias, and two unknown ones.
SPELLINGS = ("Critical", " HIGH ", "medium", "low", "Informational", "info", "WARNING", " moderate", "severe", "")


@query(
    "severity_text",
    "SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'informational' WHEN 5 THEN 'informational' ELSE 'medium' END AS severity, CASE event_id % 10 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 4 ELSE 2 END AS rank, CASE WHEN value / 100 = 0 THEN 0.5 ELSE least(1.0, greatest(0.0, value / 100)) END AS confidence FROM events",
)
def severity_text(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, SPELLINGS)), (F.col("event_id") % 10 + 1).cast("int"))
    rows = load(spark, sf_dir, "events").select("event_id", text.severity(raw).alias("severity"), text.confidence(F.col("value") / 100).alias("confidence"))
    return rows.withColumn("rank", text.severity_rank(F.col("severity")))


@query("subject_parse", r"""WITH s AS (SELECT event_id, event_type || '(' || (user_id % 4) || ')' || CASE WHEN event_id % 2 = 0 THEN ': ' ELSE ' ' END || 'x' AS subject FROM events) SELECT event_id, nullif(regexp_extract(subject, '^(\w+)(?:\(([^)]+)\))?!?:\s', 1), '') AS type, nullif(regexp_extract(subject, '^(\w+)(?:\(([^)]+)\))?!?:\s', 2), '') AS scope FROM s""")
def subject_parse(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    subject = F.concat("event_type", F.lit("("), (F.col("user_id") % 4).cast("string"), F.lit(")"), F.when(F.col("event_id") % 2 == 0, ": ").otherwise(" "), F.lit("x"))
    return e.select("event_id", text.conventional_type(subject).alias("type"), text.conventional_scope(subject).alias("scope"))
