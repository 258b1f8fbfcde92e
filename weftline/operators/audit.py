"""Review plans and component surveys: rule matching, tasks, environment, tests, tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.paths import component_key
from weftline.functions.text import severity, severity_rank

#: Patterns (any case) of file paths that hold the code a rule's tag speaks of.
TAG_PATTERNS = {
    "api routes": ["route", "api/", "handler", "controller", "endpoint"],
    "http handlers": ["route", "handler", "middleware", "server"],
    "graphql resolvers": ["resolver", "graphql", "schema"],
    "rpc handlers": ["rpc", "grpc", "proto"],
    "database": ["db", "database", "model", "schema", "migration", "query", "repository", "prisma"],
    "database access": ["db", "database", "model", "repository", "dao", "query"],
    "database queries": ["query", "db", "repository", "dao"],
    "query builders": ["query", "builder"],
    "database schemas": ["schema", "model", "migration", "prisma"],
    "configuration": ["config", "env", "settings", r"\.env"],
    "middleware": ["middleware"],
    "authentication": ["auth", "login", "session", "jwt", "token", "credential"],
    "file access": ["upload", "download", "file", "storage", "fs"],
    "file serving": ["static", "serve", "upload", "download"],
    "logging": ["log", "logger", "monitor", "audit"],
    "error handling": ["error", "exception", "handler"],
    "encryption": ["crypto", "encrypt", "hash", "cipher", "sign"],
    "template": ["template", "view", "render", "component"],
    "admin": ["admin", "dashboard", "manage"],
    "payment": ["payment", "billing", "stripe", "checkout", "subscription"],
    "webhook": ["webhook", "hook", "callback"],
    "seed data": ["seed", "fixture", "mock"],
    "docker": ["docker", "compose", "Dockerfile"],
    "ci/cd": [r"\.github", "ci", "workflow", "jenkins", "gitlab-ci", "pipeline"],
    "package manifests": [r"package\.json", "requirements", r"go\.mod", r"Cargo\.toml", r"pom\.xml"],
    "html rendering": ["component", "page", "view", "template", r"\.tsx", r"\.jsx"],
    "url fetching": ["fetch", "http", "request", "client", "proxy"],
}


def rule_patterns(rules: list[dict]) -> dict[str, str]:
    """One regular expression of paths for each rule (id, applies_to); a rule without tags fits all paths."""
    import re

    out = {}
    for r in rules:
        parts = []
        for tag in r["applies_to"]:
            low = tag.lower().strip()
            parts += [p for known, patterns in TAG_PATTERNS.items() if known in low for p in patterns]
            parts += [re.escape(w) for w in low.split() if len(w) > 3]
        out[r["id"]] = "(?i)" + "|".join(parts) if parts else ("" if not r["applies_to"] else r"(?!)")
    return out


def rules_for_files(files: DataFrame, rules: list[dict]) -> DataFrame:
    """file, rule_id of every rule that fits a file; rules are a written list, tested on each row without a join."""
    tests = [F.when(F.col("file").rlike(p), F.lit(i)) for i, p in rule_patterns(rules).items()]
    return files.select("file", F.explode(F.array_compact(F.array(*tests))).alias("rule_id"))


def audit_tasks(files: DataFrame, rules: list[dict]) -> DataFrame:
    """component, category, rules, files, tokens, priority: one task for each component and category with a fitting rule.

    files: file, tokens; rules: dicts of id, category, severity, applies_to.  The priority is the
    worst severity's rank, 0 the worst.  A file that is listed more than once counts once, with the
    most tokens listed for it.
    """
    spark = files.sparkSession
    files = files.groupBy("file").agg(F.max("tokens").alias("tokens"))
    info = spark.createDataFrame([(r["id"], r["category"], r["severity"]) for r in rules], "rule_id string, category string, severity string")
    rows = rules_for_files(files, rules).join(F.broadcast(info), "rule_id").join(files, "file").withColumn("component", component_key(F.col("file")))
    per_file = rows.groupBy("component", "category", "file").agg(F.first("tokens").alias("tokens"), F.collect_set("rule_id").alias("r"), F.min(severity_rank(severity(F.col("severity")))).alias("p"))
    return per_file.groupBy("component", "category").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("r")))).alias("rules"), F.count("*").alias("files"), F.sum("tokens").alias("tokens"), F.min("p").alias("priority"))


def run_metadata(results: DataFrame) -> DataFrame:
    """One row: tasks, failed, tokens and distinct models.  results: task_id, failed, tokens, model."""
    return results.agg(F.count("*").alias("tasks"), F.count_if("failed").alias("failed"), F.sum("tokens").alias("tokens"), F.array_sort(F.collect_set("model")).alias("models"))


def environment(components: DataFrame, present: list[str]) -> DataFrame:
    """name, set: distinct variables that components require, and whether they are set."""
    return components.select(F.explode("env").alias("name")).distinct().withColumn("set", F.col("name").isin(*present) if present else F.lit(False))


def scoped_tests(components: DataFrame, names: list[str], tags: list[str] | None = None) -> DataFrame:
    """command, env: distinct test commands of the named components, with one of the tags if any are given."""
    rows = components.filter(F.col("name").isin(*names) & F.col("test").isNotNull())
    if tags:
        rows = rows.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    return rows.groupBy(F.col("test").alias("command")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("env")))).alias("env"))


def tag_groups(components: DataFrame) -> DataFrame:
    """tag, components (sorted); components without a tag stand under null."""
    return components.select("name", F.explode_outer("tags").alias("tag")).groupBy("tag").agg(F.array_sort(F.collect_set("name")).alias("components"))


def tag_index(components: DataFrame) -> DataFrame:
    """tag, index: distinct tags numbered from 0 in order; tags are a vocabulary of a manifest, so one task sorts them."""
    tags = components.select(F.explode("tags").alias("tag")).distinct()
    return tags.withColumn("index", F.row_number().over(Window.orderBy("tag")) - 1)


def scopes_of(paths: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Paths inside a root, and the others."""
    inside = F.col("file").startswith(root.rstrip("/") + "/")
    return paths.filter(inside), paths.filter(~inside)


def issues(*parts: DataFrame) -> DataFrame:
    """Union of issue tables (severity, category, component, message)."""
    return reduce(DataFrame.unionByName, parts)


def issue_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category", "severity").agg(F.count("*").alias("n"))
