"""Manifests, plans, logs, rule sets, review responses and linter output as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import confidence, csv_values, severity

COMPONENT = "name string, path array<string>, deps array<string>, docs array<string>, tags array<string>, test string, env array<string>, stability string"
PLAN = (
    "metadata struct<feature: string, created: string>, tasks struct<task: array<struct<_id: string, description: string, action: string, values: string, "
    "touches: struct<_reads: string, _writes: string>, mutexes: string>>>, contract struct<"
    "preconditions: struct<condition: array<struct<_id: string, description: string, verify: string>>>, "
    "invariants: struct<invariant: array<struct<_id: string, _critical: string, description: string, verify: string>>>, "
    "postconditions: struct<condition: array<struct<_id: string, description: string, verify: string>>>>"
)
LOG = (
    "session struct<_started: string, _mode: string>, cost struct<_total_cost_usd: double, _total_input_tokens: bigint, _total_output_tokens: bigint>, "
    "tasks struct<task: array<struct<_id: string, _status: string, metrics: struct<_tokens: bigint, _minutes: double, _tools: bigint, _cost_usd: double>, "
    "files_modified: struct<file: array<string>>, postconditions: struct<check: array<struct<_id: string, _result: string>>>, observations: struct<observation: array<string>>>>>, "
    "invariant_checks struct<wave: array<struct<_id: int, check: array<struct<_VALUE: string, _result: string>>>>>, waves struct<wave: array<struct<_id: int, _status: string>>>"
)


def read_manifest(spark: SparkSession, text: str, version_key: str | None = None) -> DataFrame:
    """Components of a YAML manifest: name, path (array), deps, docs, tags, test, env, stability.

    Top-level scalars (a version line, say) are not components; path or paths may be one or many; a
    path that leaves the tree is an error.
    """
    import yaml

    rows = []
    for name, c in (yaml.safe_load(text) or {}).items():
        if name == version_key or not isinstance(c, dict):
            continue
        paths = c.get("path") or c.get("paths") or []
        paths = [paths] if isinstance(paths, str) else list(paths)
        paths = [p[2:] if p.startswith("./") else p for p in paths]
        if any(p.startswith("/") or ".." in p.split("/") for p in paths):
            raise ValueError(f"{name}: path leaves the tree")
        rows.append((name, paths, c.get("deps") or [], c.get("docs") or [], c.get("tags") or [], c.get("test"), c.get("env") or [], c.get("stability")))
    return spark.createDataFrame(rows, COMPONENT)


def parse_plans(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """plan (nested) and tasks: id, ord, description, action, values, reads, writes, mutexes."""
    plan = rows.withColumn("plan", F.from_xml(xml, PLAN, {"attributePrefix": "_"}))
    t = F.col("t")
    return plan.select("plan", F.posexplode("plan.tasks.task").alias("ord", "t")).select(
        "plan", t["_id"].alias("id"), "ord", t["description"].alias("description"), t["action"].alias("action"), csv_values(t["values"]).alias("values"),
        csv_values(t["touches"]["_reads"]).alias("reads"), csv_values(t["touches"]["_writes"]).alias("writes"), csv_values(t["mutexes"]).alias("mutexes"),
    )


def parse_execution_logs(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """id, status, tokens, minutes, tools (0 if missing), cost_usd, files, passed and failed checks of each task, and the log."""
    log = rows.withColumn("log", F.from_xml(xml, LOG, {"attributePrefix": "_"}))
    t = F.col("t")
    n = lambda c: F.coalesce(t["metrics"][c], F.lit(0))
    checks = t["postconditions"]["check"]
    return log.select("log", F.explode("log.tasks.task").alias("t")).select(
        "log", t["_id"].alias("id"), t["_status"].alias("status"), n("_tokens").alias("tokens"), n("_minutes").alias("minutes"), n("_tools").alias("tools"), t["metrics"]["_cost_usd"].alias("cost_usd"),
        F.coalesce(t["files_modified"]["file"], F.array().cast("array<string>")).alias("files"),
        F.size(F.filter(checks, lambda c: c["_result"] == "pass")).alias("passed"), F.size(F.filter(checks, lambda c: c["_result"] == "fail")).alias("failed"),
    )


def field(block: Column, name: str) -> Column:
    """Value of a **Name:** field, up to the next field, heading or the end; null without it."""
    return F.nullif(F.trim(F.regexp_extract(block, rf"(?i)\*\*{name}:\*\*\s*([\s\S]*?)(?=\n\*\*\w|\n###|\z)", 1)), F.lit(""))


def bullets(value: Column) -> Column:
    """Items of a bulleted list."""
    lines = F.filter(F.split(F.coalesce(value, F.lit("")), "\n"), lambda x: x.rlike(r"^\s*-\s+"))
    return F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\s*-\s+", "")))


def front_matter(text: Column) -> Column:
    """Map of the flat keys between the leading --- lines."""
    yaml = F.regexp_extract(text, r"\A---\n([\s\S]*?)\n---\n", 1)
    lines = F.filter(F.split(yaml, "\n"), lambda x: x.rlike(r"^\w[\w-]*\s*:\s*.+$"))
    pair = lambda x: F.struct(F.regexp_extract(x, r"^(\w[\w-]*)\s*:", 1), F.regexp_replace(F.trim(F.regexp_extract(x, r":\s*(.+)$", 1)), r"""^["'](.*)["']$""", "$1"))
    return F.map_from_entries(F.transform(lines, pair))


def parse_rulesets(rows: DataFrame, text: str = "text") -> DataFrame:
    """id, title, category, severity, applies_to, compliant, violation, what_to_look_for, guidance of each rule.

    Categories start with "## ", rules with "### ID: title".
    """
    body = F.regexp_replace(text, r"\A---\n[\s\S]*?\n---\n", "")
    sections = rows.select(F.explode(F.split(F.concat(F.lit("\n"), body), r"\n(?=## )")).alias("section")).filter(F.col("section").startswith("## "))
    blocks = sections.select(F.trim(F.regexp_extract("section", r"^## (.*)", 1)).alias("category"), F.explode(F.split("section", r"\n(?=### )")).alias("b"))
    head = r"(?m)^###\s+([\w-]+):\s*(.+)$"
    b = F.col("b")
    return blocks.filter(b.rlike(head)).select(
        F.regexp_extract(b, head, 1).alias("id"), F.trim(F.regexp_extract(b, head, 2)).alias("title"), "category", F.coalesce(field(b, "Severity"), F.lit("Medium")).alias("severity"), csv_values(field(b, "Applies to")).alias("applies_to"),
        field(b, "Compliant").alias("compliant"), field(b, "Violation").alias("violation"), bullets(field(b, "What to look for")).alias("what_to_look_for"), field(b, "Guidance").alias("guidance"),
    )


def parse_responses(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Findings of review responses: all other columns, rule_id, severity, title, description, evidence, remediation, confidence, locations.

    The response is the first { to the last } of the text, fences taken off.  Alias names of fields
    are understood, a single location is a list of one, missing values get defaults.  A response
    that is no JSON gives one row PARSE-ERROR with confidence 0.
    """
    one = "struct<file: string, path: string, startLine: int, start_line: int, line: int, endLine: int, end_line: int>"
    kind = f"struct<findings: array<struct<ruleId: string, rule_id: string, severity: string, title: string, description: string, evidence: string, remediation: string, suggestion: string, fix: string, confidence: double, locations: array<{one}>, location: array<{one}>>>>"
    body = F.regexp_extract(raw, r"(\{[\s\S]*\})", 1)
    found = F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, kind))
    keep = [c for c in rows.columns if c != raw]
    out = rows.withColumn("_j", found).select(*keep, "_j.findings", F.col("_j").isNull().alias("_bad"), F.explode_outer("_j.findings").alias("f")).filter("_bad or f is not null")
    f = F.col("f")
    text = lambda *names, default="": F.coalesce(*[F.nullif(f[n], F.lit("")) for n in names], F.lit(default))
    places = F.transform(
        F.coalesce(f["locations"], f["location"], F.array().cast(f"array<{one}>")),
        lambda p: F.struct(F.coalesce(p["file"], p["path"], F.lit("unknown")).alias("file"), F.coalesce(p["startLine"], p["start_line"], p["line"], F.lit(1)).alias("start_line"), F.coalesce(p["endLine"], p["end_line"]).alias("end_line")),
    )
    bad = F.col("_bad")
    return out.select(
        *keep,
        F.when(bad, "PARSE-ERROR").otherwise(text("ruleId", "rule_id", default="UNKNOWN")).alias("rule_id"),
        F.when(bad, "informational").otherwise(severity(text("severity", default="medium"))).alias("severity"),
        F.substring(F.when(bad, "Response could not be read").otherwise(text("title", default="Untitled finding")), 1, 80).alias("title"),
        text("description").alias("description"), text("evidence").alias("evidence"), text("remediation", "suggestion", "fix").alias("remediation"),
        F.when(bad, F.lit(0.0)).otherwise(confidence(f["confidence"])).alias("confidence"), places.alias("locations"),
    )


def parse_compiler_messages(lines: DataFrame, value: str = "value") -> DataFrame:
    """file, line, column, severity, message, rule_id of compiler messages, one JSON object to a line; notes and help are left out."""
    kind = "reason string, message struct<level: string, message: string, code: struct<code: string>, spans: array<struct<file_name: string, line_start: int, column_start: int>>>"
    rows = lines.select(F.from_json(value, kind).alias("j")).filter("j.reason = 'compiler-message' and j.message is not null").select("j.message.*").filter("coalesce(level, '') not in ('note', 'help')")
    span = F.get("spans", F.lit(0))
    return rows.select(F.coalesce(span["file_name"], F.lit("")).alias("file"), F.coalesce(span["line_start"], F.lit(0)).alias("line"), F.coalesce(span["column_start"], F.lit(0)).alias("column"), F.when(F.col("level") == "error", "error").otherwise("warning").alias("severity"), "message", F.col("code.code").alias("rule_id"))


def parse_lint_arrays(rows: DataFrame, value: str = "value") -> DataFrame:
    """The same columns from one JSON array to a row."""
    kind = "array<struct<filename: string, line: int, column: int, severity: string, message: string, ruleId: string>>"
    d = F.col("d")
    return rows.select(F.explode(F.from_json(value, kind)).alias("d")).select(F.coalesce(d["filename"], F.lit("")).alias("file"), F.coalesce(d["line"], F.lit(0)).alias("line"), F.coalesce(d["column"], F.lit(0)).alias("column"), F.coalesce(d["severity"], F.lit("warning")).alias("severity"), d["message"].alias("message"), d["ruleId"].alias("rule_id"))


def read_suppressions(text: str) -> list[dict]:
    """Rules of a YAML suppression list: rule, file, glob and reason; entries without a rule are left out."""
    import yaml

    found = (yaml.safe_load(text) or {}).get("suppressions") or []
    text_of = lambda s, k: s[k] if isinstance(s.get(k), str) else None
    return [{"rule": str(s["rule"]), "file": text_of(s, "file"), "glob": text_of(s, "glob"), "reason": text_of(s, "reason") or "Suppressed by configuration"} for s in found if isinstance(s, dict) and "rule" in s]
