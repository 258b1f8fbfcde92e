"""Text as expressions: tokens, commit subjects, tag lines, links, line and token counts, clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a token, severities from worst to least, and aliases of severities.
CHARS_PER_TOKEN = 4
SEVERITIES = ("critical", "high", "medium", "low", "informational")
SEVERITY_ALIASES = {"info": "informational", "warning": "medium", "moderate": "medium"}


def conventional_type(subject: Column) -> Column:
    """Type of a conventional commit subject, null if it is none."""
    return F.nullif(F.regexp_extract(subject, r"^(\w+)(?:\(([^)]+)\))?!?:\s", 1), F.lit(""))


def conventional_scope(subject: Column) -> Column:
    return F.nullif(F.regexp_extract(subject, r"^(\w+)(?:\(([^)]+)\))?!?:\s", 2), F.lit(""))


def tag_operations(body: Column) -> Column:
    """Array of struct(tag, op) of a body's first tag line; null without one."""
    line = F.regexp_extract(body, r"(?im)^tags:\s*(.+)$", 1)

    def parse(raw: Column) -> Column:
        t = F.trim(raw)
        signed = t.startswith("+") | t.startswith("-")
        return F.struct(F.when(signed, F.substring(t, 2, 1 << 20)).otherwise(t).alias("tag"), F.when(t.startswith("-"), "remove").otherwise("add").alias("op"))

    return F.when(line != "", F.transform(F.split(line, ","), parse))


def search_terms(query: str) -> list[str]:
    """Distinct lower-case tokens of a query; operators and punctuation go."""
    import re

    words = re.findall(r"[a-z0-9_]+", re.sub(r"[^A-Za-z0-9\s\-_]", " ", query).lower())
    return list(dict.fromkeys(w for w in words if w not in ("and", "or", "not")))


def tokens(text: Column) -> Column:
    """Distinct lower-case alphanumeric tokens."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / CHARS_PER_TOKEN).cast("long")


def line_count(text: Column) -> Column:
    """Lines, a trailing break counting as one more."""
    return F.size(F.split(text, "\n", -1))


def numbered(text: Column) -> Column:
    """Text with line numbers."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x, i: F.concat((i + 1).cast("string"), F.lit("→"), x)), "\n")


def markdown_links(text: Column) -> Column:
    """Array of struct(label, target) of links that lead neither to the web nor to an anchor."""
    pattern = F.lit(r"\[([^\]]*)\]\(([^)]+)\)")
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("label"), F.regexp_extract_all(text, pattern, 2).alias("target"))
    return F.filter(pairs, lambda p: ~p["target"].rlike("^(?:https?:|#)"))


def severity(raw: Column) -> Column:
    """Known severity of any spelling; unknown ones are medium."""
    low = F.lower(F.trim(raw))
    known = F.create_map(*[F.lit(x) for kv in {**{s: s for s in SEVERITIES}, **SEVERITY_ALIASES}.items() for x in kv])
    return F.coalesce(F.element_at(known, low), F.lit("medium"))


def severity_rank(name: Column) -> Column:
    """0 for the worst severity; unknown ones rank 3."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), name), F.lit(0)) - 1, F.lit(3)).cast("int")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def confidence(x: Column) -> Column:
    """Within 0 and 1; missing, zero and NaN become one half."""
    return clamp(F.when(x.isNull() | F.isnan(x) | (x == 0), F.lit(0.5)).otherwise(x), 0.0, 1.0)


def duration(ms: Column) -> Column:
    """Milliseconds below a second, else seconds with one decimal."""
    return F.when(ms < 1000, F.format_string("%dms", ms.cast("long"))).otherwise(F.format_string("%.1fs", ms / 1000.0))


def issue_key(*parts: Column) -> Column:
    """Parts joined by colons with timestamps masked."""
    return F.regexp_replace(F.concat_ws(":", *parts), r"\d{4}-\d{2}-\d{2}T[0-9:.]+Z?", "<time>")


def csv_values(raw: Column) -> Column:
    """Trimmed, non-empty parts of a comma list."""
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
