"""Paths as expressions: globs, prefixes, segments, normal form, owners, languages, tags."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Leading segments that are no topics, segments that never are, languages by
#: extension, code extensions and the role suffixes of code file names.
STRIP_PREFIXES = ("src", "lib", "components", "app", "pages")
STOP_TAGS = ("index", "utils", "helpers", "types", "__tests__", "test", "tests", "cache", "build", "coverage", ".turbo")
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "go": "go",
    "java": "java", "rs": "rust", "c": "c", "cpp": "cpp", "h": "c", "hpp": "cpp",
}
CODE_EXTENSIONS = ("ts", "tsx", "js", "jsx")
ROLE_SUFFIXES = ("controller", "service", "repository", "model", "handler", "route", "middleware", "provider")


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a glob: ** spans directories, * and ? stay in one."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        elif glob[i] == "?":
            out.append("[^/]")
            i += 1
        else:
            out.append(re.escape(glob[i]))
            i += 1
    return "^" + "".join(out) + "$"


def matches_any(path: Column, globs: list[str]) -> Column:
    """Whether a path matches one of the globs."""
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)


def ignored(path: Column, patterns: list[str]) -> Column:
    """Ignore rules: a trailing slash names a directory, a leading star a suffix, else a part of the path."""
    out = F.lit(False)
    for p in patterns:
        if p.endswith("/"):
            out = out | path.contains(p)
        elif p.startswith("*"):
            out = out | path.endswith(p[1:])
        else:
            out = out | path.contains(p)
    return out


def is_binary(content: Column, sample: int = 512) -> Column:
    """A NUL within the first characters."""
    return F.coalesce(F.substring(content.cast("string"), 1, sample).contains("\0"), F.lit(False))


def prefixes(path: Column) -> Column:
    """Every directory prefix of a path and the path itself, shortest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def normalised(path: Column) -> Column:
    """Path with . and .. resolved."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", up(acc)).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(done, "/")


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    """Language by extension, else unknown."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(table, extension(path)), F.lit("unknown"))


def path_tags(path: Column, strip: tuple[str, ...] = STRIP_PREFIXES, stop: tuple[str, ...] = STOP_TAGS) -> Column:
    """Directory names of a path without leading prefixes (while they follow each other) and stop words."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    lead = F.array(*map(F.lit, strip))
    state = F.struct(F.lit(True).alias("lead"), F.array().cast("array<string>").alias("out"))

    def step(acc, p):
        still = acc["lead"] & F.array_contains(lead, p)
        return F.struct(still.alias("lead"), F.when(still, acc["out"]).otherwise(F.concat(acc["out"], F.array(p))).alias("out"))

    kept = F.aggregate(dirs, state, step, lambda acc: acc["out"])
    return F.filter(kept, lambda p: ~F.array_contains(F.array(*map(F.lit, stop)), p) & (p != ""))


def component_key(path: Column) -> Column:
    """Grouping key of a path: root, its directory, or its first two directories."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) <= 1, "root").when(F.size(parts) == 2, parts[0]).otherwise(F.concat_ws("/", parts[0], parts[1]))


def stem(path: Column, suffixes: tuple[str, ...] = ROLE_SUFFIXES) -> Column:
    """Name of a code file without extension and role suffix, null for other files."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    bare = F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")
    return F.when(name.rlike(r"\.(?:" + "|".join(CODE_EXTENSIONS) + ")$"), F.regexp_replace(bare, r"\.(?:" + "|".join(suffixes) + ")$", ""))


def unscoped(package: Column) -> Column:
    """Package name without its scope."""
    return F.regexp_replace(package, "^@[^/]+/", "")


def owners(files: DataFrame, components: DataFrame, every: bool = False) -> DataFrame:
    """file, component: the component with the longest path that contains the file (or each, if every).

    files: file; components: name, path (one row for each path).  Prefixes of each file are matched
    by equality, so this is an equi-join however many components there are; unowned files are left out.
    """
    rows = files.select("file").distinct().withColumn("path", F.explode(prefixes(F.col("file"))))
    rows = rows.join(components.select(F.col("name").alias("component"), F.regexp_replace("path", "/+$", "").alias("path")), "path")
    if every:
        return rows.select("file", "component").distinct()
    best = F.max_by("component", F.struct(F.length("path"), F.col("component")))
    return rows.groupBy("file").agg(best.alias("component"))
