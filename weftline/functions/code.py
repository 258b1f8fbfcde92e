"""Source code as values: offsets, exports, signatures, comments, type references, editor tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_of(source: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    return F.size(F.split(F.substring(source, F.lit(1), offset), "\n", -1))


def offset_of(source: Column, line: Column, character: Column) -> Column:
    """0-based offset of a 0-based line and character."""
    before = F.slice(F.split(source, "\n", -1), F.lit(1), line)
    return F.aggregate(before, F.lit(0), lambda a, x: a + F.length(x) + 1) + character


def exported(line: Column) -> Column:
    """Whether a declaration's line exports it."""
    t = F.ltrim(line)
    return t.startswith("export ") | t.startswith("pub ") | t.startswith("pub(")


def body_brace(line: str) -> int:
    """Index of the brace that opens a body: outside brackets, type arguments and strings; -1 if there is none."""
    depth, quote = 0, ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote and line[i - 1] != "\\" else quote
        elif c in "\"'`":
            quote = c
        elif c in "([<":
            depth += 1
        elif c in ")]" or c == ">" and line[i - 1 : i] not in ("=", "-"):
            depth = max(0, depth - 1)
        elif c == "{" and not depth:
            return i
    return -1


def signature(lines: list[str], start: int, end: int | None = None) -> str:
    """A declaration's text, line breaks and all, up to its body, its semicolon or the symbol's last line."""
    out = []
    for line in lines[start : None if end is None else end + 1]:
        at = body_brace(line)
        out.append(line if at < 0 else line[:at].rstrip())
        if at >= 0 or line.rstrip().endswith(";"):
            break
    return "\n".join(out).rstrip()


def doc_comment(lines: list[str], start: int) -> str | None:
    """The /** */ comment above a line, blank and decorator lines between them aside, without its marks."""
    end = start - 1
    while end >= 0 and (not lines[end].strip() or lines[end].lstrip().startswith("@")):
        end -= 1
    if end < 0 or not lines[end].rstrip().endswith("*/"):
        return None
    for first in range(end, -1, -1):
        if "/**" in lines[first]:
            text = "\n".join(lines[first : end + 1])
            return re.sub(r"(?m)^\s*\* ?", "", text[text.index("/**") + 3 :].rsplit("*/", 1)[0]).strip()
        if "/*" in lines[first]:
            return None
    return None


def described(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """symbols (file, name, line, ...) with signature and doc; files: file, content."""
    kind = "signature string, doc string"

    @F.pandas_udf(kind)
    def describe(content, line):
        import pandas as pd

        rows = []
        for text, at in zip(content, line):
            lines = text.split("\n")
            rows.append((signature(lines, at - 1), doc_comment(lines, at - 1)))
        return pd.DataFrame(rows, columns=["signature", "doc"])

    rows = symbols.join(files.select("file", "content"), "file")
    return rows.withColumn("_d", describe("content", "line")).select(*symbols.columns, "_d.signature", "_d.doc")


#: Names that are no project types.
BUILTIN_TYPES = (
    "string", "number", "boolean", "void", "undefined", "null", "never", "any", "unknown", "object", "bigint", "symbol",
    "Array", "Promise", "Record", "Map", "Set", "WeakMap", "WeakSet", "ReadonlyArray", "Readonly", "Partial", "Required", "Pick", "Omit", "Exclude", "Extract",
    "NonNullable", "ReturnType", "Parameters", "InstanceType", "ConstructorParameters", "Awaited", "Function", "Date", "RegExp", "Error", "TypeError", "RangeError",
)


def type_names(declarations: Column) -> Column:
    """Distinct capitalised names outside import lines, without built-in ones."""
    lines = F.filter(F.split(declarations, "\n"), lambda x: ~x.rlike(r"^\s*import\s"))
    names = F.regexp_extract_all(F.array_join(lines, "\n"), F.lit(r"\b([A-Z][A-Za-z0-9_]*)\b"), 1)
    return F.array_except(F.array_distinct(names), F.array(*map(F.lit, BUILTIN_TYPES)))


def imported_types(declarations: Column) -> Column:
    """Map of local name to module of type imports: import type { A }, import { type A as B }; of equal names the last."""
    pattern = F.lit(r"""import\s+(type\b\s*)?\{([^}]+)\}\s*from\s*['"]([^'"]+)['"]""")
    found = F.arrays_zip(*[F.regexp_extract_all(declarations, pattern, k).alias(n) for k, n in ((1, "only"), (2, "names"), (3, "module"))])
    local = lambda n: F.trim(F.element_at(F.split(F.regexp_replace(F.trim(n), r"^type\s+", ""), r"\s+as\s+"), -1))
    typed = lambda p: F.filter(F.split(p["names"], ","), lambda n: (F.trim(n) != "") & ((p["only"] != "") | F.trim(n).rlike(r"^type\s")))
    entries = F.flatten(F.transform(found, lambda p: F.transform(typed(p), lambda n: F.struct(local(n).alias("k"), p["module"].alias("v")))))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(last)


def type_references(declarations: Column, deep: bool) -> Column:
    """Types that declarations refer to: all project types if deep, else only those imported as types."""
    names = type_names(declarations)
    return names if deep else F.array_intersect(F.map_keys(imported_types(declarations)), names)


def editor_tokens(deltas: DataFrame) -> DataFrame:
    """file, seq, line, character, length, kind from delta-encoded tokens (d_line, d_char, length, kind).

    Lines are a running sum; characters are one that starts anew on each line.
    """
    w = Window.partitionBy("file").orderBy("seq")
    rows = deltas.withColumn("line", F.sum("d_line").over(w))
    return rows.withColumn("character", F.sum("d_char").over(Window.partitionBy("file", "line").orderBy("seq"))).select("file", "seq", "line", "character", "length", "kind")


#: Names of symbol kinds by the editor protocol's number, from 1.
KIND_NAMES = (
    "file module namespace package class method property field constructor enum interface function variable constant string number boolean array object key "
    "null enumMember struct event operator type"
).split()


def kind_name(kind: Column) -> Column:
    """Name of a symbol kind's number."""
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, KIND_NAMES)), F.nullif(kind, F.lit(0))), F.lit("unknown"))


def declarations_of(text: str, kinds: list[str]) -> str:
    """Import lines and whole exported declarations of the given kinds.

    A declaration goes on until its braces close or, without a brace on its first line, until a
    semicolon.
    """
    words = [w for k in kinds for w in ({"enum": ["enum", r"const\s+enum"], "const": [r"const(?!\s+enum)"]}.get(k, [k]) if k in ("function", "class", "interface", "type", "enum", "const") else [])]
    head = re.compile(r"\s*export\s+(?:declare\s+)?(?:" + "|".join(words) + r")\s") if words else None
    out, depth, until = [], 0, None
    for line in text.split("\n"):
        starts = until is None and head is not None and head.match(line)
        if re.match(r"\s*import\s", line) and until is None:
            out.append(line)
        elif starts or until:
            out.append(line)
            depth += line.count("{") - line.count("}")
            if starts:
                until = "}" if depth > 0 else None if ";" in line or "}" in line else ";"
            elif until == "}" and depth <= 0 or until == ";" and ";" in line:
                until, depth = None, 0
    return "\n".join(out)


def trend_label(direction: Column) -> Column:
    """Three bars and the direction."""
    bars = F.when(direction == "increasing", "▂▅█").when(direction == "decreasing", "█▅▂").otherwise("▃▃▃")
    return F.concat(bars, F.lit(" ("), F.coalesce(direction, F.lit("stable")), F.lit(")"))


def bar(value: Column, largest: Column, width: int = 10) -> Column:
    """A bar of so many cells, filled in proportion to the largest value."""
    filled = F.when(largest > 0, F.round(value / largest * width)).otherwise(F.lit(0)).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))
