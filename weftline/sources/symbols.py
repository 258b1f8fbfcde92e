"""Symbols and imports of source files, by extension, as table functions over (file, content).

A parser is a generator from text to rows; the registry maps extensions to parsers, the last
registration wins.  Parsing is per file, in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import lexer
from weftline.operators.sized import dealt

SYMBOLS = "file string, name string, kind string, exported boolean, line int, start int, end int"
IMPORTS = "file string, specifier string, imported_names array<string>, is_type_only boolean, is_re_export boolean"
EXPORTS = "file string, exported_name string, is_barrel boolean"

_TS = re.compile(r"^(export\s+(?:default\s+)?)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function\*?|class|interface|type|enum|const|let|var|namespace)\s+([A-Za-z_$][\w$]*)", re.M)
_RUST = re.compile(r"^(pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+(?=fn))*(fn|struct|enum|trait|type|mod|const|static|union|macro_rules!)\s+([A-Za-z_]\w*)", re.M)
_IMPORT = re.compile(r"""^\s*(import|export)\s+(type\s+)?([^;'"]*?)\s*(?:from\s+)?['"]([^'"]+)['"]""", re.M)
_LOCAL = re.compile(r"^\s*export\s+(?:default\b|(?:declare\s+|abstract\s+|async\s+)*(?:function|class|interface|type|enum|const|let|var|namespace)\b|\{[^}]*\}\s*;?\s*$)", re.M)


#: Lexer of an extension, and the kinds of declarations that a block ends (others end with a line or a semicolon).
LEXERS = {**dict.fromkeys(("ts", "tsx", "js", "jsx"), "ts"), "rs": "rs", "py": "py"}
_LINES = {"type", "const", "let", "var", "static", "variable", "use", "property"}


def without_comments(source: str, language: str = "ts") -> str:
    """Comments blanked, so that positions stay; strings are left alone."""
    return lexer.Lexed(source, language).blanked(lexer.COMMENT)


def end_of(lexed: lexer.Lexed, plain: str, at: int, kind: str, hi: int | None = None) -> int:
    """End of a declaration in a source without literals: its block, or a semicolon or line end outside brackets."""
    hi, lines = len(plain) if hi is None else hi, kind in _LINES
    while m := _END.search(plain, at, hi):
        c, at = m[0], m.end()
        if c in "{([":
            if m.start() not in lexed.close:
                return hi
            at = lexed.close[m.start()] + 1
            if c == "{" and not lines:
                return min(at, hi)
        elif c == ";" or at < hi and not plain[at].isspace() and plain[at] not in (".?:&|+-*/=,){" if lines else "{"):
            return at
    return hi


_END = re.compile(r"[{(\[;\n]")


def typescript_symbols(source: str) -> Iterator[tuple]:
    lexed = lexer.Lexed(source, "ts")
    plain = lexed.blanked()
    for m in _TS.finditer(plain):
        kind = {"function*": "function", "let": "variable", "var": "variable", "const": "const"}.get(m[2], m[2])
        yield m[3], kind, bool(m[1]), lexed.line(m.start()), m.start(), end_of(lexed, plain, m.end(), kind)


def rust_symbols(source: str) -> Iterator[tuple]:
    lexed = lexer.Lexed(source, "rs")
    plain = lexed.blanked()
    for m in _RUST.finditer(plain):
        kind = {"fn": "function", "macro_rules!": "macro"}.get(m[2], m[2])
        yield m[3], kind, bool(m[1]), lexed.line(m.start()), m.start(), end_of(lexed, plain, m.end(), "item" if kind == "type" else kind)


def python_symbols(source: str) -> Iterator[tuple]:
    for name, kind, _, depth, line, start, end in _python_tree(source):
        if not depth:
            yield name, kind, not name.startswith("_"), line, start, end


REGISTRY: dict[str, Callable[[str], Iterator[tuple]]] = {**dict.fromkeys(("ts", "tsx", "js", "jsx"), typescript_symbols), "rs": rust_symbols, "py": python_symbols}


def register(extension: str, parser: Callable[[str], Iterator[tuple]]) -> None:
    """Use a parser for an extension."""
    REGISTRY[extension] = parser


def ts_imports(source: str) -> tuple[list[tuple], list[str], bool]:
    """(imports, exported names, whether all the file does is re-export)."""
    plain, imports, names = without_comments(source), [], []
    local = bool(_LOCAL.search(re.sub(r"""export\s+(?:type\s+)?(?:\*[^;'"]*|\{[^}]*\})\s*from\s*['"][^'"]*['"]""", "", plain)))
    for m in _IMPORT.finditer(plain):
        word, only, clause, target = m.groups()
        if word == "export" and "from" not in m[0]:
            continue
        braces = re.search(r"\{([^}]*)\}", clause)
        picked = [re.sub(r"^type\s+", "", p.strip()).split(" as ") for p in (braces[1].split(",") if braces else []) if p.strip()]
        got = [p[0].strip() for p in picked]
        head = re.sub(r"\{[^}]*\}", "", clause).replace("from", " ").strip(" ,\n")
        if word == "import":
            if head.startswith("*") or ", *" in head:
                got.append("*")
            if head and not head.startswith("*"):
                got.append("default")
            imports.append((target, got, bool(only), False))
        else:
            imports.append((target, [] if "*" in clause and not braces else got, bool(only), True))
            names += [p[-1].strip() for p in picked]
    for m in re.finditer(r"^\s*export\s+(default\s+)?(?:declare\s+|abstract\s+|async\s+)*(?:(?:function\*?|class|interface|type|enum|const|let|var|namespace)\s+([A-Za-z_$][\w$]*))?", plain, re.M):
        if m[1]:
            names.append("default")
        if m[2]:
            names.append(m[2])
    for m in re.finditer(r"^\s*export\s+(?:type\s+)?\{([^}]*)\}\s*(?!\s*from)[;\n]", plain, re.M):
        names += [p.split(" as ")[-1].strip() for p in m[1].split(",") if p.strip()]
    return imports, list(dict.fromkeys(names)), bool([i for i in imports if i[3]]) and not local


def rust_imports(source: str) -> list[tuple]:
    """Use declarations, grouped ones flattened with their whole prefix."""
    out = []

    def expand(tree: str, prefix: str) -> None:
        tree = tree.strip()
        brace = tree.find("{")
        if brace < 0:
            path = (prefix + tree.split(" as ")[0].strip()).removesuffix("::self")
            head, _, name = path.rpartition("::")
            out.append((path if name != "*" else head, [name or path], False, False))
            return
        head, inner, depth, at = prefix + tree[:brace], tree[brace + 1 : tree.rfind("}")], 0, 0
        for i, c in enumerate(inner + ","):
            depth += (c == "{") - (c == "}")
            if c == "," and not depth:
                if inner[at:i].strip():
                    expand(inner[at:i], head)
                at = i + 1

    for m in re.finditer(r"^\s*(pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", lexer.Lexed(source, "rs").blanked(), re.M):
        n = len(out)
        expand(re.sub(r"\s+", " ", m[2]), "")
        if m[1]:
            out[n:] = [(s, names, only, True) for s, names, only, _ in out[n:]]
    return out


def symbols(files: DataFrame) -> DataFrame:
    """Top-level symbols of files (file, content); files of unknown kind have none."""
    registry = dict(REGISTRY)

    def run(batches):
        import pandas as pd

        for frame in batches:
            rows = [(f, *s) for f, c in zip(frame["file"], frame["content"]) for s in registry.get(f.rpartition(".")[2], lambda _: ())(c or "")]
            yield pd.DataFrame(rows, columns=["file", "name", "kind", "exported", "line", "start", "end"])

    return files.select("file", "content").mapInPandas(run, SYMBOLS)


#: Files that a task parses: a small table of names may stand for much text.
FILES = 50_000
TREE = "file string, ord int, name string, kind string, parent string, depth int, line int, start int, end int"

_MEMBER = re.compile(r"^[ \t]*((?:(?:public|private|protected|static|readonly|abstract|override|async|declare|get|set)\s+)*)([#*]?\s*[A-Za-z_$][\w$]*)\s*([?!]?)\s*(\(|<|:|=(?!=)|;|,|$)", re.M)
_NESTS = {"class", "interface", "enum", "namespace", "trait", "mod", "impl", "struct"}
_IMPL = re.compile(r"^[ \t]*(?:unsafe\s+)?impl\b(?:\s*<[^{]*?>)?\s+(?:[^{;]*?\bfor\s+)?([A-Za-z_]\w*)[^{;]*\{", re.M)
_NOT_MEMBERS = {"if", "for", "while", "switch", "return", "catch", "else", "do", "try", "throw", "case", "default", "await", "new", "super", "this", "function"}


def _at_depth(lexed: lexer.Lexed, plain: str, lo: int, hi: int) -> str:
    """Part of a source with everything inside inner brackets blanked, so that only its own level is left."""
    out, at = [], lo
    while m := _OPEN.search(plain, at, hi):
        close = min(lexed.close.get(m.start(), hi), hi)
        out += (plain[at : m.end()], _BLANK.sub(" ", plain[m.end() : close]))
        at = close
        if at < hi:
            out.append(plain[at])
            at += 1
    return "".join([*out, plain[at:hi]])


_OPEN, _BLANK = re.compile(r"[{(\[]"), re.compile(r"[^\n]")


def _body(lexed: lexer.Lexed, plain: str, lo: int, hi: int) -> tuple[int, int] | None:
    while m := _OPEN.search(plain, lo, hi):
        close = lexed.close.get(m.start(), hi)
        if m[0] == "{":
            return m.end(), min(close, hi)
        lo = close + 1
    return None


def symbol_tree(source: str, extension: str) -> Iterator[tuple]:
    """(name, kind, parent, depth, line, start, end) of symbols and their members, in pre-order."""
    if extension == "py":
        yield from _python_tree(source)
        return
    rust = extension == "rs"
    lexed = lexer.Lexed(source, "rs" if rust else "ts")
    plain = lexed.blanked()
    pattern = _RUST if rust else _TS

    def inside(lo: int, hi: int, parent: str | None, kind: str | None, depth: int):
        level, found = _at_depth(lexed, plain, lo, hi), {}
        for m in _declared(pattern, level):
            name, what = m[3], {"fn": "method" if kind in ("impl", "trait") else "function", "function*": "function", "let": "variable", "var": "variable", "macro_rules!": "macro"}.get(m[2], m[2])
            found[lo + m.start()] = (name, what)
        if rust:
            for m in _IMPL.finditer(level):
                found[lo + m.start() + len(m[0]) - len(m[0].lstrip())] = (m[1], "impl")
        elif kind in ("class", "interface", "enum"):
            # a separator ends a member as a line break does
            for m in _MEMBER.finditer(level.replace("," if kind == "enum" else ";", "\n")):
                name = m[2].lstrip("*").strip()
                at = lo + m.start() + len(m[0]) - len(m[0].lstrip())
                if name in _NOT_MEMBERS or at in found:
                    continue
                what = "enumMember" if kind == "enum" else "constructor" if name == "constructor" else "method" if m[4] in ("(", "<") else "property"
                found[at] = (name, what)
        elif kind == "struct":
            found = {}
        starts = sorted(found)
        for at, after in zip(starts, [*starts[1:], hi]):
            name, what = found[at]
            if what == "enumMember":
                end = min(after, hi)
            elif what == "property":
                end = end_of(lexed, plain, at, what, min(after, hi))
                end = at + len(source[at:end].rstrip())
            else:
                end = end_of(lexed, plain, at, what, hi)
            yield name, what, parent, depth, lexed.line(at), at, end
            body = _body(lexed, plain, at, end) if what in _NESTS else None
            if body:
                yield from inside(*body, name, what, depth + 1)

    yield from inside(0, len(plain), None, None, 0)


def _declared(pattern: re.Pattern, level: str):
    """Matches of a pattern for line beginnings, indentation aside, with positions in the level."""

    class Hit:
        def __init__(self, m, at):
            self.m, self.at = m, at

        def __getitem__(self, k):
            return self.m[k]

        def start(self):
            return self.at

    at = 0
    for line in level.split("\n"):
        bare = line.lstrip()
        m = pattern.match(bare)
        if m:
            yield Hit(m, at + len(line) - len(bare))
        at += len(line) + 1


def _python_tree(source: str) -> Iterator[tuple]:
    lexed = lexer.Lexed(source, "py")
    level = _at_depth(lexed, lexed.blanked(), 0, len(source))  # no brackets, so each line is one of its own
    found = [(m.start(), len(m[1].expandtabs()), len(m[1]), m[3], m[2]) for m in re.finditer(r"^([ \t]*)(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)", level, re.M)]
    ends, later = [], []  # of each: where the next begins that is not deeper
    for at, indent, *_ in reversed(found):
        while later and later[-1][1] > indent:
            later.pop()
        ends.append(later[-1][0] if later else len(source))
        later.append((at, indent))
    open_: list[tuple] = []
    for (at, indent, blanks, name, word), end in zip(found, reversed(ends)):
        while open_ and open_[-1][0] >= indent:
            open_.pop()
        kind = "class" if word == "class" else "method" if open_ and open_[-1][2] == "class" else "function"
        yield name, kind, open_[-1][1] if open_ else None, len(open_), lexed.line(at), at + blanks, end
        open_.append((indent, name, kind))


def nested_symbols(files: DataFrame) -> DataFrame:
    """All symbols of files (file, content), members too, with parent, depth and pre-order number (ord)."""

    def run(batches):
        import pandas as pd

        for frame in batches:
            rows = [(f, i, *s) for f, c in zip(frame["file"], frame["content"]) if f.rpartition(".")[2] in REGISTRY for i, s in enumerate(symbol_tree(c or "", f.rpartition(".")[2]))]
            yield pd.DataFrame(rows, columns=["file", "ord", "name", "kind", "parent", "depth", "line", "start", "end"])

    return dealt(files.select("file", "content"), files.count(), "file", each=FILES).mapInPandas(run, TREE)


def first_named(tree: DataFrame, name: str) -> DataFrame:
    """The first symbol of a name in each file, in pre-order."""
    return tree.filter(F.col("name") == name).groupBy("file").agg(F.min_by(F.struct("kind", "parent", "depth", "line"), "ord").alias("s")).select("file", "s.*")


def imports(files: DataFrame) -> DataFrame:
    """Imports of files: specifier, imported names (* for all), type-only and re-export flags."""

    def run(batches):
        import pandas as pd

        for frame in batches:
            rows = []
            for f, c in zip(frame["file"], frame["content"]):
                found = rust_imports(c or "") if f.endswith(".rs") else ts_imports(c or "")[0]
                rows += [(f, *i) for i in found]
            yield pd.DataFrame(rows, columns=["file", "specifier", "imported_names", "is_type_only", "is_re_export"])

    return files.select("file", "content").mapInPandas(run, IMPORTS)


def exports(files: DataFrame) -> DataFrame:
    """Exported names of files and whether the file only re-exports."""

    def run(batches):
        import pandas as pd

        for frame in batches:
            rows = []
            for f, c in zip(frame["file"], frame["content"]):
                _, names, barrel = ts_imports(c or "")
                rows += [(f, n, barrel) for n in names]
            yield pd.DataFrame(rows, columns=["file", "exported_name", "is_barrel"])

    return files.select("file", "content").mapInPandas(run, EXPORTS)


def resolved(found: DataFrame, files: DataFrame) -> DataFrame:
    """found with resolved_path: the first existing candidate of a relative specifier, null otherwise.

    Candidates: the path as a .ts or .tsx file, then as a directory with an index file.
    """
    from weftline.functions.paths import dirname, normalised

    base = normalised(F.concat_ws("/", dirname(F.col("file")), F.regexp_replace("specifier", r"\.jsx?$", "")))
    candidates = F.transform(F.array(*map(F.lit, ("", ".ts", ".tsx", "/index.ts", "/index.tsx"))), lambda s: F.concat(F.col("_base"), s))
    rows = found.withColumn("_id", F.xxhash64("file", "specifier")).withColumn("_base", base)
    hits = rows.filter(F.col("specifier").startswith(".")).select("file", "specifier", F.posexplode(candidates).alias("_k", "_path"))
    hits = hits.distinct().join(files.select(F.col("file").alias("_path")).distinct(), "_path")
    best = hits.groupBy("file", "specifier").agg(F.min_by("_path", "_k").alias("resolved_path"))
    return rows.drop("_id", "_base").join(best, ["file", "specifier"], "left")


def alias_prefixes(patterns: list[str]) -> list[str]:
    """What specifiers of alias patterns begin with (or are)."""
    return [p[:-1] if p.endswith("/*") else p for p in patterns]


def resolved_aliases(found: DataFrame, aliases: list[tuple[str, str]], base: str = "") -> DataFrame:
    """found with alias_path: the specifier's path by the first (pattern, target) that fits, null otherwise.

    Patterns are exact or end in /*; aliases are a project's written list, tested on each row.
    """
    from weftline.functions.paths import normalised

    spec, out = F.col("specifier"), F.lit(None).cast("string")
    for pattern, target in reversed(aliases):
        if pattern.endswith("/*"):
            path = F.concat(F.lit(target[:-1] if target.endswith("/*") else target), F.substring(spec, len(pattern), 1 << 20))
            fits = spec.startswith(pattern[:-1])
        else:
            path, fits = F.lit(target), spec == pattern
        out = F.when(fits, normalised(F.concat_ws("/", F.lit(base), path))).otherwise(out)
    return found.withColumn("alias_path", out)


def resolved_rust(found: DataFrame, files: DataFrame, crate_root: str = "") -> DataFrame:
    """found with resolved_path of crate::, self:: and super:: paths: the first existing candidate.

    Candidates: the path as a file, as a directory with mod.rs, then both without the last segment,
    which may name an item.
    """
    from weftline.functions.paths import dirname, normalised

    parts = F.split("specifier", "::")
    n_super = F.size(F.filter(parts, lambda p: p == "super"))
    here = dirname(F.col("file"))
    base = F.when(parts[0] == "crate", F.lit(f"{crate_root}/src" if crate_root else "src")).when(parts[0] == "self", here).when(parts[0] == "super", F.concat_ws("/", here, F.array_join(F.array_repeat(F.lit(".."), n_super), "/")))
    rest = F.when(parts[0] == "super", F.slice(parts, n_super + 1, F.size(parts))).otherwise(F.slice(parts, F.lit(2), F.size(parts)))
    path = lambda p: normalised(F.concat_ws("/", base, F.array_join(p, "/")))
    less = F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 1, F.lit(0)))
    whole, module = path(rest), F.when(F.size(rest) > 1, path(less))
    candidates = F.array(F.concat(whole, F.lit(".rs")), F.concat(whole, F.lit("/mod.rs")), F.concat(module, F.lit(".rs")), F.concat(module, F.lit("/mod.rs")))
    hits = found.filter(base.isNotNull() & (F.size(rest) > 0)).select("file", "specifier", F.posexplode(candidates).alias("_k", "_path")).distinct()
    hits = hits.join(files.select(F.col("file").alias("_path")).distinct(), "_path")
    return found.join(hits.groupBy("file", "specifier").agg(F.min_by("_path", "_k").alias("resolved_path")), ["file", "specifier"], "left")


def stale(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Files (file, modified) that a table of parsed ones does not have at that time."""
    return files.join(parsed.select("file", "modified"), ["file", "modified"], "left_anti")
