"""A lexer for source files: what is comment, string, template, regular expression, and which brackets belong together.

One pass from left to right with a stack of open brackets.  A template's expressions are code again,
to any depth; a slash begins a regular expression where a value cannot have ended; Rust's raw strings,
nested comments and lifetimes, and Python's strings in three quotes are known.  Time is linear in
the text, and whatever is left open at the end ends there.
"""

from __future__ import annotations

import re
from bisect import bisect_right

COMMENT, STRING, TEMPLATE, REGEX = "comment", "string", "template", "regex"
CLOSES = {"(": ")", "[": "]", "{": "}", "${": "}"}

_LINE = r"[^\n]*"
_STARTS = {
    "ts": re.compile(r"//|/\*|[\"'`/(\[{}\])]"),
    "rs": re.compile(r"//|/\*|\bb?r#*\"|\bb?\"|\bb'|[\"'(\[{}\])]"),
    "py": re.compile(r"#|(?i:\b[rbfut]{1,2})?(?:\"\"\"|'''|\"|')|[(\[{}\])]"),
}
_TS_STRING = {q: re.compile(rf"{q}(?:\\[\s\S]|[^{q}\\\n])*{q}") for q in "\"'"}
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_RS_STRING = re.compile(r"\"(?:\\[\s\S]|[^\"\\])*(?:\"|\Z)")
_RS_CHAR = re.compile(r"'(?:\\(?:u\{[0-9a-fA-F_]*\}|x[0-9a-fA-F]{2}|.)|[^'\\\n])'")
_PY_ONE = {q: re.compile(rf"{q}(?:\\[\s\S]|[^{q}\\\n])*(?:{q}|(?=\n)|\Z)") for q in "\"'"}
_PY_THREE = {q: re.compile(rf"{q * 3}(?:\\[\s\S]|(?!{q * 3})[^\\])*(?:{q * 3}|\Z)") for q in "\"'"}

#: Words after which a slash begins a regular expression, and those whose round brackets a statement follows.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "instanceof", "do", "else", "yield", "await"}
_BEFORE_STATEMENT = {"if", "while", "for", "with"}


class Lexed:
    """Spans (start, end, kind) of a source that are not code, in order, and the closing bracket of each opening one."""

    def __init__(self, source: str, language: str):
        self.source, self.language = source, language
        self.spans: list[tuple[int, int, str]] = []
        self.close: dict[int, int] = {}
        self._lines: list[int] | None = None
        self._run()

    def blanked(self, *kinds: str) -> str:
        """The source with spans of these kinds (none: of all) blanked, breaks of lines left, so that positions stay."""
        out, at = [], 0
        for start, end, kind in self.spans:
            if not kinds or kind in kinds:
                out += (self.source[at:start], re.sub(r"[^\n]", " ", self.source[start:end]))
                at = end
        return "".join([*out, self.source[at:]])

    def line(self, at: int) -> int:
        """Line of a position, from 1."""
        if self._lines is None:
            self._lines = [m.end() for m in re.finditer("\n", self.source)]
        return bisect_right(self._lines, at) + 1

    def _run(self) -> None:
        source, starts, size = self.source, _STARTS[self.language], len(self.source)
        at, last, open_ = 0, -1, []  # last: of the code so far, the last character that is no blank
        after_statement = False  # whether the bracket closed last lets a statement follow
        while at < size:
            m = starts.search(source, at)
            code = source[at : m.start() if m else size].rstrip()
            if code:
                last, after_statement = at + len(code) - 1, False
            if not m:
                break
            token, begin, at = m[0], m.start(), m.end()
            if token in CLOSES:
                word = re.search(r"[A-Za-z_$]\w*$", source[max(0, last - 15) : last + 1]) if token == "(" else None
                open_.append((token, begin, bool(word) and word[0] in _BEFORE_STATEMENT))
                last, after_statement = begin, False
            elif token in ")]}":
                if open_ and CLOSES[open_[-1][0]] == token:
                    kind, opened, statement = open_.pop()
                    self.close[opened] = begin
                    if kind == "${":  # back in the template
                        at = self._template(begin, at, open_)
                        last, after_statement = at - 1, False
                        continue
                    after_statement = statement or token == "}"
                last = begin
            elif token == "`":
                at = self._template(begin, at, open_)
                last, after_statement = at - 1, False
            else:
                end, kind = self._literal(token, begin, last, after_statement)
                if kind is not None:
                    self.spans.append((begin, end, kind))
                at = end
                if kind != COMMENT:
                    last, after_statement = end - 1, False

    def _template(self, begin: int, at: int, open_: list) -> int:
        """Take a template's text up to its end or its next expression."""
        end = _TEMPLATE.match(self.source, at).end()
        if self.source.startswith("${", end):
            open_.append(("${", end + 1, False))
            end += 2
        else:
            end = min(end + 1, len(self.source))
        self.spans.append((begin, end, TEMPLATE))
        return end

    def _literal(self, token: str, begin: int, last: int, after_statement: bool) -> tuple[int, str | None]:
        """End and kind of what a token begins; no kind: the token is code."""
        source = self.source
        if token in ("//", "#"):
            end = source.find("\n", begin)
            return (end if end >= 0 else len(source)), COMMENT
        if token == "/*":
            return self._block(begin), COMMENT
        if self.language == "ts":
            if token == "/":
                m = _REGEX.match(source, begin) if self._value_may_begin(last, after_statement) else None
                return (m.end(), REGEX) if m else (begin + 1, None)
            m = _TS_STRING[token].match(source, begin)
            return (m.end(), STRING) if m else (begin + 1, None)  # an apostrophe of a text between tags
        if self.language == "rs":
            if token[-1] == "'":
                m = _RS_CHAR.match(source, begin + len(token) - 1)
                return (m.end(), STRING) if m else (begin + len(token), None)  # a lifetime
            if "r" in token:
                end = source.find('"' + "#" * token.count("#"), begin + len(token))
                return (end + 1 + token.count("#") if end >= 0 else len(source)), STRING
            return _RS_STRING.match(source, begin + len(token) - 1).end(), STRING
        quote = token[-1]
        kind = _PY_THREE if token.endswith(quote * 3) else _PY_ONE
        return kind[quote].match(source, begin + len(token) - (3 if kind is _PY_THREE else 1)).end(), STRING

    def _block(self, begin: int) -> int:
        """End of a block comment; Rust's may lie in one another."""
        depth = 1
        for m in re.compile(r"/\*|\*/").finditer(self.source, begin + 2):
            depth += 1 if m[0] == "/*" and self.language == "rs" else -(m[0] == "*/")
            if not depth:
                return m.end()
        return len(self.source)

    def _value_may_begin(self, last: int, after_statement: bool) -> bool:
        """Whether a value may begin after the code that ends at `last`, so that a slash is no division."""
        if last < 0:
            return True
        c = self.source[last]
        if c in ")}":
            return after_statement
        if c.isalnum() or c in "_$":
            word = re.search(r"[\w$]+$", self.source[max(0, last - 15) : last + 1])
            return word[0] in _BEFORE_REGEX
        return c not in "]`\"'"
