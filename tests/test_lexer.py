"""The lexer: literals of three languages, brackets, regular expressions against divisions, and time."""

import time

import pytest

from weftline.functions import lexer
from weftline.sources import symbols


def kinds(source, language="ts"):
    return [(source[a:b], k) for a, b, k in lexer.Lexed(source, language).spans]


def test_brackets_in_literals_end_nothing():
    a = 'function f() { return "}"; }\nlet x = 1\n'
    assert [(n, a[s:e]) for n, _, _, _, s, e in symbols.typescript_symbols(a)] == [("f", 'function f() { return "}"; }'), ("x", "let x = 1\n")]
    b = "class A { s = '}'; m(x) { return `}${x}` } }\nclass B {}"
    assert [(n, k, p) for n, k, p, *_ in symbols.symbol_tree(b, "ts")] == [("A", "class", None), ("s", "property", "A"), ("m", "method", "A"), ("B", "class", None)]
    c = 'fn f() -> &\'static str { r#"}"{"# }\n/* { /* } */ { */\nstruct S<\'a> { c: char }\nfn g() { let c = \'}\'; }\n'
    assert [(n, c[s:e].count("\n"), c[e - 1]) for n, _, _, _, s, e in symbols.rust_symbols(c)] == [("f", 0, "}"), ("S", 0, "}"), ("g", 0, "}")]
    d = 'class A:\n    """\n    def no(self): pass\n    """\n    def yes(self, x=(\ndef_=1,\n    )):\n        s = f"def x"\n\ndef last(): pass\n'
    assert [(n, k, p, line) for n, k, p, _, line, *_ in symbols.symbol_tree(d, "py")] == [("A", "class", None, 1), ("yes", "method", "A", 5), ("last", "function", None, 10)]


@pytest.mark.parametrize(
    "source,regex",
    [("a = b / c / d;", []), ("x = /}/g.test(y)", ["/}/g"]), ("return /a[/]b/", ["/a[/]b/"]), ("if (x) /}/.exec(y)", ["/}/"]), ("f(x) / 2 / y", []), ("a[0] / 2 / 3", []), ("{ } /re/.test(s)", ["/re/"]), ("`t` / 2 / 3", []),
     ("x++ + /r/", ["/r/"]), ("5 / 2 // c / d", []), ("case /x\\/y/i: z", ["/x\\/y/i"]), ("'s' / 2 / 1", [])],
)
def test_slashes(source, regex):
    assert [t for t, k in kinds(source) if k == "regex"] == regex


def test_templates_nest_and_hold_code():
    source = "x = `a${ f({b: `c${1}}`}) }d` + {e: 2}"
    lexed = lexer.Lexed(source, "ts")
    assert [t for t, _ in kinds(source)] == ["`a${", "`c${", "}}`", "}d`"]
    assert lexed.blanked()[source.index("f(") :].startswith("f({b:") and lexed.close[source.rindex("{")] == len(source) - 1
    assert kinds("`open ${a") == [("`open ${", "template")] and kinds("'it is") == [] and kinds("/* never closed") == [("/* never closed", "comment")]


def test_literals_of_rust_and_python():
    assert [t for t, _ in kinds("let a = b'x'; let b: &'a str = \"\\\"}\"; br##\"}\"#\"##; '\\u{7d}'", "rs")] == ["b'x'", '"\\"}"', 'br##"}"#"##', "'\\u{7d}'"]
    assert [t for t, _ in kinds("a = r'\\'' + '''x\n'y'''  # }\nb = rb\"z\" 'open\nc = 1", "py")] == ["r'\\''", "'''x\n'y'''", "# }", 'rb"z"', "'open"]


def test_blanking_keeps_positions_and_brackets_pair():
    source = "a(/*{*/ [1, \"]\", `${[2]}`] )\n// (\n{'}'}"
    lexed = lexer.Lexed(source, "ts")
    plain = lexed.blanked()
    assert len(plain) == len(source) and plain.count("\n") == 2
    assert all(source[a] + source[b] in ("()", "[]", "{}") for a, b in lexed.close.items()) and lexed.line(source.index("// (")) == 2


@pytest.mark.parametrize("extension,one", [("ts", "export class C# { m() { return `${'}'}` } p = /}/ }\n"), ("rs", "pub fn f#() { let s = \"}\"; }\n"), ("py", "class C#:\n    def m(self):\n        return '''def x'''\n")])
def test_time_is_linear(extension, one):
    def took(n):
        source = "".join(one.replace("#", str(i)) for i in range(n))
        began = time.perf_counter()
        assert len(list(symbols.symbol_tree(source, extension))) >= n
        return time.perf_counter() - began

    took(500)
    assert took(16_000) < 30 * took(2000) / 2  # eight times the text; a square would take 64 times


def test_long_lines_and_deep_nesting():
    began = time.perf_counter()
    lexer.Lexed("(" * 100_000 + ")" * 100_000, "ts")
    lexer.Lexed("/ " * 100_000, "ts")
    lexer.Lexed("`${" * 30_000, "ts")
    lexer.Lexed('"' * 100_001, "py")
    assert time.perf_counter() - began < 10
