"""Keyed tables, log streams, configurations, nested symbols, drift over several locations."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.functions import code
from weftline.operators import cochange, findings, graph
from weftline.sources import commits, configs, sinks, store, symbols


def test_keyed_table(spark, tmp_path):
    table = store.KeyedTable(spark, str(tmp_path / "links"), "sha string, path string, alive boolean", ["sha", "path"], buckets=4)
    table.create()
    table.create()
    rows = lambda *r: spark.createDataFrame([(a, b, c) for a, b, c in r], "sha string, path string, alive boolean")
    got = lambda: {tuple(r) for r in table.read().collect()}
    assert got() == set()
    table.insert_absent(rows(("a", "x", True), ("a", "x", True), ("a", "y", True), ("b", "x", True)))
    table.insert_absent(rows(("a", "x", False), ("c", "z", True)))
    assert got() == {("a", "x", True), ("a", "y", True), ("b", "x", True), ("c", "z", True)}
    table.upsert(rows(("a", "x", False), ("d", "w", True)))
    assert got() == {("a", "x", False), ("a", "y", True), ("b", "x", True), ("c", "z", True), ("d", "w", True)}
    table.mark(rows(("b", "x", True)).select("sha", "path"), "alive", False)
    table.delete(rows(("c", "z", True), ("nope", "z", True)).select("sha", "path"))
    assert got() == {("a", "x", False), ("a", "y", True), ("b", "x", False), ("d", "w", True)}
    table.rewrite(["sha"], rows(("a", "q", True)))
    assert got() == {("a", "q", True), ("b", "x", False), ("d", "w", True)}
    table.delete(table.read().select("sha", "path"))
    assert got() == set()
    table.upsert(rows())
    assert got() == set()


def test_logs_are_read_once(spark, tmp_path):
    record = lambda sha, t, *entries: f"---COMMIT---\n{sha}\nann\n{t}\nfeat: x\n\n---FILES---\n" + "\n".join(entries) + "\n"
    folder, seen = tmp_path / "logs", []
    folder.mkdir()
    (folder / "1.log").write_text(record("s1", 5, "M\ta", "M\tb") + record("s2", 6, "D\tb", "R100\ta\tc"))
    each = lambda batch, _: seen.extend(r.sha for r in batch.collect())
    commits.resume(spark, str(folder), str(tmp_path / "done"), each)
    (folder / "2.log").write_text(record("s3", 7, "A\td"))
    commits.resume(spark, str(folder), str(tmp_path / "done"), each)
    assert sorted(seen) == ["s1", "s2", "s3"]
    parsed = commits.parse_records(commits.read_log(spark, str(folder)))
    changed = commits.changed_files(parsed, 4)
    assert {r.file for r in changed.collect()} == {"c", "d"} and {r.file for r in commits.changed_files(parsed, 6).collect()} == {"d"}
    owner = spark.createDataFrame([("c", "core"), ("e", "web"), ("f", "cli"), ("g", "other")], "file string, component string")
    deps = spark.createDataFrame([("web", "core"), ("cli", "web")], "src string, dst string")
    assert {r.file for r in commits.with_dependents(changed, owner, deps).collect()} == {"c", "d", "e", "f"}
    assert [r.file for r in commits.only_changed(owner, changed).collect()] == ["c"]


def test_configurations():
    texts = {
        "tsconfig.json": '{"extends": "./base", "compilerOptions": {"paths": {"@a/*": ["src/a/*"]}},}',
        "base.json": '{/* base */ "extends": "shared", "compilerOptions": {"baseUrl": "lib", "paths": {"@a/*": ["old/*"], "@b": ["b.ts"]}}}',
        "node_modules/shared/tsconfig.json": '{"extends": "../../base.json", "compilerOptions": {"paths": {"@c": ["c.ts"]}}}',
        "pkg/tsconfig.json": '{"compilerOptions": {"paths": {"#x/*": ["./x/*"]}}}',
        "bad/tsconfig.json": "{",
    }
    assert configs.inherited("tsconfig.json", texts) == {"base_dir": "lib", "paths": {"@c": ["c.ts"], "@a/*": ["src/a/*"], "@b": ["b.ts"]}}
    assert configs.inherited("bad/tsconfig.json", texts) is None and configs.inherited("none", texts) is None
    assert configs.nearest("pkg/deep/er", texts) == "pkg/tsconfig.json" and configs.nearest("src/a", texts) == "tsconfig.json"
    assert configs.aliases(["pkg/src", "pkg/test", "src"], texts) == [("#x/*", "pkg/x/*"), ("@c", "lib/c.ts"), ("@a/*", "lib/src/a/*"), ("@b", "lib/b.ts")]
    files = {"r.md": "here", "rules/own.md": "own"}
    look = lambda n: configs.ruleset(n, files, {"hipaa": "built in"}, "rules")
    assert (look("r.md"), look("hipaa"), look("own"), look("own.md"), look("x")) == ("here", "built in", "own", "own", None)
    assert configs.layered({"web": ["core"], "core": [], "cli": ["web", "core"]}) == "core\n  web <- core\n    cli <- core, web"
    assert configs.layered({"a": ["b"], "b": ["a"]}).count("(cycle)") == 2


TS = """// class Fake { x() {} }
export abstract class Box<T> extends Base {
  private readonly size: number = 3;
  items?: Map<string, { a: number }>;
  constructor(public a: string) { super(); if (a) { this.run(a); } }
  static async run(x: string): Promise<void> {
    const inner = 1;
    for (const k of []) { other(k); }
  }
  get value() { return 1; }
}
interface Shape { area(): number; name: string }
enum Color { Red, Green = 2 }
export namespace Deep { export function inside() { return 0; } }
const top = () => 1;
"""

RS = """pub struct Cart { items: Vec<u8> }
impl<T: Clone> Show for Cart {
    pub fn add(&mut self) -> u8 { fn helper() {} 1 }
    fn len(&self) -> usize { 0 }
}
mod util { pub fn tidy() {} }
trait Show { fn show(&self); }
"""

PY = """class A:
    def run(self):
        def inner():
            pass
        return inner
    class B:
        async def go(self): ...
def top(): ...
"""


def test_nested_symbols(spark):
    got = {}
    for r in symbols.nested_symbols(spark.createDataFrame([("a.ts", TS), ("b.rs", RS), ("c.py", PY), ("d.txt", "class X {}")], "file string, content string")).orderBy("file", "ord").collect():
        got.setdefault(r.file, []).append((r.name, r.kind, r.parent, r.depth))
    assert got["a.ts"] == [
        ("Box", "class", None, 0), ("size", "property", "Box", 1), ("items", "property", "Box", 1), ("constructor", "constructor", "Box", 1), ("run", "method", "Box", 1), ("value", "method", "Box", 1),
        ("Shape", "interface", None, 0), ("area", "method", "Shape", 1), ("name", "property", "Shape", 1), ("Color", "enum", None, 0), ("Red", "enumMember", "Color", 1), ("Green", "enumMember", "Color", 1),
        ("Deep", "namespace", None, 0), ("inside", "function", "Deep", 1), ("top", "const", None, 0),
    ]
    assert got["b.rs"] == [("Cart", "struct", None, 0), ("Cart", "impl", None, 0), ("add", "method", "Cart", 1), ("len", "method", "Cart", 1), ("util", "mod", None, 0), ("tidy", "function", "util", 1), ("Show", "trait", None, 0), ("show", "method", "Show", 1)]
    assert got["c.py"] == [("A", "class", None, 0), ("run", "method", "A", 1), ("inner", "function", "run", 2), ("B", "class", "A", 1), ("go", "method", "B", 2), ("top", "function", None, 0)]
    assert set(got) == {"a.ts", "b.rs", "c.py"}
    tree = symbols.nested_symbols(spark.createDataFrame([("a.ts", TS)], "file string, content string"))
    assert [tuple(r) for r in symbols.first_named(tree, "run").collect()] == [("a.ts", "method", "Box", 1, 6)]


def test_drift_over_locations(spark):
    kind = "rule_id string, ord int, severity string, confidence double, locations array<struct<file: string, start_line: int, end_line: int>>"
    old = spark.createDataFrame([("A", 0, "high", 0.5, [("x", 1, None), ("y", 10, 20)]), ("A", 1, "low", 0.5, [("z", 5, 6)]), ("B", 0, "low", 0.5, [])], kind)
    new = spark.createDataFrame([("A", 0, "high", 0.75, [("w", 1, 1), ("y", 20, 25)]), ("A", 1, "low", 0.5, [("z", 6, None)]), ("A", 2, "low", 0.5, [("z", 6, 6)])], kind)
    got = sorted((r.rule_id, r.file or "", r.status, [tuple(c) for c in r.changes]) for r in findings.drift(old, new).collect())
    assert got == [("A", "w", "changed", [("confidence", "0.50", "0.75")]), ("A", "z", "new", []), ("A", "z", "stable", []), ("B", "", "resolved", [])]


def test_suppressions_end_with_the_file(spark):
    files = spark.createDataFrame([("a", "x\n// audit-suppress R-1"), ("b", "// audit-suppress R-2\ny")], "file string, content string")
    assert sorted((r.file, r.line) for r in findings.inline_suppressions(files).collect()) == [("a", 2), ("b", 1), ("b", 2)]


def test_signatures_go_to_the_end():
    lines = ["export function f("] + [f"  a{i}: number," for i in range(80)] + ["): void {", "}"]
    assert code.signature(lines, 0).count("\n") == 81 and code.signature(lines, 0).endswith("): void")
    assert code.signature(["type A =", "  | B", "  | C;", "x"], 0) == "type A =\n  | B\n  | C;" and code.signature(["a", "b", "c"], 0, 1) == "a\nb"
    assert code.doc_comment(["/** Says. */", "", "@dec", "class A {}"], 3) == "Says."


def test_type_references(spark):
    text = "import type { A, B as C } from './x';\nimport { type D, E } from './y';\nlet v: A<WeakMap<string, D>> | Awaited<Own> | String;"
    row = spark.createDataFrame([(text,)], "d string").select(code.type_references(F.col("d"), False).alias("near"), code.type_references(F.col("d"), True).alias("deep"), code.imported_types(F.col("d")).alias("m")).first()
    assert sorted(row.near) == ["A", "D"] and sorted(row.deep) == ["A", "D", "Own", "String"] and row.m == {"A": "./x", "C": "./x", "D": "./y"}


def test_long_cycles_are_found(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(20, 21), (21, 20), (21, 22)], "src long, dst long")
    assert {r.node for r in graph.cyclic_nodes(edges).collect()} == {20, 21, 22}


def test_neighbours_of_one_item(spark):
    links = spark.createDataFrame([(g, i) for g, items in enumerate([[1, 2, 3], [1, 2], [2, 3], [1], [4, 5], [1, 2, 2]]) for i in items], "g long, i long")
    want = {(r.neighbour, round(r.weight, 9), r.n) for r in cochange.both_ways(cochange.edges(links, "g", "i")).filter("item = 1").collect()}
    got = {(r.neighbour, round(r.weight, 9), r.n) for r in cochange.neighbours_of(links, "g", "i", 1).collect()}
    assert got == want and len(got) == 2


def test_html(spark):
    rows = spark.createDataFrame([("a<b", 1), ("c&d", None)], "k string, v int")
    lines = [r.value for r in sinks.as_html(rows, "Scores", "k").collect()]
    assert lines[0].startswith("<!DOCTYPE html>") and lines[2:] == ["<tr><td>a&lt;b</td><td>1</td></tr>", "<tr><td>c&amp;d</td><td></td></tr>", "</table>"]


def test_checkpoints_need_a_shared_folder():
    class Session:
        class sparkContext:
            master = "spark://there:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda *_: None)

    class Frame:
        sparkSession = Session

    with pytest.raises(ValueError):
        graph.checkpoint(Frame)
    assert json.loads("[]") == []
