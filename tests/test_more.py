import pytest
from pyspark.sql import functions as F

from weftline.functions import code
from weftline.operators import audit, links
from weftline.sources import sinks

COMPONENT = "name string, path array<string>, docs array<string>, tags array<string>, env array<string>, test string"


def components(spark):
    return spark.createDataFrame([("auth", ["src/auth"], ["./docs/auth.md"], ["core"], ["KEY"], "t1"), ("web", ["src/web/src"], [], ["core", "ui"], ["KEY", "URL"], "t2")], COMPONENT)


def files(spark):
    names = ["src/auth/README.md", "src/auth/a.ts", "src/web/docs/x.md", "src/web/src/b.ts", "docs/auth.md", "other/README.md"]
    return spark.createDataFrame([(n, 10) for n in names], "file string, tokens long")


def test_docs_and_links(spark):
    got = {(r.component, r.doc): r.auto for r in links.discovered_docs(components(spark), files(spark)).collect()}
    assert got == {("auth", "docs/auth.md"): False, ("auth", "src/auth/README.md"): True, ("web", "src/web/docs/x.md"): True}
    docs = spark.createDataFrame([("src/auth/README.md", "[b](../web/src/b.ts#l1) [gone](x.md) [d](../web/docs) [w](https://x.y)")], "doc string, content string")
    found = links.resolved_links(docs)
    assert sorted(r.resolved for r in found.collect()) == ["src/auth/x.md", "src/web/docs", "src/web/src/b.ts"]
    assert [r.resolved for r in links.broken_links(found, files(spark)).collect()] == ["src/auth/x.md"]
    deps = links.evidence(links.inferred(found, components(spark), "doc", "resolved", "target")).collect()
    assert [(r.src, r.dst, r.n) for r in deps] == [("auth", "web", 1)]
    assert {r.component: r.n for r in links.files_of(files(spark), components(spark)).collect()} == {"auth": 2, "web": 1}


def test_barrels_and_references(spark):
    imp = spark.createDataFrame([("a", "index", "./i"), ("b", "x", "./x")], "file string, resolved_path string, specifier string")
    barrels = spark.createDataFrame([("index", "x"), ("index", "y")], "path string, resolved_path string")
    assert {(r.file, r.resolved_path) for r in links.through_barrels(imp, barrels).collect()} == {("a", "x"), ("a", "y"), ("b", "x")}
    refs = lambda *n: spark.createDataFrame([(x,) for x in n], "ref string")
    assert {tuple(r) for r in links.references(refs("auth", "ui"), components(spark)).collect()} == {("auth", "auth"), ("ui", "web")}
    with pytest.raises(Exception, match="unknown component"):
        links.references(refs("nope"), components(spark)).collect()


RULES = [{"id": "R1", "category": "A", "severity": "High", "applies_to": ["Authentication flows"]}, {"id": "R2", "category": "A", "severity": "critical", "applies_to": []}, {"id": "R3", "category": "B", "severity": "low", "applies_to": ["zzz"]}]


def test_rules_and_tasks(spark):
    got = {(r.file, r.rule_id) for r in audit.rules_for_files(files(spark), RULES).collect()}
    assert {f for f, r in got if r == "R1"} == {"src/auth/README.md", "src/auth/a.ts", "docs/auth.md"} and len({f for f, r in got if r == "R2"}) == 6 and not [1 for _, r in got if r == "R3"]
    tasks = {(r.component, r.category): (r.rules, r.files, r.tokens, r.priority) for r in audit.audit_tasks(files(spark), RULES).collect()}
    assert tasks[("src/auth", "A")] == (["R1", "R2"], 2, 20, 0) and tasks[("other", "A")] == (["R2"], 1, 10, 0)


def test_surveys(spark):
    c = components(spark)
    assert {r["name"]: r.set for r in audit.environment(c, ["KEY"]).collect()} == {"KEY": True, "URL": False}
    assert [tuple(r) for r in audit.scoped_tests(c, ["auth", "web"], ["ui"]).collect()] == [("t2", ["KEY", "URL"])]
    assert {r.tag: r.components for r in audit.tag_groups(c).collect()} == {"core": ["auth", "web"], "ui": ["web"]}
    assert {r.tag: r["index"] for r in audit.tag_index(c).collect()} == {"core": 0, "ui": 1}


def test_code(spark):
    src = "/**\n * Adds.\n */\nexport function add(a: { x: number }, b = '{'): number {\n  return 1;\n}"
    lines = src.split("\n")
    assert code.signature(lines, 3) == "export function add(a: { x: number }, b = '{'): number" and code.doc_comment(lines, 3) == "Adds."
    f = spark.createDataFrame([("a.ts", src)], "file string, content string")
    s = spark.createDataFrame([("a.ts", "add", 4)], "file string, name string, line int")
    assert code.described(s, f).first().doc == "Adds."
    t = spark.createDataFrame([("import { A, type B as C } from './x';\nlet y: Promise<A> = new D();",)], "d string")
    got = t.select(code.type_names(F.col("d")).alias("n"), code.imported_types(F.col("d")).alias("m"), code.line_of(F.col("d"), F.lit(40)).alias("l"), code.offset_of(F.col("d"), F.lit(1), F.lit(4)).alias("o")).first()
    assert sorted(got.n) == ["A", "D"] and got.m == {"C": "./x"} and (got.l, got.o) == (2, 42)
    d = spark.createDataFrame([("f", 0, 1, 2, 3, 0), ("f", 1, 0, 5, 1, 0), ("f", 2, 2, 1, 4, 0)], "file string, seq int, d_line int, d_char int, length int, kind int")
    assert [(r.line, r.character) for r in code.editor_tokens(d).orderBy("seq").collect()] == [(1, 2), (1, 7), (3, 1)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b|c", None)], "k string, v int")
    assert [r.value for r in sinks.as_markdown(rows, "k").collect()] == ["| k | v |", "|---|---|", "| a | 1 |", "| b\\|c |  |"]
    for _ in range(2):
        sinks.append_new(rows, str(tmp_path / "t"), "k")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    meta = spark.createDataFrame([("snapshot_sha", "x"), ("snapshot_time", "5")], "key string, value string")
    assert tuple(sinks.latest_meta(meta).first()) == ("x", 5) and tuple(sinks.latest_meta(meta.limit(1)).first()) == (None, None)
    assert sinks.due_snapshot(spark.range(10).select(F.col("id").alias("timestamp")), 4, 5) and not sinks.due_snapshot(spark.range(10).select(F.col("id").alias("timestamp")), 5, 5)


def test_small_functions(spark):
    from weftline.sources import manifests, symbols
    from weftline.streaming import incremental

    k = spark.createDataFrame([(1,), (12,), (26,), (0,), (99,)], "k int").select(code.kind_name(F.col("k")).alias("n")).collect()
    assert [r.n for r in k] == ["file", "function", "type", "unknown", "unknown"]
    dts = "import { A } from './a';\nexport interface I {\n  x: number;\n}\nexport declare function f(\n  a: A,\n): void;\nexport const c = 1;\nexport const enum E { X }\nexport type T = string;"
    assert code.declarations_of(dts, ["interface"]).split("\n")[1:] == ["export interface I {", "  x: number;", "}"]
    assert code.declarations_of(dts, ["function"]).split("\n")[1:] == ["export declare function f(", "  a: A,", "): void;"]
    assert code.declarations_of(dts, ["enum"]).split("\n")[1:] == ["export const enum E { X }"] and code.declarations_of(dts, ["const"]).split("\n")[1:] == ["export const c = 1;"]
    b = spark.createDataFrame([(5.0, 10.0), (0.0, 0.0)], "v double, m double").select(code.bar(F.col("v"), F.col("m")).alias("b"), code.trend_label(F.lit("increasing")).alias("t")).collect()
    assert b[0].b.count("█") == 5 and len(b[1].b) == 10 and b[0].t.endswith("(increasing)")
    imp = spark.createDataFrame([("a.ts", "#shared/x/y.js"), ("a.ts", "#one"), ("a.ts", "./z")], "file string, specifier string")
    got = {r.specifier: r.alias_path for r in symbols.resolved_aliases(imp, [("#shared/*", "./src/shared/*"), ("#one", "lib/one.ts")]).collect()}
    assert got == {"#shared/x/y.js": "src/shared/x/y.js", "#one": "lib/one.ts", "./z": None}
    rs = spark.createDataFrame([(f,) for f in ("src/a.rs", "src/b/mod.rs", "src/b/c.rs", "src/b/d/e.rs")], "file string")
    use = spark.createDataFrame([("src/b/c.rs", "crate::a::Item"), ("src/b/c.rs", "self::d::e"), ("src/b/d/e.rs", "super::c"), ("src/b/d/e.rs", "super::super::b"), ("src/a.rs", "std::io")], "file string, specifier string")
    got = {r.specifier: r.resolved_path for r in symbols.resolved_rust(use, rs).collect()}
    assert got == {"crate::a::Item": "src/a.rs", "self::d::e": "src/b/d/e.rs", "super::c": "src/b/c.rs", "super::super::b": "src/b/mod.rs", "std::io": None}
    assert manifests.read_suppressions("suppressions:\n- rule: B-1\n  glob: test/**\n- x: 1\n")[0]["glob"] == "test/**"
    done = incremental.run_jobs([lambda: 1, lambda: 1 / 0, lambda: 3], 2)
    assert [d[0] for d in done] == [1, None, 3] and isinstance(done[1][1], ZeroDivisionError)
