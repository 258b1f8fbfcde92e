from weftline.sources import commits, files, manifests, symbols

LOG = """---COMMIT---
aaa
Ann
100
feat(auth): add login

tags: +auth

---FILES---
A\tsrc/a.ts
D\told.ts
R100\tx.ts\ty.ts
---COMMIT---
bbb
Bob
200
fix: it

---FILES---
M\tsrc/a.ts
"""


def test_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text(LOG)
    rows = commits.parse_records(commits.read_log(spark, str(tmp_path / "log.txt"))).orderBy("sha").collect()
    a, b = rows
    assert (a.sha, a.author, a.timestamp, a.subject, a.body.strip()) == ("aaa", "Ann", 100, "feat(auth): add login", "tags: +auth")
    assert (a.files, a.deleted_files, b.files, b.deleted_files) == (["src/a.ts", "y.ts"], ["old.ts", "x.ts"], ["src/a.ts"], [])


def test_numstat(spark):
    raw = "a" * 40 + "\nsubject\n\n3\t1\tsrc/a.ts\n-\t-\timg.png"
    got = commits.parse_numstat(spark.createDataFrame([(raw,)], "value string")).collect()
    assert [tuple(r) for r in got] == [("a" * 40, "src/a.ts", 3, 1)]
    one = commits.parse_name_only(spark.createDataFrame([("abc\nfix\n\nx.ts\ny.ts",)], "value string")).first()
    assert tuple(one) == ("abc", "fix", ["x.ts", "y.ts"])


def test_manifest(spark):
    text = "version: 1\nauth:\n  path: ./src/auth\n  tags: [security]\nweb:\n  paths: [src/web, src/ui]\n  deps: [auth]\n"
    got = {r["name"]: (r.path, r.deps, r.tags) for r in manifests.read_manifest(spark, text).collect()}
    assert got == {"auth": (["src/auth"], [], ["security"]), "web": (["src/web", "src/ui"], ["auth"], [])}


PLAN = """<plan><metadata><feature>f</feature><created>2026</created></metadata><tasks>
<task id="1"><description>d</description><action>a</action><values>x, y</values><touches reads="auth, api" writes="web"/><mutexes>m</mutexes></task>
<task id="2"><description>e</description><action>b</action><values>z</values><touches writes="auth"/></task></tasks></plan>"""
RUN = """<log><session started="s" mode="sequential"/><tasks><task id="1" status="COMPLETE"><metrics tokens="5" minutes="2"/><files_modified><file>a</file><file>b</file></files_modified>
<postconditions><check id="p" result="pass"/><check id="q" result="fail"/></postconditions></task><task id="2" status="PARTIAL"/></tasks></log>"""


def test_plan_and_run(spark):
    t = manifests.parse_plans(spark.createDataFrame([(PLAN,)], "xml string")).orderBy("ord").collect()
    assert (t[0].id, t[0].values, t[0].reads, t[0].writes, t[0].mutexes) == ("1", ["x", "y"], ["auth", "api"], ["web"], ["m"])
    assert (t[1].reads, t[1].writes, t[1].mutexes) == ([], ["auth"], [])
    r = manifests.parse_execution_logs(spark.createDataFrame([(RUN,)], "xml string")).orderBy("id").collect()
    assert (r[0].tokens, r[0].tools, r[0].files, r[0].passed, r[0].failed) == (5, 0, ["a", "b"], 1, 1)
    assert (r[1].status, r[1].tokens, r[1].files) == ("PARTIAL", 0, [])


RULES = """---
framework: "OWASP"
languages: [ts, go]
---
# Title
## Access
### B-1: First rule
**Severity:** Critical
**Applies to:** API routes, HTTP handlers
**What to look for:**
- one
- two
**Guidance:** do it
### B-2: Second
**Applies to:**
## Other
### C-1: Third
"""


def test_rules(spark):
    rows = spark.createDataFrame([(RULES,)], "text string")
    got = {r.id: r for r in manifests.parse_rulesets(rows).collect()}
    assert set(got) == {"B-1", "B-2", "C-1"} and got["C-1"].category == "Other" and got["B-2"].severity == "Medium"
    assert (got["B-1"].severity, got["B-1"].applies_to, got["B-1"].what_to_look_for, got["B-1"].guidance) == ("Critical", ["API routes", "HTTP handlers"], ["one", "two"], "do it")
    assert rows.select(manifests.front_matter(rows.text).alias("m")).first().m["framework"] == "OWASP"


def test_responses(spark):
    good = 'Here:\n```json\n{"findings": [{"rule_id": "R", "severity": "warning", "title": "t", "confidence": 0, "location": [{"path": "a.ts", "line": 4}]}]}\n```'
    rows = spark.createDataFrame([("1", good), ("2", "no json"), ("3", '{"findings": []}')], "task_id string, raw string")
    got = {r.task_id: r for r in manifests.parse_responses(rows).collect()}
    assert set(got) == {"1", "2"} and got["2"].rule_id == "PARSE-ERROR" and got["2"].confidence == 0
    assert (got["1"].rule_id, got["1"].severity, got["1"].confidence, got["1"].locations[0].file, got["1"].locations[0].start_line) == ("R", "medium", 0.5, "a.ts", 4)


def test_compiler_messages(spark):
    line = '{"reason": "compiler-message", "message": {"level": "error", "message": "m", "code": {"code": "E1"}, "spans": [{"file_name": "a.rs", "line_start": 3, "column_start": 7}]}}'
    rows = spark.createDataFrame([(line,), (line.replace('"error"', '"note"'),), ("junk",)], "value string")
    assert [tuple(r) for r in manifests.parse_compiler_messages(rows).collect()] == [("a.rs", 3, 7, "error", "m", "E1")]


def test_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.ts").write_text("one\nTODO two\n")
    (tmp_path / "src/b.py").write_text("x = 1  # TODO")
    (tmp_path / "node_modules/c.ts").write_text("TODO")
    (tmp_path / "src/bin.ts").write_bytes(b"a\0b")
    rows = files.source_files(spark, str(tmp_path))
    assert sorted((r.file, r.language) for r in rows.collect()) == [("src/a.ts", "typescript"), ("src/b.py", "python")]
    assert [(r.file, r.n) for r in files.search(rows, "TODO").collect()] == [("src/a.ts", 2), ("src/b.py", 1)]
    cut = files.listing(files.scan(spark, str(tmp_path)), ["src/*"], most=2).collect()
    assert [(r.file, r.truncated) for r in cut] == [("src/a.ts", True), ("src/b.py", True)]


A = """import { used as u, type T } from "./b";
import * as all from './c.js';
import def from "pkg";
// import { no } from "./no";
export function run(x: number) { return { a: 1 }; }
export default class Main {}
const hidden = 1;
"""
RS = "pub use crate::a::{b, c::{d, self}, e as f};\npub fn go() {}\nstruct S;\n"


def test_symbols_and_imports(spark):
    src = spark.createDataFrame([("src/a.ts", A), ("src/b.ts", "export const used = 1;\nexport type T = string;"), ("src/c/index.ts", 'export * from "../b";\nexport { used } from "../b";'), ("x.rs", RS), ("x.txt", "fn no() {}")], "file string, content string")
    got = {(r.file, r.name): (r.kind, r.exported, r.line) for r in symbols.symbols(src).collect()}
    assert got[("src/a.ts", "run")] == ("function", True, 5) and got[("src/a.ts", "hidden")] == ("const", False, 7) and got[("x.rs", "go")] == ("function", True, 2)
    imp = {(r.file, r.specifier): (r.imported_names, r.is_re_export) for r in symbols.imports(src).collect()}
    assert imp[("src/a.ts", "./b")] == (["used", "T"], False) and imp[("src/a.ts", "./c.js")] == (["*"], False) and imp[("src/a.ts", "pkg")] == (["default"], False)
    assert {s for f, s in imp if f == "x.rs"} == {"crate::a::b", "crate::a::c::d", "crate::a::c", "crate::a::e"} and imp[("x.rs", "crate::a::b")][1]
    res = {(r.file, r.specifier): r.resolved_path for r in symbols.resolved(symbols.imports(src), src).collect()}
    assert res[("src/a.ts", "./b")] == "src/b.ts" and res[("src/a.ts", "./c.js")] == "src/c/index.ts" and res[("src/a.ts", "pkg")] is None
    ex = {(r.file, r.exported_name): r.is_barrel for r in symbols.exports(src).collect()}
    assert ex[("src/a.ts", "default")] is False and ex[("src/c/index.ts", "used")] is True and ("src/b.ts", "T") in ex
