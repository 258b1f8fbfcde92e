from pyspark.sql import functions as F

from weftline.operators import budget, findings, freshness, suggest

FOUND = "task_id string, ord int, rule_id string, severity string, title string, confidence double, locations array<struct<file: string, start_line: int, end_line: int>>"


def dedup(spark, *rows):
    data = [(t, i, "R", s, "x", c, [("f", a, b)]) for i, (t, s, c, a, b) in enumerate(rows)]
    return [(r.severity, r.tasks, round(r.confidence, 6), r.members) for r in findings.deduplicate(spark.createDataFrame(data, FOUND)).collect()]


def test_deduplicate(spark):
    assert dedup(spark, ("scan-1", "high", 0.8, 5, None), ("scan-2", "critical", 0.9, 5, 5)) == [("critical", 2, 1.0, 2)]
    assert dedup(spark, ("1", "high", 0.7, 1, 2), ("2", "high", 0.7, 2, 3), ("3", "high", 0.7, 1, 1)) == [("high", 3, 0.9, 3)]
    assert len(dedup(spark, ("1", "high", 0.7, 1, 2), ("1", "high", 0.7, 5, 6))) == 2


def test_overlap_pairs(spark):
    rows = spark.createDataFrame([("r", 1, 10, 20), ("r", 2, 15, 25), ("r", 3, 21, 22), ("s", 4, 10, 20), ("r", 5, 0, 1000)], "k string, id int, s int, e int")
    got = {(r.left_id, r.right_id) for r in findings.overlap_pairs(rows, ["k"], "s", "e", "id", 7).collect()}
    assert got == {(1, 2), (2, 3), (1, 5), (2, 5), (3, 5)}


def test_summary(spark):
    rows = spark.createDataFrame([(s,) for s in ("critical", "critical", "high", "medium", "low", "informational")], "severity string")
    assert tuple(findings.severity_summary(rows).first()) == (2, 1, 1, 1, 1, 6)


def test_suppression(spark):
    rows = spark.createDataFrame([("B-1", "api/x.ts", 10), ("B-1", "test/deep/y.ts", 3), ("B-2", "z.ts", 10)], "rule_id string, file string, start_line int")
    files = spark.createDataFrame([("z.ts", "\n" * 8 + '// audit-suppress B-2 "Inline reason"\ncode'), ("api/x.ts", "\n" * 9 + "// audit-suppress B-1")], "file string, content string")
    rules = [{"rule": "B-1", "file": "api/x.ts", "reason": "Handled by gateway"}, {"rule": "B-1", "glob": "test/**", "reason": "Test file"}]
    got = {r.file: r.reason for r in findings.suppressed(rows, rules, findings.inline_suppressions(files)).collect()}
    assert got == {"api/x.ts": "Handled by gateway", "test/deep/y.ts": "Test file", "z.ts": "Inline reason"}


DRIFT = "rule_id string, file string, ord int, start_line int, end_line int, severity string, confidence double"


def drift(spark, old, new):
    one = lambda rows: spark.createDataFrame([(r, "f", i, a, b, s, c) for i, (r, a, b, s, c) in enumerate(rows)], DRIFT)
    got = findings.drift(one(old), one(new))
    return sorted(r.status for r in got.collect()), findings.trend(got).first().trend


def test_drift(spark):
    a = ("A", 10, 15, "high", 0.7)
    assert drift(spark, [a], [a]) == (["stable"], "stable")
    assert drift(spark, [], [a]) == (["new"], "regressing")
    assert drift(spark, [a], []) == (["resolved"], "improving")
    assert drift(spark, [a], [("A", 12, 17, "critical", 0.7)]) == (["changed"], "stable")
    assert drift(spark, [a], [("A", 100, 105, "high", 0.7)]) == (["new", "resolved"], "stable")


def test_rules_for_components(spark):
    comps = spark.createDataFrame([("auth", ["Security"]), ("web", ["ui"])], "name string, tags array<string>")
    rules = spark.createDataFrame([("r1", ["security checks"]), ("r2", []), ("r3", ["db"])], "id string, applies_to array<string>")
    assert {tuple(r) for r in findings.rules_for_components(comps, rules).collect()} == {("auth", "r1"), ("auth", "r2"), ("web", "r2")}


def chunks(spark, tokens, most):
    rows = spark.createDataFrame([("k", i, t) for i, t in enumerate(tokens)], "k string, i int, t long")
    return [(r.tokens, r.chunk) for r in budget.token_chunks(rows, "k", ["i"], "t", most).orderBy("i").collect()]


def test_chunks(spark):
    assert chunks(spark, [100, 100], 10000) == [(100, 0), (100, 0)]
    assert chunks(spark, [5000, 5000], 8000) == [(5000, 0), (5000, 1)]
    assert chunks(spark, [15000], 10000) == [(9000, 0)]
    assert chunks(spark, [3000, 3000, 3000], 6000) == [(3000, 0), (3000, 1), (3000, 2)]
    assert chunks(spark, [10, 15000, 10], 10000) == [(10, 0), (9000, 1), (10, 2)]


def test_budget_skips_and_goes_on(spark):
    rows = spark.createDataFrame([("k", i, t) for i, t in enumerate((50, 60, 40, 10))], "k string, i int, t long")
    assert [r.admitted for r in budget.admitted(rows, "k", ["i"], "t", 100).orderBy("i").collect()] == [True, False, True, True]


def test_freshness(spark):
    rows = spark.createDataFrame([("a", 10000, 5000, None), ("b", 10001, 5000, None), ("c", 10000, None, None), ("d", 10001, 5000, 9000), ("e", None, 5000, None)], "n string, s long, d long, k long")
    got = {r.n: r.x for r in rows.select("n", freshness.stale(F.col("s"), F.col("d"), F.col("k")).alias("x")).collect()}
    assert got == {"a": False, "b": True, "c": True, "d": False, "e": True}


def test_suggestions(spark):
    names = ["packages/core/src/a.ts", "shop/src/x.ts", "controllers/user.controller.ts", "services/user.service.ts", "services/only.ts", "billing/controllers/a.ts", "billing/models/b.ts"]
    files = spark.createDataFrame([(n,) for n in names], "file string")
    got = {r["name"]: r.paths for r in suggest.suggest(files).collect()}
    assert got == {"core": ["packages/core"], "shop": ["shop"], "user": ["controllers", "services"], "billing": ["billing/controllers", "billing/models"]}


def test_no_findings(spark):
    assert findings.deduplicate(spark.createDataFrame([], FOUND)).collect() == []
    assert findings.drift(spark.createDataFrame([], DRIFT), spark.createDataFrame([], DRIFT)).collect() == []
    assert budget.token_chunks(spark.createDataFrame([], "k string, i int, t long"), "k", ["i"], "t", 10).collect() == []
