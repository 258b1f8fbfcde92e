import pytest
from pyspark.sql import functions as F

from weftline.operators import diffs, graph, schedule

EDGE = "src string, dst string"


def edges(spark, *pairs):
    return spark.createDataFrame([tuple(p) for p in pairs], EDGE)


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def reached(spark, deps, *seeds):
    """deps: (component, dependency) pairs."""
    rows = graph.reachable(graph.reversed_edges(edges(spark, *deps)), nodes(spark, *seeds))
    return {r.node for r in rows.collect()}


def test_invalidation_cascade(spark):
    assert reached(spark, [("api", "auth"), ("web", "api")], "auth") == {"auth", "api", "web"}
    assert reached(spark, [("api", "core"), ("auth", "core"), ("web", "api"), ("web", "auth")], "core") == {"api", "auth", "core", "web"}
    assert reached(spark, [("api", "auth"), ("cache", "db")], "auth", "db") == {"api", "auth", "cache", "db"}
    assert reached(spark, [("a", "b"), ("b", "a")], "a") == {"a", "b"}


def test_cycles(spark):
    left = lambda *p: {r.node for r in graph.cyclic_nodes(edges(spark, *p)).collect()}
    assert left(("a", "b"), ("b", "c")) == set()
    assert left(("a", "b"), ("b", "a")) == {"a", "b"}
    assert left(("b", "a"), ("b", "c"), ("c", "b")) == {"a", "b", "c"}  # a is downstream of the cycle


TASK = "id string, ord int, reads array<string>, writes array<string>, mutexes array<string>"


def tasks(spark, *rows):
    return spark.createDataFrame([(i, k, list(r), list(w), list(m)) for k, (i, r, w, m) in enumerate(rows)], TASK)


def found(spark, *rows):
    return sorted((r.type, r.source, r.target, r.name) for r in schedule.hazards(tasks(spark, *rows)).collect())


def test_hazards(spark):
    assert found(spark, ("1", [], ["auth"], []), ("2", ["auth"], [], [])) == [("RAW", "1", "2", "auth"), ("WAR", "2", "1", "auth")]
    assert found(spark, ("1", ["auth"], [], []), ("2", [], ["auth"], [])) == [("RAW", "2", "1", "auth"), ("WAR", "1", "2", "auth")]
    assert found(spark, ("1", [], ["a"], []), ("2", [], ["a"], [])) == [("WAW", "1", "2", "a")]
    assert found(spark, ("1", [], [], ["m", "n"]), ("2", [], [], ["m", "n"])) == [("MUTEX", "1", "2", "m"), ("MUTEX", "1", "2", "n")]


def test_waves(spark):
    waves = lambda *rows: {r.id: r.wave for r in schedule.waves(tasks(spark, *rows)).collect()}
    diamond = waves(("1", [], ["core"], []), ("2", ["core"], ["auth"], []), ("3", ["core"], ["api"], []), ("4", ["auth", "api"], [], []))
    assert diamond == {"1": 0, "2": 1, "3": 1, "4": 2}
    assert waves(("1", [], [], ["m"]), ("2", [], [], ["m"])) == {"1": 0, "2": 1}
    with pytest.raises(ValueError):
        schedule.waves(tasks(spark, ("1", ["a"], ["a"], []), ("2", ["a"], ["a"], [])), max_waves=5)


def test_critical_path(spark):
    rows = tasks(spark, ("1", [], ["a"], []), ("2", ["a"], ["b"], []), ("3", ["b"], [], []), ("4", ["a"], [], []))
    assert schedule.critical_path(rows).first().path == ["1", "2", "3"]


def test_restart(spark):
    kind = TASK + ", state string"
    rows = spark.createDataFrame([("f", 0, [], ["a"], [], "failed"), ("x", 1, ["a"], [], [], "dispatched"), ("y", 2, ["b"], [], [], "completed")], kind)
    assert schedule.restart_strategy(rows, "f").first() == ("cascade_restart", ["x"])
    done = rows.withColumn("state", F.when(F.col("id") == "x", "completed").otherwise(F.col("state")))
    assert schedule.restart_strategy(done, "f").first() == ("escalate", ["x"])
    assert schedule.restart_strategy(rows, "y").first() == ("isolated_retry", [])


IMPORTS = "path string, resolved_path string, imported_name string, is_re_export boolean"


def test_importers(spark):
    who = lambda target, *rows: {r.path: (r.direct, r.barrel) for r in graph.importers(spark.createDataFrame([(a, b, "x", c) for a, b, c in rows], IMPORTS), target).collect()}
    assert who("b", ("a", "b", False), ("c", "b", False)) == {"a": (True, False), "c": (True, False)}
    got = who("session", ("index", "session", True), ("app", "index", False), ("cli", "session", False))
    assert got == {"index": (True, False), "cli": (True, False), "app": (False, True)}
    assert who("none", ("a", "b", False)) == {}
    assert set(who("s", ("b1", "s", True), ("b2", "b1", True), ("app", "b2", False))) == {"b1", "app"}


def test_unused_exports(spark):
    ex = spark.createDataFrame([("a", "used", False), ("a", "unused", False), ("b", "x", False), ("index", "used", True)], "path string, exported_name string, is_barrel boolean")
    im = spark.createDataFrame([("b", "a", "used", False)], IMPORTS)
    assert sorted(tuple(r) for r in graph.unused_exports(ex, im).collect()) == [("a", "unused"), ("b", "x")]
    star = spark.createDataFrame([("b", "a", "*", False)], IMPORTS)
    assert [tuple(r) for r in graph.unused_exports(ex, star).collect()] == [("b", "x")]


def test_diffs(spark):
    kind = "id string, text string, k int"
    rows = diffs.table_diff(spark.createDataFrame([("1", "a", 1), ("2", "b", None), ("3", "c", 3)], kind), spark.createDataFrame([("2", "b", None), ("3", "d", 4), ("4", "e", 5)], kind), ["id"], ["text", "k"])
    assert {r.id: (r.status, r.fields) for r in rows.collect()} == {"1": ("removed", []), "2": ("same", []), "3": ("modified", ["text", "k"]), "4": ("added", [])}
    got = diffs.edge_diff(edges(spark, ("a", "b"), ("a", "c")), edges(spark, ("a", "b"), ("b", "c")))
    assert {tuple(r) for r in got.collect()} == {("b", "c", "missing"), ("a", "c", "extra")}


def test_deps_by_name_or_tag(spark):
    kind = "name string, deps array<string>, tags array<string>"
    rows = spark.createDataFrame([("a", ["core", "b"], ["web"]), ("b", ["web"], ["core"]), ("c", [], ["core"])], kind)
    assert {tuple(r) for r in diffs.resolved_deps(rows).collect()} == {("a", "b"), ("a", "c"), ("b", "a")}
    with pytest.raises(Exception, match="unknown dependency"):
        diffs.resolved_deps(spark.createDataFrame([("a", ["nope"], [])], kind)).collect()


def plain_depths(edges):
    """Longest path to each node, or None for those that a cycle leads to."""
    nodes = {x for e in edges for x in e}
    deep, left = {}, set(nodes)
    while True:
        free = {n for n in left if not any(d == n and s in left for s, d in edges)}
        if not free:
            return {n: deep.get(n) for n in nodes}
        for n in free:
            deep[n] = max([deep[s] + 1 for s, d in edges if d == n], default=0)
        left -= free


def test_contraction_against_peeling(spark, monkeypatch):
    import random

    rng = random.Random(4)
    monkeypatch.setattr(graph, "SHALLOW", 2)
    for trial in range(2):
        n = 5
        edges = {(rng.randint(0, n), rng.randint(0, n)) for _ in range(n + 2)}
        if trial % 2:
            edges = {(min(e), max(e)) for e in edges if e[0] != e[1]}
        edges |= {(100, 101), (101, 102)}
        rows = spark.createDataFrame(list(edges), "src int, dst int")
        want = plain_depths(edges)
        assert {r.node for r in graph.cyclic_nodes(rows).collect()} == {k for k, d in want.items() if d is None}
        if None not in want.values():
            assert {r.node: r.depth for r in graph.longest_paths(rows).collect()} == want
            paths = [[n] for n in want]
            best = []
            while paths:
                best, paths = min(paths), [[*p, d] for p in paths for s, d in edges if s == p[-1]]
            assert graph.critical_path(rows).first()["path"] == best
        else:
            with pytest.raises(ValueError, match="cycle"):
                graph.longest_paths(rows)


def test_a_chain_of_ten_thousand_takes_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "SHALLOW", 2)
    rounds, plain = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df: rounds.append(1) or plain(df))
    chain = spark.range(10_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    deep = graph.longest_paths(chain)
    assert len(rounds) < 26  # fourteen to double pointers, the others once each
    assert deep.filter("node <> depth").count() == 0 and deep.count() == 10_001
    assert graph.critical_path(chain.filter("src < 20")).first()["path"] == list(range(21))
    assert graph.longest_paths(chain.limit(0)).count() == 0 and graph.critical_path(chain.limit(0)).first()["path"] is None
