"""Registered queries over all their rows, against brute force without the bounds that their SQL twins keep."""

import os

import pytest
from pyspark.sql import functions as F

from weftline import catalog
from weftline.operators import graph, schedule

DATA = "/root/testdata/sf0.001"

tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def closure(pairs, root):
    """Least depth of all that leads to root over (src, dst) pairs."""
    depth, front = {root: 0}, [root]
    while front:
        front = sorted({s for s, d in pairs if d in front} - set(depth))
        depth |= {n: max(depth.values()) + 1 for n in front}
    return depth


@tables
def test_dependents(spark):
    pairs = [(x, y) for x in range(25) for y in range(x + 1, 25) if (5 * x + 3 * y) % 7 == 0]
    want = closure(pairs, 20)
    assert want[4] == 5
    assert {r.node: r.depth for r in catalog.queries()["dependents"](spark, DATA).collect()} == want


def test_deep_graphs(spark):
    chain = spark.range(24).select(F.col("id").cast("string").alias("src"), (F.col("id") + 1).cast("string").alias("dst"))
    seeds = spark.createDataFrame([("0",)], "node string")
    assert {int(r.node): r.depth for r in graph.reachable(chain, seeds).collect()} == {i: i for i in range(25)}
    assert graph.reachable(chain, seeds, 3).count() == 4
    imports = chain.select(F.col("dst").alias("path"), F.col("src").alias("resolved_path"), F.lit("x").alias("imported_name"), (F.col("dst") != "24").alias("is_re_export"))
    assert {r.path: r.barrel for r in graph.importers(imports, "0").collect()} == {"1": False, "24": True}


@tables
def test_jaccard_lift(spark):
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{DATA}/{name}.parquet").select(*c).collect()]
    brand, orders, items = dict(read("part", "p_partkey", "p_brand")), {}, {}
    for g, i in read("lineitem", "l_orderkey", "l_partkey"):
        orders.setdefault(i, set()).add(g)
        items.setdefault(g, set()).add(i)
    want = {}
    for i, mine in orders.items():
        for j in {k for g in mine for k in items[g]} - {i}:
            both = len(mine & orders[j])
            jaccard = both / (len(mine) + len(orders[j]) - both)
            if jaccard >= 0.015 and brand[i] != brand[j]:
                n, most = want.get((brand[i], brand[j]), (0, 0.0))
                want[brand[i], brand[j]] = (n + 1, max(most, jaccard))
    got = {(r.src, r.dst): (r.n, r.jaccard) for r in catalog.queries()["jaccard_lift"](spark, DATA).collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()}
    assert all(abs(got[k][1] - most) < 1e-8 for k, (_, most) in want.items())


@pytest.fixture(scope="module")
def suppliers(spark, tmp_path_factory):
    """A folder with 60 suppliers, and (id, written, read, locked) of each."""
    folder = tmp_path_factory.mktemp("suppliers")
    rows = [(i, i * 7 % 23 if i < 60 else 24) for i in range(1, 61)]  # the last one alone in its nation
    spark.createDataFrame(rows, "s_suppkey int, s_nationkey int").write.parquet(str(folder / "supplier.parquet"))
    return str(folder), [(i, f"c{i % 12}", f"c{(i * 5 + 1) % 12}", f"n{m}") for i, m in rows]


def test_hazards(spark, suppliers):
    folder, tasks = suppliers
    want = set()
    for i, w, r, m in tasks:
        for j, w2, r2, m2 in tasks:
            if i != j:
                want |= {("RAW", i, j, w)} if w == r2 else set()
                want |= {("WAR", i, j, r)} if r == w2 and w != r else set()
                want |= {("WAW", i, j, w)} if w == w2 and i < j else set()
                want |= {("MUTEX", i, j, m)} if m == m2 and i < j else set()
    got = [tuple(r) for r in catalog.queries()["hazards"](spark, folder).collect()]
    assert sorted(got) == sorted(want)


def test_plan_issues(spark, suppliers):
    folder, tasks = suppliers
    want = [("unknown_component", i, c) for i, w, r, _ in tasks for c in (w, r) if int(c[1:]) > 8]
    want += [("write_conflict", i, w) for i, w, *_ in tasks for j, w2, *_ in tasks if i < j and w == w2]
    locked = [m for *_, m in tasks]
    want += [("lone_mutex", i, m) for i, *_, m in tasks if locked.count(m) == 1]
    got = [tuple(r) for r in catalog.queries()["plan_issues"](spark, folder).collect()]
    assert ("lone_mutex", 60, "n24") in want
    assert sorted(got) == sorted(want)


def test_critical_path_is_whole(spark):
    kind = "id long, ord long, reads array<string>, writes array<string>, mutexes array<string>"
    chain = spark.createDataFrame([(i, i, [f"c{i - 1}"], [f"c{i}"], []) for i in range(7)], kind)
    assert schedule.critical_path(chain).first().path == list(range(7))
    assert schedule.critical_path(chain, 6).first().path == list(range(7))
    with pytest.raises(ValueError):
        schedule.critical_path(chain, 5)
    cycle = spark.createDataFrame([(0, 0, ["b"], ["a"], []), (1, 1, ["a"], ["b"], [])], kind)
    with pytest.raises(ValueError):
        schedule.critical_path(cycle)
