"""Steps that grew faster than their input, or with the fixed number of shuffle partitions, on small tables."""

from collections import Counter

from pyspark.sql import functions as F

from weftline import catalog
from weftline.operators import cochange, findings, graph, schedule, sized, textindex
from weftline.sources import symbols
from weftline.sources.store import Store
from weftline.streaming.changes import ChangeIndex

TASK = "id long, ord int, reads array<string>, writes array<string>, mutexes array<string>"


def test_pairs_of_one_component_are_spread(spark, monkeypatch):
    monkeypatch.setattr(schedule, "TILE", 16, raising=False)
    monkeypatch.setattr(schedule, "PAIRS", 500, raising=False)
    ids = range(120)
    tasks = spark.createDataFrame([(i, i, ["c"] if i % 3 else [], ["c"] if i % 2 else [], []) for i in ids], TASK)
    got = schedule.hazards(tasks).withColumn("part", F.spark_partition_id()).collect()
    want = {("RAW", i, j) for i in ids for j in ids if i % 2 and j % 3 and i != j}
    want |= {("WAW", i, j) for i in ids for j in ids if i % 2 and j % 2 and i < j}
    want |= {("WAR", i, j) for i in ids for j in ids if i % 3 and not i % 2 and j % 2}
    assert sorted((r.type, r.source, r.target) for r in got) == sorted(want)
    assert max(Counter(r.part for r in got).values()) < len(want) / 4


def test_hazards_of_repeated_and_null_ids(spark):
    tasks = spark.createDataFrame([(1, 0, ["c"], ["c"], []), (1, 5, ["c"], [], []), (2, 3, [], ["c"], ["m"]), (2, 3, [], ["c"], ["m"]), (None, 4, ["c"], ["c"], []), (3, None, ["c"], ["c"], ["m"])], TASK)
    got = [(r.type, r.source, r.target) for r in schedule.hazards(tasks).collect()]
    want = [("RAW", 1, 1), ("RAW", 1, None), ("RAW", 2, 1), ("RAW", 2, None), ("RAW", None, 1)]
    want += [("WAW", 1, 2), ("WAW", 1, None), ("WAW", 2, None), ("WAR", None, 1), ("WAR", None, 2)]
    assert Counter(got) == Counter(want)


def test_write_conflicts_are_counted_not_met(spark, monkeypatch):
    rows = [(1, 2, [], ["a"], []), (2, 2, [], ["a"], []), (3, 1, [], ["a", "b"], []), (4, 7, ["a"], ["b"], []), (5, 9, [], ["a"], []), (5, 3, [], ["a"], [])]
    want = Counter((i, c) for i, o, _, ws, _ in {(i, o, (), tuple(w), ()) for i, o, _, w, _ in rows[:5]} for c in ws for j, p, _, vs, _ in rows[:5] if c in vs and o < p)
    met = [(r.source, r.name) for r in schedule.hazards(spark.createDataFrame(rows[:5], TASK)).filter("type = 'WAW'").collect()]
    twice = Counter((r.source, r.name) for r in schedule.hazards(spark.createDataFrame(rows, TASK)).filter("type = 'WAW'").collect())
    assert Counter(met) == want
    monkeypatch.setattr(schedule, "hazards", lambda tasks: (_ for _ in ()).throw(AssertionError("all pairs")))
    components = spark.createDataFrame([("a", []), ("b", [])], "name string, deps array<string>")
    for some, expected in ((rows[:5], want), (rows, twice)):
        got = schedule.plan_issues(spark.createDataFrame(some, TASK), components).filter("issue = 'write_conflict'")
        assert Counter((r.id, r.name) for r in got.collect()) == expected


def test_rounds_over_a_graph_send_no_table_to_the_driver(spark, tmp_path, monkeypatch):
    spark.range(1, 3001).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    plans, made, kept = [], graph.written, graph.checkpoint

    def seen(how):
        def look(df):
            out = how(df)
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return out

        return look

    monkeypatch.setattr(graph, "written", seen(made))
    monkeypatch.setattr(graph, "checkpoint", seen(kept))
    assert [tuple(r) for r in catalog.queries()["chain_length"](spark, str(tmp_path)).collect()] == [(1000, 3000)]
    assert sum("SortMergeJoin" in p for p in plans) > 20
    assert not [p for p in plans if "BroadcastHashJoin" in p]


def test_postings_shuffle_texts_and_merge_arrays(spark, tmp_path):
    docs = spark.createDataFrame([(d, f"a b a w{d} " + "b " * (d % 3)) for d in range(3000)], "doc long, text string")
    rows = textindex.postings(docs)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")  # words are made after the shuffle
    store = Store(spark, str(tmp_path / "s"))
    textindex.define(store, buckets=4)
    for part in (0, 1):
        with store.begin() as tx:
            tx.append("postings", textindex.postings(docs.filter(F.col("doc") % 2 == part)), spread=False)
    store.merge("postings", 1, textindex.merged)
    key = lambda r: (r.term, r.block)
    assert sorted(store.read("postings").collect(), key=key) == sorted(rows.collect(), key=key)
    held = spark.createDataFrame([("a", 0, [1], [2])], textindex.POSTINGS)
    assert "Generate" not in textindex.merged(held)._jdf.queryExecution().executedPlan().toString()


def test_pairs_and_groups_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(sized, "ROWS", 100)
    monkeypatch.setattr(sized.dealt, "__kwdefaults__", {"each": 100})
    rows = spark.createDataFrame([(g, i) for g in range(400) for i in range(g % 7, g % 7 + 5)], "g int, i int")
    got = cochange.edges(rows, "g", "i")
    assert got.rdd.getNumPartitions() == 2 * rows.count() // 100
    assert got.agg(F.sum("n")).first()[0] == 400 * 10


def test_jaccard_lift_shuffles_pairs_once(spark):
    links = spark.createDataFrame([(g, i) for g in range(40) for i in range(12) if (g * 7 + i * 5) % 4 == 0] + [(None, 3), (1, None), (0, 0), (0, 0), (2, 50)], "g int, i int")
    owner = spark.createDataFrame([(i, f"o{i % 3}" if i != 5 else None) for i in range(12)], "item int, component string")
    near = cochange.jaccard_neighbours(links, owner.select(F.col("item").alias("target")), "g", "i").filter("jaccard >= 0.3")
    own = {r.item: r.component for r in owner.collect()}
    want = {}
    for r in near.collect():
        if own.get(r.target) and own.get(r.other) and own[r.target] != own[r.other]:
            n, best = want.get((own[r.target], own[r.other]), (0, 0))
            want[own[r.target], own[r.other]] = n + 1, max(best, r.jaccard)
    got = cochange.jaccard_lift(links, owner, "g", "i", 0.3)
    assert want and {(r.src, r.dst): (r.n, r.jaccard) for r in got.collect()} == want


def test_drift_streams_its_groups(spark):
    kind = "rule_id string, file string, ord long, start_line int, end_line int, severity string, confidence double"
    old = spark.createDataFrame([("r", f"f{k // 2}", k, 1, None if k % 2 else 4, "low", 0.5) for k in range(60)] + [(None, "f0", 99, 1, 2, "low", 0.5)], kind)
    new = spark.createDataFrame([("r", f"f{k // 2}", k, 1, 1, "low" if k % 3 else "high", 0.5) for k in range(10, 70)] + [(None, "f0", 99, 2, 2, "low", 0.7)], kind)
    got = findings.drift(old, new)
    assert "CoGroup" not in got._jdf.queryExecution().executedPlan().toString()
    rows = Counter((r.rule_id, r.status, r.before, r.after) for r in got.collect())
    high = sum(k % 3 == 0 for k in range(10, 60))
    assert rows == {("r", "changed", "low", "high"): high, ("r", "stable", "low", "low"): 50 - high, ("r", "resolved", "low", None): 10, ("r", "new", None, "high"): 4, ("r", "new", None, "low"): 6, (None, "changed", "low", "low"): 1}


def test_few_names_of_much_text_are_spread(spark):
    rows = spark.range(0, 200, 1, 1).select(F.concat("id", F.lit(".ts")).alias("file"), F.lit("export const a = 1;\n").alias("content"))
    parsed = symbols.nested_symbols(rows)
    assert parsed.count() == 200 and parsed.rdd.getNumPartitions() > 1


def test_orders_of_changes_are_dealt_once(spark, tmp_path, monkeypatch):
    spark.range(40).selectExpr("id as o_orderkey", "id % 7 as o_custkey", "timestamp_seconds(820000000 + id * 40000) as o_orderdate", "'1-URGENT' as o_orderpriority").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(200).selectExpr("id % 40 as l_orderkey", "id % 23 as l_partkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    plans, index = [], ChangeIndex.index

    def look(self, rows, *rest):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return index(self, rows, *rest)

    monkeypatch.setattr(ChangeIndex, "index", look)
    got = catalog.queries()["indexed_changes"](spark, str(tmp_path)).collect()
    assert {r.path: r.links for r in got} == {f"lib/m{p % 7}/p{p}": len({i % 40 for i in range(200) if i % 23 == p}) for p in range(23)}
    assert [p.count("Exchange hashpartitioning(l_orderkey") for p in plans] == [1, 1]
