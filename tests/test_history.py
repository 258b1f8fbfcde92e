from pyspark.sql import functions as F

from weftline.functions import paths, text
from weftline.operators import cochange, coupling, index
from weftline.streaming import incremental

COMMITS = "sha string, subject string, files array<string>"


def commits(spark, *files, subjects=None):
    return spark.createDataFrame([(str(i), (subjects or {}).get(i, "feat: x"), list(f)) for i, f in enumerate(files)], COMMITS)


def edges(spark, *files, **how):
    rows = cochange.edges(cochange.links_of(commits(spark, *files)), "sha", "file", **how)
    return {(r.a, r.b): (r.weight, r.n) for r in rows.collect()}


def test_edges(spark):
    assert edges(spark, "abc") == {("a", "b"): (0.5, 1), ("a", "c"): (0.5, 1), ("b", "c"): (0.5, 1)}
    assert edges(spark, "xy", "xy") == {("x", "y"): (2.0, 2)}
    assert edges(spark, "za", "x") == {("a", "z"): (1.0, 1)}
    assert edges(spark, "abc", "ab", "cd") == {("a", "b"): (1.5, 2), ("a", "c"): (0.5, 1), ("b", "c"): (0.5, 1), ("c", "d"): (1.0, 1)}
    assert edges(spark, "abcd", max_items=3) == {}


def test_edges_with_weights(spark):
    weights = spark.createDataFrame([("0", 1.0), ("1", 0.2)], "g string, m double")
    assert edges(spark, "ab", "ac", weights=weights) == {("a", "b"): (1.0, 1), ("a", "c"): (0.2, 1)}


def test_filters(spark):
    rows = commits(spark, "a", "b", [f"f{i}" for i in range(60)], subjects={1: "chore: x", 2: "refactor"})
    assert [r.sha for r in cochange.filter_commits(rows).collect()] == ["0"]
    rows = commits(spark, ["src/a.ts", "x/y/bun.lock", "bun.lock", "types.d.ts"])
    assert cochange.filter_paths(rows).first().files == ["src/a.ts"]


def test_frequencies_and_hotspots(spark):
    rows = cochange.frequencies(cochange.links_of(commits(spark, "ab", "ac")), "sha", "file")
    assert {r["item"]: r.n for r in rows.collect()} == {"a": 2, "b": 1, "c": 1}
    f = spark.createDataFrame([("a", 10), ("b", 5), ("c", 20), ("d", 9)], "item string, n long")
    s = spark.createDataFrame([("a", 100), ("b", 500), ("c", 10), ("d", 0)], "item string, size long")
    assert [(r["item"], r.score) for r in coupling.hotspots(f, s).orderBy(F.desc("score")).collect()] == [("b", 2500), ("a", 1000), ("c", 200)]


def test_jaccard(spark):
    rows = commits(spark, ["login", "session"], ["login", "routes"], ["session", "routes"], ["alone"])
    targets = spark.createDataFrame([("login",), ("alone",)], "target string")
    got = cochange.jaccard_neighbours(cochange.links_of(rows), targets, "sha", "file").collect()
    assert {(r.target, r.other): (r.shared, round(r.jaccard, 6)) for r in got} == {("login", "session"): (1, 0.333333), ("login", "routes"): (1, 0.333333)}


def test_trend(spark):
    rows = [("up", i, v) for i, v in enumerate((1, 1, 15, 20))] + [("down", i, v) for i, v in enumerate((8, 10, -8, -10))] + [("one", 0, 50)]
    got = coupling.half_trend(spark.createDataFrame(rows, "item string, k int, v int"), "item", "v", "k").collect()
    assert {r["item"]: (r.direction, r.magnitude) for r in got} == {"up": ("increasing", 16.5), "down": ("decreasing", 18.0), "one": ("stable", 0.0)}


def test_matrix(spark):
    s = spark.createDataFrame([("api", "db", 3.0)], "a string, b string, structural double")
    b = spark.createDataFrame([("auth", "db", 5.0), ("api", "db", 0.5)], "a string, b string, behavioral double")
    got = {(r.a, r.b): r.classification for r in coupling.coupling_matrix(s, b).collect()}
    assert got == {("auth", "db"): "hidden_coupling", ("api", "db"): "stable_interface"}
    got = {(r.a, r.b): r.classification for r in coupling.coupling_matrix(s, b, 1, 0.1).collect()}
    assert got[("api", "db")] == "explicit_module"
    empty = coupling.coupling_matrix(s.limit(0), b).collect()
    assert {r.classification for r in empty} == {"explicit_module", "stable_interface"}  # no positive value: threshold 0


def test_neighbourhood(spark):
    e = spark.createDataFrame([("a", "b", 1.5, 3), ("a", "c", 0.5, 1), ("b", "c", 2.0, 4)], "a string, b string, weight double, n long")
    rows = coupling.neighbourhood(cochange.both_ways(e).filter("item = 'a'"), line=1.0).orderBy(F.desc("weight")).collect()
    assert [(r.neighbour, r.n, r.tier) for r in rows] == [("b", 3, "direct"), ("c", 1, "moderate")]
    imp = spark.createDataFrame([("a", "z")], "item string, neighbour string")
    assert {r.neighbour: r.tier for r in coupling.neighbourhood(cochange.both_ways(e).filter("item = 'a'"), imp, 1.0).collect()}["z"] == "structural"


def test_tags(spark):
    rows = spark.createDataFrame([("src/auth/session/handler.ts",), ("src/lib/auth/handler.ts",), ("lib/helpers/format.ts",), ("README.md",)], "p string")
    assert [r.t for r in rows.select(paths.path_tags(F.col("p")).alias("t")).collect()] == [["auth", "session"], ["auth"], [], []]
    one = spark.createDataFrame([("x\nTags: +session, -auth, redis",), ("none",)], "b string").select(text.tag_operations(F.col("b")).alias("t")).collect()
    assert [tuple(x) for x in one[0].t] == [("session", "add"), ("auth", "remove"), ("redis", "add")] and one[1].t is None
    s = spark.createDataFrame([("feat(auth): add login",), ("fix: correct typo",), ("Update readme",), ("feat(api)!: remove endpoint",)], "s string")
    got = s.select(text.conventional_type(F.col("s")).alias("t"), text.conventional_scope(F.col("s")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("feat", "auth"), ("fix", None), (None, None), ("feat", "api")]


def test_replay_and_all_tags(spark):
    ops = spark.createDataFrame([(1, "auth", "add", 1), (1, "redis", "add", 2), (1, "auth", "remove", 3), (1, "session", "add", 4)], "item int, tag string, op string, k int")
    assert {r.tag for r in index.replay(ops, ["item", "tag"], "op", "k").collect()} == {"redis", "session"}
    tags = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a")], "item int, tag string")
    assert [tuple(r) for r in index.with_all_tags(tags, ["a", "b"]).collect()] == [(1, "a,b,c")]


def test_owner_is_longest_prefix(spark):
    files = spark.createDataFrame([("src/auth/x.ts",), ("src/auth/deep/y.ts",), ("src/authority.ts",), ("other.ts",)], "file string")
    comps = spark.createDataFrame([("auth", "src/auth"), ("deep", "src/auth/deep/"), ("src", "src")], "name string, path string")
    assert {r.file: r.component for r in paths.owners(files, comps).collect()} == {"src/auth/x.ts": "auth", "src/auth/deep/y.ts": "deep", "src/authority.ts": "src"}
    assert paths.owners(files, comps, every=True).count() == 6


def test_text_functions(spark):
    t = spark.createDataFrame([("[a](./x.md#y) [b](https://z) [c](#d) [e](../f.md)", "src/./a/../b/c.ts")], "m string, p string")
    got = t.select(text.markdown_links(F.col("m")).alias("l"), paths.normalised(F.col("p")).alias("n"), text.line_count(F.lit("a\nb\n")).alias("k"), text.estimate_tokens(F.lit("abcde")).alias("e"), text.severity(F.lit(" Info ")).alias("s")).first()
    assert [x.target for x in got.l] == ["./x.md#y", "../f.md"] and (got.n, got.k, got.e, got.s) == ("src/b/c.ts", 3, 2, "informational")


def test_merge_is_additive(spark):
    kind = "a string, b string, weight double, n long"
    old, new = spark.createDataFrame([("a", "b", 1.0, 2)], kind), spark.createDataFrame([("a", "b", 0.5, 1), ("c", "d", 2.0, 1)], kind)
    assert {(r.a, r.b): (r.weight, r.n) for r in cochange.merge_edges(old, new).collect()} == {("a", "b"): (1.5, 3), ("c", "d"): (2.0, 1)}


def test_stream_equals_batch(spark, tmp_path):
    src, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    all_files = [["a", "b", "c"], ["a", "b"], ["c", "d"], ["b", "c"]]
    for i in (0, 2):
        part = spark.createDataFrame([(str(k), "feat", all_files[k]) for k in (i, i + 1)], COMMITS)
        part.coalesce(1).write.mode("append").json(str(src))
        incremental.maintain(spark, str(src), COMMITS, str(out), str(mark))
    got, seen = incremental.current(spark, str(out))
    whole = cochange.edges(cochange.links_of(commits(spark, *all_files)), "sha", "file")
    assert {(r.a, r.b): (r.weight, r.n) for r in got.collect()} == {(r.a, r.b): (r.weight, r.n) for r in whole.collect()}
    assert {r["item"]: r.n for r in seen.collect()} == {"a": 2, "b": 3, "c": 3, "d": 1}
