"""The store's transactions, the inverted index and the index of changes that uses both."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.operators import textindex
from weftline.sources import store
from weftline.streaming.changes import ChangeIndex


def test_null_keys_and_emptied_parts(spark, tmp_path):
    table = store.KeyedTable(spark, str(tmp_path / "t"), "path string, tag string, n int", ["path", "tag"], buckets=3)
    rows = lambda *r: spark.createDataFrame(list(r), "path string, tag string, n int")
    got = lambda: sorted((tuple(r) for r in table.read().collect()), key=str)
    for _ in range(2):
        table.insert_absent(rows((None, "x", 1), ("a", None, 2), (None, None, 3), ("a", "x", None)))
    assert got() == sorted([(None, "x", 1), ("a", None, 2), (None, None, 3), ("a", "x", None)], key=str)
    table.upsert(rows((None, "x", 9)))
    table.rewrite(["path"], rows(("b", "y", 5)), parts=rows(("a", "", 0), ("b", "", 0)).select("path"))
    assert got() == sorted([(None, "x", 9), (None, None, 3), ("b", "y", 5)], key=str)
    table.mark(rows((None, "x", 0)).select("path", "tag"), "n", 7)
    assert (None, "x", 7) in got()
    table.rewrite(["path"], rows(), parts=rows((None, "", 0)).select("path"))
    assert got() == [("b", "y", 5)]


def two_tables(spark, path):
    s = store.Store(spark, path)
    s.define("one", "k int, v string", ["k"], 4)
    s.define("two", "k int, v string", ["k"], 4)
    return s


def test_a_transaction_is_seen_whole_or_not_at_all(spark, tmp_path):
    s = two_tables(spark, str(tmp_path / "s"))
    rows = lambda v, *ks: spark.createDataFrame([(k, v) for k in ks], "k int, v string")
    seen = lambda v=None: [sorted(tuple(r) for r in s.read(t, v).collect()) for t in ("one", "two")]
    with s.begin(0) as tx:
        tx.upsert("one", rows("a", 1, 2))
        tx.upsert("two", rows("a", 1))
    first = seen()
    with pytest.raises(RuntimeError), s.begin(1) as tx:  # killed between two tables
        tx.upsert("one", rows("b", 1))
        tx.delete("one", rows("", 2))
        assert sorted(tuple(r) for r in tx.read("one").collect()) == [(1, "b")]
        raise RuntimeError
    assert seen() == first == [[(1, "a"), (2, "a")], [(1, "a")]]
    for _ in range(2):  # the batch again, and once more
        with s.begin(1) as tx:
            tx.upsert("one", rows("b", 1))
            tx.append("two", rows("b", 7))
    assert seen() == [[(1, "b"), (2, "a")], [(1, "a"), (7, "b")]] and s.versions() == [1, 2]
    assert seen(1) == first
    late = s.begin()
    with s.begin() as tx:
        tx.delete("one", rows("", 1))
    with pytest.raises(FileExistsError):
        late.commit()
    s.rebucket("one", 9)
    s.merge("two", 0)
    assert seen() == [[(2, "a")], [(1, "a"), (7, "b")]]
    s.vacuum(1)
    assert seen() == [[(2, "a")], [(1, "a"), (7, "b")]] and len(s.versions()) == 1
    left = {p.parent.parent.name for p in (tmp_path / "s" / "two").rglob("*.parquet")}
    assert len(left) == 1  # old folders are gone


WORDS = "the quick brown fox jumps over lazy dog rare".split()


def plain(texts, terms, phrase):
    out = set()
    for d, t in texts:
        w = [x for x in re.split("[^a-z0-9]+", (t or "").lower()) if x]
        hit = any(w[i : i + len(terms)] == terms for i in range(len(w))) if phrase else set(terms) <= set(w)
        if terms and hit:
            out.add(d)
    return out


def test_inverted_index_against_texts(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "i"))
    textindex.define(s, buckets=8)
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choices(WORDS, [9, 5, 5, 5, 3, 3, 3, 3, 0.1], k=rng.randint(0, 12)))) for i in range(3000)]
    texts += [(3000, None), (3001, ""), (3002, "The--QUICK, the quick"), (5_000_000_000, "the fox"), (3003, "the " * 30_000)]
    for part in range(3):
        with s.begin(part) as tx:
            tx.append("postings", textindex.postings(spark.createDataFrame(texts[part::3], "doc long, text string")))

    def check():
        for terms in (["the"], ["the", "quick"], ["rare", "the", "fox"], ["the", "the"], ["quick", "the", "quick"], ["nope", "the"], ["fox", "jumps", "over"], []):
            assert {r.doc for r in textindex.match_all(s, terms).collect()} == plain(texts, terms, False), terms
            assert {r.doc for r in textindex.match_phrase(s, terms).collect()} == plain(texts, terms, True), terms
        n = textindex.frequency(s, ["rare", "the"]).collect()
        assert {r.term: r.texts for r in n} == {t: len(plain(texts, [t], False)) for t in ("rare", "the")}

    check()
    s.merge("postings", 1, textindex.merged)
    assert all(len(f) == 1 for f in s.manifest()["tables"]["postings"]["folders"].values())
    assert s.read("postings").groupBy("term", "block").count().filter("count > 1").count() == 0
    check()
    assert s.read("postings").agg(F.max(F.size(F.array_distinct("docs"))).alias("n")).first()["n"] <= 1024  # a hot term is many rows


def test_a_search_opens_only_its_buckets(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "i"))
    textindex.define(s, buckets=64)
    with s.begin() as tx:
        tx.append("postings", textindex.postings(spark.createDataFrame([(i, f"word{i} common") for i in range(500)], "doc long, text string")))
    files = textindex.of_terms(s, ["common", "word7"]).inputFiles()
    assert 0 < len({f.split("key_bucket=")[1].split("/")[0] for f in files}) <= 2
    assert [r.doc for r in textindex.match_all(s, ["common", "word7"]).collect()] == [7]


def commit(sha, time, subject="feat: x", body="", files=(), gone=()):
    return sha, "ann", time, subject, body, list(files), list(gone)


SCHEMA = "sha string, author string, timestamp long, subject string, body string, files array<string>, deleted_files array<string>"


def state(index):
    return {t: sorted((tuple(r) for r in index.read(t).select(*c).collect()), key=str) for t, c in {"commits": ["sha", "conv_type"], "links": ["path", "sha"], "artifacts": ["path", "alive"], "tags": ["path", "tag"]}.items()}


BATCHES = [
    [commit("s1", 1, "feat(core): add parser", "tags: +fast, slow", ["lib/a.ts", "lib/sub/b.ts"]), commit("s2", 2, "fix: parser bug", "", ["lib/a.ts", "x.lock"])],
    [commit("s3", 3, "drop the parser", "Tags: -slow", ["lib/sub/b.ts"], ["lib/a.ts"]), commit("s2", 2, "fix: parser bug", "", ["lib/a.ts"])],
    [commit("s4", 4, "feat: parser again", "tags: -sub", ["lib/a.ts", "lib/sub/b.ts"])],
]


def test_index_follows_batches(spark, tmp_path):
    index = ChangeIndex(spark, str(tmp_path / "i"), exclude=["**/*.lock", "*.lock"], buckets=4)
    counts = [index.index(spark.createDataFrame(b, SCHEMA), n) for n, b in enumerate(BATCHES)]
    assert counts == [{"commits": 2, "indexed": 3, "deleted": 0}, {"commits": 1, "indexed": 1, "deleted": 1}, {"commits": 1, "indexed": 2, "deleted": 0}]
    now = state(index)
    assert now["artifacts"] == [("lib/a.ts", True), ("lib/sub/b.ts", True)]
    assert now["links"] == sorted([("lib/a.ts", "s1"), ("lib/a.ts", "s2"), ("lib/a.ts", "s3"), ("lib/a.ts", "s4"), ("lib/sub/b.ts", "s1"), ("lib/sub/b.ts", "s3"), ("lib/sub/b.ts", "s4")])
    assert ("lib/sub/b.ts", "fast") in now["tags"] and ("lib/sub/b.ts", "slow") not in now["tags"] and ("lib/sub/b.ts", "sub") not in now["tags"] and ("lib/a.ts", "slow") in now["tags"]
    assert index.index(spark.createDataFrame(BATCHES[2], SCHEMA), 2)["commits"] == 0 and state(index) == now
    assert [r.sha for r in index.search("the PARSER and").collect()] == ["s3"]
    assert [r.sha for r in index.search("parser").collect()] == ["s4", "s3", "s2", "s1"]
    assert [r.sha for r in index.search("parser", ["fast"], 2).collect()] == ["s4", "s3"]
    assert index.search("parser", ["none"]).count() == 0 and index.search("!!").count() == 0
    index.merge(1)
    assert [r.sha for r in index.search("parser").collect()] == ["s4", "s3", "s2", "s1"]
    whole = [c for b in BATCHES for c in b]
    again = ChangeIndex(spark, str(tmp_path / "again"), exclude=["**/*.lock", "*.lock"], buckets=4)
    again.rebuild(spark.createDataFrame(whole, SCHEMA))
    assert state(again) == now
    again.rebuild(spark.createDataFrame(BATCHES[0], SCHEMA))
    assert [s for s, _ in state(again)["commits"]] == ["s1", "s2"]


def test_index_survives_a_crash_and_goes_back(spark, tmp_path, monkeypatch):
    index = ChangeIndex(spark, str(tmp_path / "i"), buckets=2)
    index.index(spark.createDataFrame(BATCHES[0], SCHEMA), 0)
    assert not index.snapshot_due(3) and index.snapshot_due(2) and not index.snapshot_due(0)
    index.snapshot()
    before = state(index)
    with monkeypatch.context() as m:
        m.setattr(ChangeIndex, "_tags", lambda *a: 1 / 0)  # after commits, words, links and liveness were written
        with pytest.raises(ZeroDivisionError):
            index.index(spark.createDataFrame(BATCHES[1], SCHEMA), 1)
    assert state(index) == before and [r.sha for r in index.search("parser").collect()] == ["s2", "s1"]
    index.index(spark.createDataFrame(BATCHES[1], SCHEMA), 1)
    assert state(index) != before
    index.restore()
    assert state(index) == before


def test_index_follows_a_log(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    record = lambda sha, t, *entries: f"---COMMIT---\n{sha}\nann\n{t}\nfeat: word{t}\n\n---FILES---\n" + "\n".join(entries) + "\n"
    (log / "1").write_text(record("s1", 1, "A\ta") + record("s2", 2, "A\tb"))
    index = ChangeIndex(spark, str(tmp_path / "i"), buckets=2)
    index.follow(str(log), str(tmp_path / "done"))
    with (log / "1").open("a") as f:
        f.write(record("s3", 3, "R100\ta\tc"))
    index.follow(str(log), str(tmp_path / "done"))
    index.follow(str(log), str(tmp_path / "done"))
    assert state(index)["artifacts"] == [("a", False), ("b", True), ("c", True)]
    assert [r.sha for r in index.search("word3").collect()] == ["s3"] and index.store.meta()["last_sha"] == "s3"
