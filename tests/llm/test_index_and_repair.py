"""Cuckoo-filter index, bit-sliced search and conversation repair against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest

from weftline.llm import exact, ranked, repair

DOCS = "doc_id long, text string, row_no string, op string, n string, shard string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "s") for i, t in rows], DOCS)


def weak():
    """A digest of one of three values, so that different texts meet in one bucket."""

    class Weak:
        def __init__(self, raw):
            self.raw = raw

        def digest(self):
            return bytes([len(self.raw) % 3]) * 32

        def hexdigest(self):
            return hashlib.sha256(self.raw).hexdigest()

    return Weak


def test_cuckoo_filter_against_a_set():
    rng = random.Random(1)
    shard, live = exact.Shard(exact.CuckooFilter(2)), set()
    for step in range(6000):
        key = hashlib.sha256(str(rng.randint(0, 1500)).encode()).digest()
        if rng.random() < 0.6:
            shard.insert(key, b"t", 1, step, 1)
            live.add(key)
        else:
            assert (shard.delete(key, b"t") is not None) == (key in live)
            live.discard(key)
        if step % 500 == 0:
            assert all(k in shard.filter for k in live) and set(shard.contents) == live
    assert 4 * (shard.filter.mask + 1) >= len(live)  # it grew from eight slots, from the stored keys
    strange = sum(hashlib.sha256(b"?%d" % i).digest() in shard.filter for i in range(20_000))
    assert strange < 20_000 * 8 * 2 / 65_536 * 2  # fingerprints of 16 bits
    again = exact.CuckooFilter.from_bytes(shard.filter.to_bytes())
    assert all(k in again for k in live)


TEXTS = [None, "", " ", "A b", "a B", "a b", "É", "é", "x" * 300_000, "X" * 300_000, "long " * 40_000, "a\nb", "a b "]


def plain_groups(rows):
    low = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    of = {}
    for i, t in rows:
        of.setdefault(low(t), []).append(i)
    order = lambda i: (i is not None, i if i is not None else 0)
    out = []
    for t, ids in of.items():
        keep, sha = max(ids, key=order), hashlib.sha256(t.encode()).hexdigest()
        kept = False
        for i in sorted(ids, key=order, reverse=True):
            out.append((i, keep, len(ids), not kept, sha))
            kept = True
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [hashlib.sha256, weak()])
def test_exact_groups_against_brute_force(spark, digest):
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(rng.randint(0, 40), rng.choice(TEXTS[:8])) for _ in range(200)] + [(None, "a b"), (None, "lone"), (None, "lone"), (7, "É"), (7, "É")]
    got = exact.exact_groups(docs(spark, rows).repartition(5), digest=digest, shards=3)
    assert sorted((tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str) == plain_groups(rows)
    assert exact.exact_groups(docs(spark, [])).count() == 0


def test_a_text_in_a_third_of_all_rows_is_one_row_a_task(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(3000)]
    scanned = exact.scanned(docs(spark, rows).repartition(6))
    assert scanned.filter("n is not null").count() <= 2000 + 6
    assert exact.exact_groups(docs(spark, rows)).filter("kept").count() == 2001


def test_drop_copies_keeps_columns_and_one_row(spark):
    rows = [(1, "A"), (2, "a"), (2, "a"), (None, None), (3, ""), (None, "q")]
    got = exact.drop_copies(docs(spark, rows))
    assert got.columns == DOCS.replace(" string", "").replace(" long", "").split(", ")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(2, "a"), (3, ""), (None, "q")], key=str)


def test_index_inserts_looks_up_and_deletes(spark, tmp_path):
    index = exact.CuckooIndex(spark, str(tmp_path / "index"), shards=4)
    answers = lambda df: {r.doc_id: (r.known, r.keep_id, r.group_size) for r in df.collect()}
    assert answers(index.lookup(docs(spark, [(1, "a")]))) == {1: (False, None, None)}
    first = answers(index.insert(docs(spark, [(i, f"t{i % 50}") for i in range(100)])))
    assert all(first[i] == (False, 50 + i % 50, 2) for i in range(100))
    assert answers(index.insert(docs(spark, [(200, "T7"), (201, "new")]))) == {200: (True, 200, 3), 201: (False, 201, 1)}
    assert answers(index.delete(docs(spark, [(900, "t7"), (901, "never")]))) == {900: (True, 200, 3), 901: (False, None, None)}
    assert answers(index.lookup(docs(spark, [(1, "t7"), (2, "t8"), (3, "NEW")]))) == {1: (False, None, None), 2: (True, 58, 2), 3: (True, 201, 1)}
    (tmp_path / "index" / "version=9").mkdir()  # a version without its marker does not count
    assert index.live().filter("digest is not null").count() == 50
    assert answers(index.insert(docs(spark, [(5, "t7")])))[5] == (False, 5, 1)


# bit-sliced search


def plain_rank(documents, items, k=10):
    split = lambda t: re.findall(ranked.TERM, (t or "").translate({c: c + 32 for c in range(65, 91)}))
    tfs = [(d, Counter(split(t))) for d, t in documents]
    tfs = [(d, c) for d, c in tfs if c]
    n_docs, total = len(tfs), sum(c.total() for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in tfs:
            m = 10 + (90 * c.total() * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(split(text)) if t in c)
            scores.append((-s, d is None, d))
        best = sorted((x for x in scores if x[0] < 0), key=lambda x: (x[0], x[1], x[2] or 0))[:k]
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(best, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("few,size", [(200_000, 16_384), (0, 7)])
def test_search_against_brute_force(spark, monkeypatch, few, size):
    monkeypatch.setattr(ranked, "FEW_TERMS", few)
    monkeypatch.setattr(ranked, "SHARD_DOCS", size)
    monkeypatch.setattr(ranked, "BLOCK_ITEMS", 2)
    rng = random.Random(3)
    words = ["a", "B", "éa", "x1", "漢字", "c-d", "e.f", "rare", "zz"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(120)]
    rows += [(500 + i, "same words here") for i in range(15)] + [(500, "same words here"), (None, "same words here"), (600, None), (601, ""), (602, "  .,! "), (603, "a " * 60_000)]
    items = [(1, "a b rare"), (2, "same A HERE 漢字"), (3, None), (4, ""), (5, "none of these"), (None, "words"), (2, "same A HERE 漢字"), (6, " ".join(words))]
    asked = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, item string")
    got = ranked.rank(docs(spark, rows).repartition(4), asked)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == plain_rank(rows, items)
    assert ranked.rank(docs(spark, []), asked).count() == 0
    assert ranked.rank(docs(spark, rows), asked.limit(0)).count() == 0


def test_bitmap_arithmetic():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (1, 63, 64, 200):
        numbers = [rng.integers(0, 1 << 20, n) for _ in range(30)]
        sliced = lambda x: ranked.pack(np.array([(x >> b) & 1 for b in range(20)], np.uint8))
        total = ranked.Sliced(-(-n // 64))
        for k, x in enumerate(numbers):
            total.add(ranked.Sliced.product(sliced(x), 997 * k + 1))
        want = sum(x * (997 * k + 1) for k, x in enumerate(numbers))
        slices = total.slices()
        assert (ranked.values(slices, np.arange(n)) == want).all()
        want[: n // 2] = want[0]  # ties: the first places win
        slices = ranked.pack(np.array([(want >> b) & 1 for b in range(48)], np.uint8))
        assert sorted(ranked.top(slices, n, 10).tolist()) == sorted(sorted(range(n), key=lambda i: (-want[i], i))[:10])


# repair


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if f:
            text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
            out += [(conv, turn, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    return out


def plain_repair(rows):
    """Cheapest edits by trying all, fewest costs first: labels, and the repaired rows."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        said = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    full = {"u": "user", "a": "assistant"}
    best = {}

    def go(i, roles, labels, cost, kept, inserted):
        if cost > best.get("cost", 3 * len(rows)) or not re.fullmatch("(s?(ua)*u?)?", roles):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles) and (cost, labels) < (best.get("cost", 10**9), best.get("labels", "")):
            best.update(cost=cost, labels=labels, kept=kept)
        if inserted < 3:
            for r in full:
                go(i, roles + r, labels + "I", cost + 2, [*kept, f"{full[r]}:"], inserted + 1)
        if i < len(rows):
            _, _, role, text = rows[i]
            more = faults[i] == "truncated"
            go(i + 1, roles, labels + "D", cost + 3, kept, 0)
            if faults[i] not in ("blank", "duplicate"):
                go(i + 1, roles + (role[:1] or "?"), labels + "K", cost + more, [*kept, f"{role}:{text}"], 0)
                for r in full:
                    go(i + 1, roles + r, labels + "R", cost + 2 + more, [*kept, f"{full[r]}:{text}"], 0)

    go(0, "", "", 0, [], 0)
    initials = [r[2][:1] for r in rows]
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return gaps, *counts, sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), best["cost"], best["labels"], hashlib.sha256("\n".join(best["kept"]).encode()).hexdigest()


def plain_result(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = plain_damage([r for r in rows if r[0] == conv])
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        out.append((conv, *plain_repair(own)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [0, 1, 12])
def test_repair_against_all_edits(spark, bits):
    rng = random.Random(11)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(1, 6)):
            role = rng.choices(["user", "assistant", "system", "tool", "", None], [8, 8, 2, 1, 1, 1])[0]
            text = rng.choices(["Yes.", "No!", "cut", "", " \t", None, f"Turn {turn}.", "é?  "], [2, 2, 2, 1, 1, 1, 6, 2])[0]
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, text))
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, pos string, seg string").repartition(5)
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = sorted((tuple(r) for r in repair.repaired_digests(table, bits).select(columns).collect()), key=str)
    assert got == plain_result(rows)
    assert repair.repaired_digests(table.limit(0)).count() == 0


def test_repair_of_one_conversation_with_most_rows(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Row {t} says it." if t % 7 else "again.") for t in range(4000)] + [(c, 0, "user", "Hi.") for c in range(2, 30)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    small = {r.conv_id: tuple(r) for r in repair.repaired_digests(table, 5).collect()}
    whole = {r.conv_id: tuple(r) for r in repair.repaired_digests(table, 20).collect()}
    assert small == whole and len(small[1][7]) > 3000


def test_repaired_rows_follow_the_grammar(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "More."), (2, 0, "system", "Be kind."), (2, 1, "assistant", "Yes.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    fixed, of = repair.repair(table)
    said = {}
    for r in fixed.orderBy("conv_id", "pos", "nth").collect():
        said.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    assert said[2] == [("K", "system", "Be kind."), ("I", "user", ""), ("K", "assistant", "Yes.")]
    assert "".join(r[0] for _, r, _ in said[1]) == "ua"
    assert {r.conv_id: r.audit for r in of.collect()} == {1: "KDR", 2: "KIK"}


def test_costs_tie_to_the_least_labels():
    whole = repair.Composed()
    symbols = [i * 4 + f for i, f in itertools.product(range(4), range(4))]
    rng = random.Random(2)
    for _ in range(300):
        codes = bytes(rng.choices(symbols, k=rng.randint(0, 40)))
        labels, state = whole.labels(codes, whole.finish(), 0, True)
        assert state in repair.ACCEPT and sum(x != "I" for x in labels) == len(codes)
