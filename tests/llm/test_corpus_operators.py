"""Near duplicates, substrings, mixing, neighbours and classifiers against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import ann, langid, mixing, simhash, substring, toxicity
from weftline.llm.common import held_out, n_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, row_key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, "c", "k") for i, t, s in rows], DOCS)


def near_texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))) for _ in range(60)]
    rows = [*base, None, "", "", "\t \n", "One", "ONE", "a b c", "a b c d"]
    for t in base[:20]:
        words = t.split()
        for _ in range(4):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            rows.append(" ".join(copy))
        rows.append(t.upper())
    return rows


def brute_components(fp, radius):
    ids = sorted(fp)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark):
    import xxhash

    texts = near_texts()
    fp = {}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        grams = [" ".join(words[j : j + 4]) for j in range(max(1, len(words) - 3))] if words else []
        count = [0] * 64
        for g in grams:
            h = xxhash.xxh64_intdigest(g.encode(), 42)
            for b in range(64):
                count[b] += h >> b & 1
        fp[i] = sum(1 << b for b in range(64) if 2 * count[b] > len(grams))
    rows = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = simhash.near_duplicates(rows, width=4, n_words=1, n_bands=5, radius=4, distinct=False)
    want = brute_components(fp, 4)
    assert {r.doc_id: (r.f0 & (2**64 - 1), r.component_id) for r in got.collect()} == {i: (fp[i], want[i]) for i in fp}
    assert simhash.near_duplicates(rows.limit(0)).collect() == []


@pytest.mark.parametrize("n_bands,shard_rows", [(8, 100_000), (None, 30)])
def test_blocks_and_split_shards_lose_no_link(spark, monkeypatch, n_bands, shard_rows):
    monkeypatch.setattr(simhash, "SHARD_ROWS", shard_rows)
    rows = docs(spark, [(i, t, "s") for i, t in enumerate(near_texts())])
    got = {r.doc_id: (r.f0 & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(rows, n_bands=n_bands).collect()}
    want = brute_components({i: f for i, (f, _) in got.items()}, 4)
    assert {i: c for i, (_, c) in got.items()} == want


def test_too_few_blocks_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.near_duplicates(docs(spark, [(1, "a", "s")]), n_bands=4)


def test_gray_index_lists_pairs_between_labels():
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2**63, size=(30, 2), dtype=np.uint64)[rng.integers(0, 30, 500)]
    bits ^= np.uint64(1) << rng.integers(0, 63, bits.shape).astype(np.uint64)
    group, labels = np.sort(rng.integers(0, 3, 500)), rng.integers(0, 3, 500)
    order = np.lexsort((*[simhash.gray_rank(bits[:, k]) for k in range(2)][::-1], group))
    bits = np.ascontiguousarray(bits[order])
    got = {(int(x), int(y)) for a, b in simhash.GrayIndex(group, bits).pairs(4, labels) for x, y in zip(a, b)}
    a, b = np.triu_indices(500, 1)
    ok = (np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1) <= 4) & (group[a] == group[b]) & (labels[a] != labels[b])
    assert got == set(zip(a[ok].tolist(), b[ok].tolist())) and len(got) > 100


@pytest.mark.parametrize("n,words,radius", [(400, 1, 6), (3000, 1, 3), (300, 4, 30)])
def test_gray_index_finds_every_link(n, words, radius):
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 2**63, size=(n // 20, words), dtype=np.uint64)
    bits = centres[rng.integers(0, len(centres), n)].copy()
    for _ in range(radius):
        at = rng.integers(0, 64, n)
        bits[np.arange(n), rng.integers(0, words, n)] ^= np.where(rng.random(n) < 0.6, np.uint64(1) << at.astype(np.uint64), np.uint64(0))
    group = np.sort(rng.integers(0, 3, n))
    order = np.lexsort((*[simhash.gray_rank(bits[:, k]) for k in range(words)][::-1], group))
    bits = np.ascontiguousarray(bits[order])
    labels = simhash.GrayIndex(group, bits).components(radius)
    want = np.arange(n)
    a, b = np.triu_indices(n, 1)
    link = (np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1) <= radius) & (group[a] == group[b])
    want = simhash.unite(want, a[link], b[link])
    assert (labels == want).all()


def test_one_of_each_group_stays(spark, monkeypatch):
    rng = random.Random(8)
    long = [" ".join(rng.choices([f"v{i}" for i in range(5000)], k=300)) for _ in range(30)]
    near = [t.replace(t.split()[150], "swapped", 1) for t in long[:10]]
    rows = docs(spark, [(i, t, "s") for i, t in enumerate([*long, *near, *long[:5]])] + [(3, long[3], "s"), (None, "no id", "s")])
    kept = simhash.keep_first(rows)
    assert kept.columns == rows.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == list(range(30)) and kept.count() == 31
    monkeypatch.setattr(simhash, "FEW", 0)  # more than may be broadcast
    assert Counter(map(str, simhash.keep_first(rows).collect())) == Counter(map(str, kept.collect()))


def brute_repeats(rows, window):
    words = {i: (t or "").encode().split() for i, t in rows}
    least = {}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            least.setdefault(tuple(words[i][p : p + window]), i)
    out = {}
    for i, w in words.items():
        off = [False] * len(w)
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < i:
                off[p : p + window] = [True] * window
        out[i] = (len(w), sum(off), hashlib.sha256(b" ".join(x for x, o in zip(w, off) if not o)).hexdigest())
    return out


@pytest.mark.parametrize("window,anchor,size", [(8, 3, 4), (50, 20, 2000)])
def test_repeats_equal_brute_force(spark, window, anchor, size):
    rng = random.Random(window)
    word = lambda: f"w{rng.randrange(size)}"
    passages = [[word() for _ in range(rng.randint(window, 3 * window))] for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "a " * 300), (3, "a " * 400), (4, "x y")]
    for i in range(5, 80):
        text = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) - 1)
            text += rng.choice([p, p[cut:], p[:cut], [word() for _ in range(rng.randint(0, 2 * window))]])
        rows.append((i, " ".join(text)))
    rows += [(90, rows[20][1]), (91, rows[20][1]), (92, rows[33][1])]
    frame = docs(spark, [(i, t, "s") for i, t in rows])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(frame, window, anchor).collect()}
    assert got == brute_repeats(rows, window)


def test_repeats_of_repeated_rows(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(60))
    rows = docs(spark, [(5, text, "s"), (5, text, "s"), (5, text + " more", "s"), (None, text, "s"), (9, text, "s")])
    got = Counter((r.doc_id, r.n_removed) for r in substring.remove_repeats(rows).collect())
    assert got == {(5, 0): 3, (None, 0): 1, (9, 60): 1}
    monkeypatch.setattr(substring, "FEW", 0)
    assert Counter((r.doc_id, r.n_removed) for r in substring.remove_repeats(rows).collect()) == got
    assert substring.remove_repeats(rows.limit(0)).collect() == []


def fill(sizes, share=1.5, most=2.0):
    weight = dict(zip(sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else []), [3, 1, 2] * 99))
    budget, capped = share * sum(sizes.values()), set()
    while True:
        rest = sum(weight[s] for s in sizes if s not in capped)
        level = (budget - sum(most * sizes[s] for s in capped)) / rest if rest else 0
        new = {s for s in sizes if s not in capped and level * weight[s] > most * sizes[s]}
        if not new:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in sizes}
        capped |= new


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 60) or None, rng.choice(["b", "a", "é", "", None, "z"])) for i in range(900)] + [(7, "w w w", "b"), (7, "w w w", "b"), (None, "w w", "a")] + [(1000 + i, "one size fits", "hot") for i in range(1200)]
    frame = docs(spark, rows)
    got = mixing.mix(frame).collect()
    assert len(got) == len(rows)
    size, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.mix_size == len((r.text or "").split()) and 0 <= r.mix_copies <= 2
        size[r.source] += r.mix_size
        taken[r.source] += r.mix_size * r.mix_copies
    want = fill(size)
    for r in got:
        assert r.mix_source_size == size[r.source] and abs(r.mix_target - want[r.source]) < 1e-6
    for s in size:
        assert abs(taken[s] - want[s]) <= 3, s
    again = mixing.mix(frame.repartition(7)).collect()
    key = lambda rs: Counter((r.doc_id, r.source, r.text, r.mix_copies) for r in rs)
    assert key(got) == key(again)
    out = mixing.mixed_documents(frame)
    assert out.columns == frame.columns and out.count() == sum(r.mix_copies for r in got)
    assert mixing.mix(frame.limit(0)).collect() == []


def test_mixing_of_one_doc_id_with_many_texts(spark):
    rows = [(7, f"w{i} w w", "a") for i in range(50)] + [(None, f"v{i} w w", "a") for i in range(50)] + [(9, "x y z", "b")]
    frame = docs(spark, rows)
    texts = lambda f: Counter(r.text for r in mixing.mixed_documents(f).collect())
    assert texts(frame) == texts(frame.repartition(5)) == texts(frame.orderBy("text"))


def test_budgets_of_very_long_documents_stay_small():
    import tracemalloc

    tracemalloc.start()
    take = mixing.choose_counts([*range(2, 4002, 2), 1_000_000], [1] * 2001, 1_777_777)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20 and len(take) == 2001
    tracemalloc.stop()


def test_budget_is_met_exactly_where_it_can_be():
    rng = random.Random(5)
    for _ in range(200):
        sizes = sorted(rng.sample(range(1, 40), rng.randint(1, 8)))
        counts = [rng.randint(1, 5) for _ in sizes]
        budget = rng.randint(0, sum(s * c for s, c in zip(sizes, counts)) + 5)
        take = mixing.choose_counts(sizes, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        reach = {0}
        for s, c in zip(sizes, counts):
            reach = {r + k * s for r in reach for k in range(c + 1)}
        best = min(abs(r - budget) for r in reach)
        assert abs(sum(s * t for s, t in zip(sizes, take)) - budget) <= max(best, 1) + max(sizes) // 4


def test_word_count(spark):
    rows = spark.createDataFrame([(t,) for t in (None, "", " a\tb\x0bc\r\n", "é\x85x\u3000y", "w" * 70_000)], "text string")
    assert [r.n for r in rows.select(n_words("text").alias("n")).collect()] == [0, 0, 3, 1, 1]


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[300:400] = x[300]  # one vector, very often
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    data += [(800, None), (801, [0.0] * 16), (802, [float("nan")] + [1.0] * 15), (803, [None] + [1.0] * 15), (804, [float("inf")] * 16), (820, [])]
    frame = spark.createDataFrame([(i, v, "extra") for i, v in data], "vec_id long, embedding array<float>, rep string")
    got = defaultdict(list)
    for r in ann.nearest(frame, frame.filter("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    y, hits = x.astype(np.float64), []
    assert set(got) == set(range(0, 700, 20))
    for q, found in got.items():
        s = y @ y[q]
        want = sorted((-s[i], i) for i in range(700) if i != q)[:20]
        assert len(found) == 20 and all(abs(score - s[i]) < 1e-9 for i, score in found) and [(-a, i) for i, a in found] == sorted((-a, i) for i, a in found)
        hits.append(len({i for _, i in want} & {i for i, _ in found}) / 20)
    assert np.mean(hits) >= 0.9
    few = ann.nearest(frame.filter("vec_id < 3"), frame.filter("vec_id = 0"), k=20).collect()
    assert [r["rank"] for r in few] == [1, 2]
    assert ann.nearest(frame.limit(0), frame.limit(0)).collect() == []


def exact_neighbours(rows, queries, k):
    """(vec_id, score) of the k nearest different rows of each query, with numpy on doubles."""
    out = {}
    for q, v in queries:
        for i, w in rows:
            if i != q:
                found = out.setdefault(q, {})
                found[i, tuple(w)] = max(found.get((i, tuple(w)), -np.inf), float(np.dot(np.array(v), np.array(w))))
    return {q: sorted(((i, s) for (i, _), s in b.items()), key=lambda x: (-x[1], x[0]))[:k] for q, b in out.items()}


def test_repeated_vec_ids_and_doubles(spark):
    """One vec_id with two vectors, equal rows, ties, and components that single precision would change."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=4) + 1e-9).tolist()) for i in range(60)]
    rows += [(20, rows[3][1]), (40, rows[3][1]), (40, rows[5][1]), (7, rows[3][1]), (7, rows[3][1]), (41, rows[20][1])]
    rows += [(80, [50.0 + i, 0.0, 0.0, 1.0]) for i in range(9)]  # its own vectors are nearest to it
    rows += [(100 + i, [1.0 + i * 1e-12, 0.5, 0.25, 0.125]) for i in range(30)] + [(200 + i, [9.0, 9.0, 9.0, 9.0]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(frame, frame.filter("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = exact_neighbours(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q]))


def test_neighbours_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_BYTES", 1 << 15)  # several blocks of queries, too
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 32))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.nearest(frame, frame.filter("vec_id % 20 = 0"), k=20, shard_rows=1000).collect():
        got[r.query_id].add(r.vec_id)
    hits = [len(got[q] & set(sorted(np.delete(np.arange(6000), q), key=lambda i, q=q: -(x[i] @ x[q]))[:20])) / 20 for q in range(0, 6000, 20)]
    assert np.mean(hits) >= 0.9


def test_walked_graphs(monkeypatch):
    """Graphs built by walks, as beyond EXACT nodes, find as much."""
    monkeypatch.setattr(ann, "EXACT", 300)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    got = ann.SmallWorld(x).search(x[::10], 120)[:, :10]
    want = np.argsort(-(x[::10] @ x.T), axis=1)[:, :10]
    assert np.mean([len({*a} & {*b}) / 10 for a, b in zip(got, want)]) >= 0.9


WORDS = {"en": "the and that with from this have they which".split(), "de": "der und dass mit von diese haben welche über".split(), "fr": "le et que avec de cette avoir ils très".split()}


def labelled(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randint(5, 60))), lang, "s", None, "", ""))
    rows += [(400, None, "en", "s", None, "", ""), (401, "12 34 !?", "en", "s", None, "", ""), (402, "", None, "s", None, "", ""), (403, "der und " * 200_000, None, "s", None, "", "")]
    return spark.createDataFrame(rows, DOCS)


def test_languages(spark):
    frame = labelled(spark)
    model = langid.train(frame)
    got = {r.doc_id: r for r in langid.predict(frame, model).collect()}
    truth = {r.doc_id: r.lang for r in frame.collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {i: got[i].lang_pred for i in (400, 401, 402, 403)} == {400: "und", 401: "und", 402: "und", 403: "de"}
    kept = langid.predict(frame, model, keep="{lang} <> 'und' and {score} >= 0.3")
    assert kept.columns == frame.columns and kept.count() == 301
    assert langid.train(frame.limit(0)) is None and {r.lang_pred for r in langid.predict(frame, None).collect()} == {"und"}


def test_strips_change_nothing(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcé漢 .1İ", k=rng.randint(0, 90))) for _ in range(300)] + ["", "1", "a" * 20, " " * 20, "x" + " " * 30 + "y"]
    count = lambda t: None if (c := langid.counted(t)) is None else [x.tolist() for x in c]
    whole = [count(t) for t in texts]
    assert all((w is None) == (not any(map(str.isalpha, t))) for w, t in zip(whole, texts))
    assert langid.counted("ab")[1].sum() == 4 + 3 + 2  # gap a b gap
    for strip in (1, 2, 3, 7, 10):
        monkeypatch.setattr(langid, "STRIP", strip)
        assert [count(t) for t in texts] == whole


def test_grams_equal_brute_force():
    """N-grams of gap-joined letters, hashed one character at a time."""
    mask = (1 << 64) - 1

    def bucket(gram):
        h = len(gram)
        for c in gram:
            h = (h ^ c) * 0x9E3779B97F4A7C15 & mask
            h ^= h >> 29
        return h >> 48

    for text in ("", "12", "a", "Ab cd", "  É1漢字  x", "İstanbul ΑΣ", "don't stop--now"):
        letters = "".join(c if c.isalpha() else " " for c in text.lower())
        padded = [0 if c == " " else ord(c) for c in " " + " ".join(letters.split()) + " "] if letters.strip() else []
        want = Counter(bucket(padded[i : i + n]) for n in (1, 2, 3) for i in range(len(padded) - n + 1))
        got = langid.counted(text)
        assert (dict(zip(got[0].tolist(), got[1].tolist())) if got else {}) == want, text


def test_probabilities_equal_a_plain_softmax(spark):
    model = langid.train(labelled(spark))
    for text in ("der und dass", "the and that which", "le et que"):
        at, n = langid.counted(text)
        s = (model.weight[at].astype(float) * n[:, None]).sum(axis=0) / n.sum() + model.bias
        p = np.exp(s / model.temperature) / np.exp(s / model.temperature).sum()
        row = langid.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
        assert row.lang_pred == model.langs[int(p.argmax())] and abs(row.score - p.max()) < 1e-9


def test_one_document_repeated_gives_one_model(spark):
    frame = labelled(spark)
    many = frame.unionByName(frame.filter("doc_id = 5").withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(400)))).drop("x"))
    a, b = langid.train(many, fit_rows=60), langid.train(many.repartition(7), fit_rows=60)
    assert a.langs == b.langs and a.temperature == b.temperature and (a.weight == b.weight).all()
    assert langid.predict(frame.limit(0), a).collect() == []


def test_held_out(spark):
    rows = spark.range(300).select(held_out(F.col("id")).alias("h"), "id").collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


def test_toxicity_learns_insults_in_any_language(spark):
    rng = random.Random(9)
    calm = [f"calm{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(calm, k=rng.randint(30, 200))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(5):
                words.insert(rng.randrange(len(words)), rng.choice(["grolk", "snarbfel", "snarbdo", "snarbti"]))
        rows.append((i, " ".join(words), "en", "s", None, "", ""))
        labels.append((i, int(toxic)))
    rows += [(700, None, "en", "s", None, "", ""), (701, "", "en", "s", None, "", ""), (701, "", "en", "s", None, "", "")]
    frame = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score_documents(frame, toxicity.train(frame, marks)).collect()
    held = [r for r in got if r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 603 and all(r.predicted == 0 for r in got if r.doc_id >= 700)
    none = toxicity.score_documents(frame, toxicity.train(frame, marks.limit(0)))
    assert {r.score for r in none.collect()} == {0.5}


def test_clauses_weigh_readings():
    scorer = toxicity.Scorer(toxicity.Lexicon({"fool$": 2.0}))
    total = lambda t: scorer.features(t)[0]
    plain, aimed, negated, reported = total("such a fool here"), total("you are a fool"), total("she is not a fool"), total("he said the fool came")
    assert aimed > plain > negated and reported < aimed
    assert total("i will kill you now") > 0 == total("kill the process")
    assert total("not here. a fool") == plain  # negation ends with its clause


def test_hot_keys_give_the_same_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i % 3 if i % 2 else 7) for i in range(200)] + [(i, 100 + i) for i in range(9)], "doc_id long, key long")
    want = {how: Counter(tuple(r) for r in substring.with_shared(rows, 209, "key", how=how).select("doc_id", "key", "lo").collect()) for how in ("inner", "left")}
    monkeypatch.setattr(substring, "HOT_ROWS", 40)
    for how, rows_ in want.items():
        assert Counter(tuple(r) for r in substring.with_shared(rows, 209, "key", how=how).select("doc_id", "key", "lo").collect()) == rows_
    assert sum(want["left"].values()) == 209 and all(lo is not None for (_, _, lo) in want["inner"])


def test_copies_cost_no_language_and_no_text(spark):
    words = {"de": "und der die das nicht ein Haus wieder", "en": "and the that not a house again with", "fr": "et les des pas une maison encore avec"}
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(words[lang].split(), k=30)), lang) for i, lang in enumerate(["de", "en"] * 150 + ["fr"] * 3)]
    few = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    copies = spark.range(1000, 61_000).select(F.col("id").alias("doc_id"), F.lit("the same old text again").alias("text"), F.lit("en").alias("lang"))
    lone, many = langid.train(few, fit_rows=120), langid.train(few.unionByName(copies), fit_rows=120)
    assert lone.langs == many.langs == ["de", "en", "fr"]
    got = {r.doc_id: r.lang_pred for r in langid.predict(few, many).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) > 295
    pairs = spark.createDataFrame([(h, lang) for h in range(1000) for lang in ("a", "b")] + [(7, "rare"), (8, "rare")] * 50, "h long, lang string")
    drawn = langid.drawn_texts(pairs, 100).collect()
    assert len(drawn) <= 100 and {(r.h, r.lang) for r in drawn} >= {(7, "rare"), (8, "rare"), (0, "a"), (40, "b")} and len(set(drawn)) == len(drawn)
    assert langid.drawn_texts(pairs, 5000).count() == 2002 and langid.drawn_texts(pairs.limit(0), 10).count() == 0


def test_mixing_takes_map_array_and_struct_columns(spark):
    rows = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 5 + 1).cast("int")).alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    odd = rows.withColumns({"m": F.create_map(F.lit("k"), F.col("doc_id")), "a": F.array("doc_id"), "s": F.struct(F.create_map(F.lit(1), F.lit("x")).alias("inner"))})
    assert mixing.mix(odd).count() == 60
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() > 0
    again = lambda: sorted(r.doc_id for r in mixing.mixed_documents(odd.repartition(3)).collect())
    assert again() == again() == sorted(r.doc_id for r in mixed.collect())


def test_every_vector_of_a_repeated_id_is_a_candidate(spark):
    rows = [(20, [1.0, 0.0]), (7, [3.0, 1.0]), (7, [2.0, 5.0]), (7, [2.0, 5.0]), (8, [2.0, 0.5]), (20, [9.0, 9.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(vectors, vectors.filter("vec_id = 20 and embedding[1] = 0.0")).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(1, 7, 3.0), (2, 7, 2.0), (3, 8, 2.0)]
