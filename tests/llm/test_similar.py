"""The pipeline's near-duplicate stage against brute force on exact Jaccard similarity."""

import random

import numpy as np

import corpus_pipeline
from weftline.llm import similar, simhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_duplicates_equal_brute_force(spark, tmp_path):
    rng = random.Random(3)
    texts = []
    for family in range(60):
        n = rng.choice([9, 10, 12, 30, 60, 150])
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        texts.append(base)
        for _ in range(8):
            words = list(base)
            for _ in range(rng.randrange(1, max(2, n // 25 + 1))):  # J from about 0.6 to 0.95
                words[rng.choice([0, -1, -2, rng.randrange(n)])] = f"x{rng.randrange(10**6)}"
            texts.append(words)
    texts = [" ".join(t) for t in texts] + ["one two", "one two", "a b c d e f", "a b c d e g"]
    rng.shuffle(texts)
    sets = [shingles(t) for t in texts]
    label, near = list(range(len(texts))), 0
    linked = [[] for _ in texts]
    for i in range(len(texts)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            u = len(sets[i]) + len(sets[j]) - o
            near += 0.7 <= o / u <= 0.9
            if 5 * o >= 4 * u:
                linked[i].append(j)
                linked[j].append(i)
    for i in range(len(texts)):  # ids ascend, so the first to reach a text is the least
        todo = [i] if label[i] == i else []
        while todo:
            for j in linked[todo.pop()]:
                if label[j] > i:
                    label[j] = i
                    todo.append(j)
    assert near > 500
    rows = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, rows, str(tmp_path))
    assert kept.columns == rows.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({*label})


def test_repeated_ids_split_shards_and_odd_rows(spark, monkeypatch):
    """Rows with one doc_id and different texts link their texts; cut shards, null, empty and clashing columns change nothing."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", 50)
    rng = random.Random(4)
    base = [f"w{rng.randrange(900)}" for _ in range(60)]
    near = lambda: " ".join(w if k != 30 + rng.randrange(20) else f"x{rng.randrange(10**6)}" for k, w in enumerate(base))
    rows = [(10 + i, near()) for i in range(120)] + [(5, "quite another text of more than five words"), (5, " ".join(base)), (6, "quite another text of more than five words"), (None, "alone and without an id"), (300, None), (301, ""), (302, "short")]
    frame = spark.createDataFrame([(i, t, "k", "a") for i, t in rows], "doc_id long, text string, k0 string, item string")
    got = {(r.doc_id, r.component_id) for r in similar.similar_texts(frame).collect()}
    sets = [(i, shingles(t)) for i, t in rows if t and i is not None]
    linked = {i for i, s in sets for j, t in sets if j in (5, 6) and 5 * len(s & t) >= 4 * len(s | t)}
    assert {i for i, c in got if c == 5} >= linked > {5, 6} and {(300, 300), (301, 300), (302, 302), (None, None)} <= got
    assert similar.similar_texts(frame.limit(0)).collect() == []
    whole = simhash.keep_first(frame)
    assert whole.columns == frame.columns and sorted(r.doc_id or 0 for r in whole.collect())[:2] == [0, 5]


def test_radii_let_hardly_any_link_pass():
    """Exact probability, over random hashes, that sets just similar enough differ in more bits than the radius."""
    from functools import cache
    from math import comb

    law = cache(lambda n: [comb(n, k) / 2**n for k in range(n + 1)])
    bits = 64 * similar.WORDS

    def flip(both, a, b):
        over = lambda only, c: sum(x for k, x in enumerate(law(only)) if 2 * (c + k) > both + only)
        return sum(p * (over(a, c) * (1 - over(b, c)) + over(b, c) * (1 - over(a, c))) for c, p in enumerate(law(both)))

    def missed(n, m):
        both = -(-similar.NUM * (n + m) // (similar.NUM + similar.DEN))
        if both > n:
            return 0.0
        p, radius = flip(both, n - both, m - both), similar.SMALL_RADIUS if n < similar.SMALL else similar.RADIUS
        return sum(comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(radius + 1, bits + 1))

    sizes = [*range(similar.LEAST, 48), 60, 90]
    assert max(missed(n, m) for n in sizes for m in range(n, n * similar.DEN // similar.NUM + 1)) < 1e-6


def family(rng, n, changes, many):
    """Texts of n words that differ from one base in some words each."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    out = []
    for k in range(many):
        words = list(base)
        for at in rng.sample(range(n), changes):
            words[at] = f"x{k}.{at}"
        out.append(" ".join(words))
    return out


def test_rows_follow_texts_and_not_pairs_of_a_group(spark, monkeypatch):
    """300 texts that are all within the radius of each other and hardly linked: no step has a row for each pair."""
    made, keep = [], similar.reliable

    def counted(df):
        df = keep(df)
        made.append(df.count())
        return df

    monkeypatch.setattr(similar, "reliable", counted)
    rows = list(enumerate(family(random.Random(6), 104, 2, 300)))
    got = {r.doc_id: r.component_id for r in similar.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components([shingles(t) for _, t in rows])
    prefix = 100 - 80 + 1
    assert len(made) > 4 and max(made) <= 300 * prefix < 300 * 299 // 2


def components(sets):
    label = list(range(len(sets)))
    for i, s in enumerate(sets):
        for j in range(i):
            if 5 * len(s & sets[j]) >= 4 * len(s | sets[j]) and label[i] != label[j]:
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    return dict(enumerate(label))


def test_parts_of_a_group_and_small_blocks_change_nothing(spark, monkeypatch):
    """Groups cut in parts, and pairs made a few at a time, give the components of brute force."""
    for name, value in (("GROUP", 2_000), ("TOGETHER", 500), ("PAIRS", 50), ("GATHERED", 300)):
        monkeypatch.setattr(similar, name, value)
    rng = random.Random(7)
    texts = [t for n, changes, many in ((104, 1, 60), (104, 2, 40), (12, 1, 20), (24, 1, 40), (60, 1, 30)) for t in family(rng, n, changes, many)]
    rng.shuffle(texts)
    got = {r.doc_id: r.component_id for r in similar.similar_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = components([shingles(t) for t in texts])
    assert got == want and 40 < len({*want.values()}) < len(texts) - 60


def dense(n, flips, seed):
    """n fingerprints of 256 bits in one group, each with some bits of one base flipped, in Gray order."""
    rng = np.random.default_rng(seed)
    bits = np.tile(rng.integers(0, 2, 256, dtype=np.uint8), (n, 1))
    for row in bits:
        row[rng.choice(256, flips, replace=False)] ^= 1
    words = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
    rows = np.column_stack((np.zeros(n, dtype=np.int64), np.arange(n), words))
    return simhash.indexed(rows, 1, 2)


def test_a_dense_group_takes_bounded_memory():
    """All 4.5 million pairs are within the radius, and hardly any node is as a whole."""
    import tracemalloc

    _, index = dense(3000, 25, 1)
    tracemalloc.start()
    labels = index.components(similar.RADIUS)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert not labels.any() and peak < 40


def test_joining_early_changes_no_component(monkeypatch):
    """Components with looks after few links and narrow steps are those of brute force."""
    for flips, radius in ((25, 44), (25, 36), (12, 20), (40, 62)):
        _, index = dense(300, flips, flips)
        near = np.bitwise_count(index.bits[:, None] ^ index.bits[None]).sum(axis=2) <= radius
        a, b = near.nonzero()
        want = simhash.unite(np.arange(300), a, b)
        for wide, links in ((1 << 14, 50_000), (16, 5), (1, 0), (64, 40)):
            monkeypatch.setattr(simhash, "WIDE", wide)
            monkeypatch.setattr(simhash, "LINKS", links)
            assert index.components(radius).tolist() == want.tolist()
