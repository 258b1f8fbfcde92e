"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact size.  A source's target is met by whole passes over it and, for the
remaining budget, by choosing how many documents of each size to take: a proportional share of each
size first, then the largest sizes that fit, and for what is left a bounded-knapsack dynamic
programme that finds the sum nearest to the budget.  It keeps one array over the sums up to the
budget left, which is of the order of the largest sizes: for each sum the item that first reached it.
Documents of a size are chosen by a seeded hash of doc_id and text.  A size that very many documents
share is ranked in salted parts whose offsets come from counts, so no task holds all of them.

Sources are few: their targets are computed in one task, from one row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, table, whole_row

#: Parts that the documents of one source and size are ranked in, at least, and rows for each part beyond.
SALTS, PART_ROWS = 64, 1_000_000


def targets_of(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, weight and target of every source.

    sources: source (null allowed), source_size.  Weights repeat over the sources by code point,
    null last.  share of all sizes is dealt out by weight; a target stops at most times its
    source's size and the excess goes to the others by weight, until none is above.  Sorting by
    size for its weight gives the level at which that ends in one pass over the sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(order) - 1) % len(weights) + 1
    rows = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), at.cast("int")).cast("double"))
    rows = rows.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("budget", share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", F.col("budget") / F.col("open")).withColumn("place", F.row_number().over(by_ratio))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(whole)["level"]
    rows = rows.withColumn("target", F.coalesce(F.least("cap", level * F.col("weight")), F.col("cap")))
    return rows.select("source", "source_size", "weight", "target")


def choose_counts(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each size to take so that their sum is nearest to budget.

    Bounded: at most counts[i] of sizes[i].  Exact for the part that proportional shares and whole
    sizes leave over, which is below the largest size.
    """
    total = sum(s * c for s, c in zip(sizes, counts))
    if budget <= 0 or not total:
        return [0] * len(sizes)
    if budget >= total:
        return list(counts)
    take = [c * budget // total for c in counts]
    rest = budget - sum(s * t for s, t in zip(sizes, take))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    for i in order:
        more = min(counts[i] - take[i], rest // sizes[i]) if sizes[i] else 0
        more = min(more, 1 + more // 2)
        take[i] += more
        rest -= more * sizes[i]
    # give back one document of the largest sizes that were taken, so that sums can be recombined
    back = 0
    for i in order:
        if take[i] and back < 2:
            take[i] -= 1
            rest += sizes[i]
            back += 1
    limit = rest + max(sizes) + 1
    items = []  # (index, times, sum) in powers of two, for bounded counts
    for i in order[::-1]:
        left, times = min(counts[i] - take[i], limit // sizes[i] if sizes[i] else 0), 1
        while left > 0:
            n = min(times, left)
            items.append((i, n, n * sizes[i]))
            left -= n
            times *= 2
    # for each sum the item that reached it first: the sum without that item was reached before
    import numpy as np

    first = np.full(limit, -1, dtype=np.int32)
    first[0] = len(items)
    for k, (_, _, s) in enumerate(items):
        if s < limit:
            new = (first[:-s] >= 0) & (first[:-s] != k) & (first[s:] < 0)
            first[s:][new] = k
        if first[rest] >= 0:
            break
    sums = (first >= 0).nonzero()[0]
    low = int(sums[sums <= rest].max())
    over = sums[sums > rest]
    best = int(over.min()) if len(over) and over.min() - rest < rest - low else low
    while best:
        i, n, s = items[first[best]]
        take[i] += n
        best -= s
    return take


def hashable_row(docs: DataFrame) -> Column:
    """All columns as one struct, those with maps in them as JSON, as maps have no hash."""
    return F.struct(*[F.to_json(docs[f"`{c}`"]) if "map<" in kind else docs[f"`{c}`"] for c, kind in docs.dtypes])


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 5, text: str = "text", size: str | None = None) -> DataFrame:
    """The rows of documents with mix_size, mix_source_size, mix_target and mix_copies.

    size names a column that holds the rows' sizes; by default the words of text are counted.
    mix_copies says how often the mix takes the row: whole passes over its source plus one if the
    budget fit chose it.  Null texts have size 0 and are never taken; a null source is a source of
    its own; input columns of the four names are replaced; repeated rows are documents of their own;
    an empty table gives none.  Equal input gives equal choices, however it is partitioned: rows are
    chosen by a hash of all their columns, so rows of one doc_id do not tie unless they are equal.
    """
    rows = docs.select(
        whole_row(docs).alias("row"), docs["doc_id"].cast("long").alias("id"), docs["source"].cast("string").alias("source"),
        (n_words(text) if size is None else docs[size].cast("long")).alias("size"), F.xxhash64(docs["doc_id"].cast("long"), hashable_row(docs), F.lit(seed)).alias("hash"),
    )
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("hash"), F.lit(max(SALTS, docs.count() // PART_ROWS))))
    parts = rows.groupBy("source", "size", "salt").agg(F.count("*").alias("n"))
    lengths = parts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sources = lengths.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).cast("double").alias("source_size"))
    goals = targets_of(sources, weights, share, most).drop("weight").withColumnRenamed("source", "goal_source")

    def fit(frame):
        import pandas as pd

        whole, target = float(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
        frame = frame.sort_values("size")
        passes = int(target // whole) if whole else 0
        take = choose_counts(frame["size"].tolist(), frame["n"].tolist(), round(target - passes * whole))
        return pd.DataFrame({"source": frame["source"], "size": frame["size"], "passes": passes, "take": take})

    fitted = lengths.filter("size > 0").join(goals, F.expr("source <=> goal_source")).drop("goal_source")
    quotas = fitted.groupBy("source").applyInPandas(fit, "source string, size long, passes long, take long")
    quotas = quotas.toDF("quota_source", "quota_size", "passes", "take")
    # how many of each salted part: the parts of a size fill up in order of their salt
    ahead = F.sum("n").over(Window.partitionBy("source", "size").orderBy("salt")) - F.col("n")
    parts = parts.withColumn("ahead", ahead).join(quotas, F.expr("source <=> quota_source and size = quota_size"), "left").join(goals, F.expr("source <=> goal_source"))
    parts = parts.select(
        F.coalesce("source", F.lit("")).alias("part_source"), F.col("source").isNull().alias("part_null"), F.col("size").alias("part_size"), F.col("salt").alias("part_salt"), "source_size", "target",
        F.coalesce("passes", F.lit(0)).alias("passes"), F.greatest(F.lit(0), F.least("n", F.coalesce("take", F.lit(0)) - F.col("ahead"))).alias("taken"),
    )
    rows = rows.withColumn("part_source", F.coalesce("source", F.lit(""))).withColumn("part_null", F.col("source").isNull()).withColumnRenamed("size", "part_size").withColumnRenamed("salt", "part_salt")
    key = ["part_source", "part_null", "part_size", "part_salt"]
    joined = rows.join(parts, key)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("hash", "id"))
    out = joined.withColumn("copies", F.col("passes") + (rank <= F.col("taken")).cast("long"))
    mine = {c: F.col("row")[c] for c in docs.columns} | {"mix_size": F.col("part_size"), "mix_source_size": F.col("source_size").cast("long"), "mix_target": F.col("target"), "mix_copies": F.col("copies")}
    return out.select(*[v.alias(c) for c, v in mine.items()])


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row as often as it is taken, columns unchanged."""
    rows = mix(docs.select(whole_row(docs).alias("row"), docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), docs["text"].alias("text")), **how)
    taken = rows.filter("mix_copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias("copy")).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words("text").alias("size"))
    found = mix(docs, size="size")
    return found.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("size")).alias("taken"))
