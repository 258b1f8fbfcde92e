"""Content at a version: which stored content a path had at a time, renames followed backwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spans(changes: DataFrame) -> DataFrame:
    """path, since, until (null: still), content and origin of each state of a path that is alive.

    changes: path, time, kind (A, M, D, or R for a rename to path from old_path), content (of A and M), old_path.
    A path lives from a change until the next one of it, a rename of it to another path being its end.
    A rename without content of its own takes over what the old path had just before.
    """
    ends = changes.filter("kind = 'R'").select(F.col("old_path").alias("path"), "time", F.lit("D").alias("kind"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("old_path"))
    events = changes.select("path", "time", "kind", "content", "old_path").unionByName(ends)
    order = Window.partitionBy("path").orderBy("time", F.when(F.col("kind") == "D", 0).otherwise(1))  # away first, then in its place
    return events.withColumn("until", F.lead("time").over(order)).filter("kind <> 'D'").withColumnRenamed("time", "since")


def content_at(changes: DataFrame, wanted: DataFrame, most_renames: int = 50) -> DataFrame:
    """path, at, content, origin: content of the wanted (path, at) at those times, and the path it was written under.

    Paths that did not exist then are left out.  An as-of join by path and time; a state that began with a
    rename leads to the state of the old path that ended there, again and again.  A chain of more than
    most_renames renames is an error.
    """
    from weftline.operators.graph import checkpoint

    alive = checkpoint(spans(changes))
    hit = (F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    asked = wanted.select("path", "at").distinct()
    now = asked.join(alive, "path").filter(hit).select("path", "at", F.col("path").alias("origin"), "since", "content", "old_path")
    done, now = None, checkpoint(now)
    for _ in range(most_renames + 1):
        known = now.filter("content is not null or old_path is null").select("path", "at", "content", "origin")
        done = known if done is None else done.unionByName(known)
        left = now.filter("content is null and old_path is not null").select("path", "at", F.col("old_path").alias("origin"), F.col("since").alias("then"))
        before = alive.select(F.col("path").alias("origin"), "since", "until", "content", "old_path")
        now = checkpoint(left.join(before, "origin").filter("until = then").select("path", "at", "origin", "since", "content", "old_path"))
        if now.isEmpty():
            return done
    raise ValueError(f"a path has more than {most_renames} renames")
