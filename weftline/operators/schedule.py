"""Task scheduling: hazards, waves, critical path, restart strategy, plan checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.graph import checkpoint, longest_paths
from weftline.operators.graph import critical_path as longest_chain
from weftline.operators.sized import tasks_for


def touches(tasks: DataFrame) -> DataFrame:
    """id, ord, mode (r, w, m), name: one row for each thing that a task reads, writes or locks."""
    parts = [tasks.select("id", "ord", F.lit(mode).alias("mode"), F.explode(F.array_distinct(F.coalesce(column, F.array().cast("array<string>")))).alias("name")) for mode, column in (("r", "reads"), ("w", "writes"), ("m", "mutexes"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: Tasks of one side that meet in a tile, and pairs for which a partition is made.
TILE, PAIRS = 1024, 4_000_000


def _spans(tasks: DataFrame) -> DataFrame:
    """name, mode, id, lo, hi, writes: least and greatest ord with which a task touches a thing, and whether it writes it too."""
    held = touches(tasks).filter("name is not null").groupBy("name", "id").agg(
        *[f(F.when(F.col("mode") == m, F.col("ord"))).alias(f"{m}_{f.__name__}") for m in "rwm" for f in (F.min, F.max)],
        (F.count_if(F.col("mode") == "w") > 0).alias("writes"),
    )
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"{m}_min").alias("lo"), F.col(f"{m}_max").alias("hi")) for m in "rwm"])
    rows = held.select("name", "id", (F.col("writes") & F.col("id").isNotNull()).alias("writes"), F.explode(modes).alias("s"))
    return rows.filter("s.lo is not null").select("name", "s.mode", "id", "s.lo", "s.hi", "writes")


def hazards(tasks: DataFrame) -> DataFrame:
    """type, source, target, name of every pair of tasks that meet in a component or a mutex.

    RAW leads from each writer to each other reader, in both orders.  WAW and MUTEX lead from the
    earlier task to the later.  WAR leads from a reader that does not write to a writer.

    Tasks are one row for each thing and mode before they meet, so pairs come out once and are not
    shuffled.  The sides of a type and a name are dealt to blocks of about TILE tasks, each pair of
    blocks being a group of its own: no task holds a component, however many touch it.
    """
    rows = checkpoint(_spans(tasks))
    # name, id, lo, hi of each type's two sides
    mode = F.col("mode")
    first = F.when(mode == "w", F.array(F.lit("RAW"), F.lit("WAW"))).when((mode == "r") & ~F.col("writes"), F.array(F.lit("WAR"))).when(mode == "m", F.array(F.lit("MUTEX")))
    second = F.when(mode == "w", F.array(F.lit("WAW"), F.lit("WAR"))).when(mode == "r", F.array(F.lit("RAW"))).when(mode == "m", F.array(F.lit("MUTEX")))
    a = rows.select(F.explode(first).alias("type"), "name", F.col("id").alias("source"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    b = rows.select(F.explode(second).alias("type"), "name", F.col("id").alias("target"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    met = a.groupBy("type", "name").agg(F.count("*").alias("n1")).join(b.groupBy("type", "name").agg(F.count("*").alias("n2")), ["type", "name"])
    met = checkpoint(met.select("type", "name", "n1", "n2", F.ceil(F.col("n1") / TILE).cast("int").alias("k1"), F.ceil(F.col("n2") / TILE).cast("int").alias("k2")))
    pairs = met.agg(F.sum(F.col("n1") * F.col("n2"))).first()[0] or 0

    def dealt(side: DataFrame, key: str, own: str, other: str, k_own: str, k_other: str) -> DataFrame:
        block = F.pmod(F.xxhash64(key), F.col(k_own)).cast("int").alias(own)
        out = side.join(met, ["type", "name"]).select(*side.columns, block, F.explode(F.sequence(F.lit(0), F.col(k_other) - 1)).alias(other))
        return out.repartition(tasks_for(pairs, PAIRS), "type", "name", "i", "j")

    both = dealt(a, "source", "i", "j", "k1", "k2").hint("merge").join(dealt(b, "target", "j", "i", "k2", "k1"), ["type", "name", "i", "j"])
    later = F.col("lo1") < F.col("hi2")
    apart = (F.col("lo1") != F.col("hi1")) | (F.col("lo2") != F.col("hi2")) | (F.col("lo1") != F.col("lo2"))
    return both.filter(F.when(F.col("type").isin("WAW", "MUTEX"), later).otherwise(apart)).select("type", "source", "target", "name")


def write_conflicts(tasks: DataFrame) -> DataFrame:
    """id, name: a task once for each other one that writes the same component later, as the WAW hazards from it.

    Later writers are counted, not met: a running count over the order of each component, by ranges of
    that order, so a component's writers are spread over tasks and only the result grows with pairs.
    """
    rows = checkpoint(_spans(tasks).filter("mode = 'w'"))
    marks = rows.select("name", "id", F.col("lo").alias("at"), F.lit(0).alias("last")).unionByName(rows.select("name", "id", F.col("hi").alias("at"), F.lit(1).alias("last")))
    # at one time those who ask come before those who are counted: later is strictly later
    cut = checkpoint(marks.repartitionByRange(tasks_for(marks.count()), "name", F.desc("at"), "last").withColumn("part", F.spark_partition_id()))
    before = cut.groupBy("name", "part").agg(F.sum("last").alias("in")).withColumn("before", F.sum("in").over(Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = cut.withColumn("inside", F.sum("last").over(Window.partitionBy("name", "part").orderBy(F.desc("at"), "last").rowsBetween(Window.unboundedPreceding, 0)))
    asked = inside.filter("last = 0").join(before, ["name", "part"]).select("id", "name", (F.col("inside") + F.coalesce("before", F.lit(0))).cast("long").alias("n"))
    asked = checkpoint(asked.filter("n > 0"))
    step, total = 10_000, asked.agg(F.sum("n")).first()[0] or 0
    some = asked.select("id", "name", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))).alias("from"))
    some = some.repartition(tasks_for(total, PAIRS), "id", "name", "from")
    return some.select("id", "name", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + step, "n") - 1)).alias("k")).select("id", "name")


def ordering(found: DataFrame) -> DataFrame:
    """Edges that hold tasks apart: RAW, WAW and MUTEX hazards."""
    return found.filter("type <> 'WAR'").select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct()


def waves(tasks: DataFrame, max_waves: int | None = None) -> DataFrame:
    """id, wave: one more than the latest wave among those it waits for; a cycle, or a wave above max_waves (None: no limit), is an error."""
    deep = longest_paths(ordering(hazards(tasks)), max_waves).withColumnRenamed("node", "id")
    return tasks.select("id").join(deep, "id", "left").select("id", F.coalesce("depth", F.lit(0)).alias("wave"))


def critical_path(tasks: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Longest chain of RAW hazards; one longer than max_depth (None: than there are tasks) is an error."""
    raw = hazards(tasks).filter("type = 'RAW'").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    return longest_chain(raw, max_depth)


def restart_strategy(tasks: DataFrame, failed) -> DataFrame:
    """One row: strategy and affected tasks after a task failed.  tasks: id, reads, writes, mutexes, state.

    Affected are completed or dispatched tasks that read what the failed one writes or share a
    mutex.  None: isolated_retry; a completed one among them: escalate; else cascade_restart.
    """
    bad = tasks.filter(F.col("id") == failed).select(F.col("writes").alias("_w"), F.col("mutexes").alias("_m"))
    active = tasks.filter((F.col("id") != failed) & F.col("state").isin("completed", "dispatched")).crossJoin(F.broadcast(bad))  # one row
    hit = active.filter(F.coalesce(F.arrays_overlap("reads", "_w"), F.lit(False)) | F.coalesce(F.arrays_overlap("mutexes", "_m"), F.lit(False)))
    out = hit.agg(F.array_sort(F.collect_list("id")).alias("affected"), F.coalesce(F.bool_or(F.col("state") == "completed"), F.lit(False)).alias("_done"))
    return out.select(F.when(F.size("affected") == 0, "isolated_retry").when(F.col("_done"), "escalate").otherwise("cascade_restart").alias("strategy"), "affected")


def plan_issues(tasks: DataFrame, components: DataFrame) -> DataFrame:
    """issue, id, name: duplicate ids, unknown references, write conflicts, undeclared reads, lone mutexes.

    components: name, deps.
    """
    t = touches(tasks)
    known = components.select("name")
    dup = tasks.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate_id").alias("issue"), "id", F.lit(None).cast("string").alias("name"))
    unknown = t.filter("mode <> 'm'").join(known, "name", "left_anti").select(F.lit("unknown_component").alias("issue"), "id", "name")
    clash = write_conflicts(tasks).select(F.lit("write_conflict").alias("issue"), "id", "name")
    declared = components.select("name", F.explode("deps").alias("dep"))
    needs = t.filter("mode = 'w'").join(declared, "name").select("id", F.col("dep").alias("name")).distinct()
    have = t.filter("mode <> 'm'").select("id", "name").distinct()
    undeclared = needs.join(have, ["id", "name"], "left_anti").select(F.lit("undeclared_read").alias("issue"), "id", "name")
    lone = t.filter("mode = 'm'").groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1").select(F.lit("lone_mutex").alias("issue"), "id", "name")
    return dup.unionByName(unknown).unionByName(clash).unionByName(undeclared).unionByName(lone)


def scope_violations(files: DataFrame, owner: DataFrame, writes: list[str]) -> DataFrame:
    """Files outside the declared writes; unowned ones only if something is declared.  files: file; owner: file, component."""
    rows = files.join(owner, "file", "left")
    allowed = F.coalesce(F.col("component").isin(*writes), F.lit(False)) if writes else F.lit(False)
    return rows.filter(~allowed & (F.col("component").isNotNull() | F.lit(bool(writes))))


def suggested_touches(owner: DataFrame, deps: DataFrame) -> DataFrame:
    """component, mode: writes are the owners of changed files, reads what they depend on, less the writes."""
    writes = owner.select("component").filter("component is not null").distinct()
    reads = deps.join(writes, deps["src"] == writes["component"], "left_semi").select(F.col("dst").alias("component")).distinct()
    return writes.withColumn("mode", F.lit("w")).unionByName(reads.join(writes, "component", "left_anti").withColumn("mode", F.lit("r")))
