"""Review findings: overlap, de-duplication, suppression, coverage, scores and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.paths import glob_regex
from weftline.functions.text import SEVERITIES, severity_rank


def overlap_pairs(rows: DataFrame, keys: list[str], start: str, end: str, row_id: str, width: int) -> DataFrame:
    """Pairs (left_id < right_id) with equal keys whose closed intervals overlap.

    Intervals are cut into buckets of `width`, so the join is an equi-join on keys and bucket; a pair
    counts in the bucket where the later of the two starts lies, hence once.
    """
    base = rows.select(*keys, F.col(row_id).alias("id"), F.col(start).alias("s"), F.col(end).alias("e"))
    a = base.withColumn("bucket", cut_of("s", "e", width))
    left = a.select(*keys, "bucket", F.col("id").alias("left_id"), F.col("s").alias("s1"), F.col("e").alias("e1"))
    right = a.select(*keys, "bucket", F.col("id").alias("right_id"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    both = left.join(right, [*keys, "bucket"]).filter("left_id < right_id and s1 <= e2 and s2 <= e1")
    return both.filter(F.floor(F.greatest("s1", "s2") / width) == F.col("bucket")).select(*keys, "left_id", "right_id")


def cut_of(start: str, end: str, width: int):
    """Buckets that an interval covers, exploded."""
    return F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor(F.col(end) / width).cast("long")))


def deduplicate(found: DataFrame) -> DataFrame:
    """Greedy groups of overlapping findings of a rule, in order of task and ordinal.

    found: rule_id, task_id, ord, severity, title, confidence, locations (array of file, start_line,
    end_line).  A finding joins the first group with a member it overlaps.  Result: rule_id, severity
    and title of the worst member (then most confident), tasks, confidence raised by 0.1 for each
    further task (at most 1), members.  Rules stream through one sort, a rule at a time; its groups
    are looked up by file, so a finding meets only groups that share a file with it.
    """
    rows = found.select("rule_id", "task_id", "ord", "severity", "title", "confidence", "locations").repartition("rule_id").sortWithinPartitions("rule_id", "task_id", "ord")
    rank = {s: i for i, s in enumerate(SEVERITIES)}

    def fold(batches):
        import pandas as pd

        def close(rule, groups):
            for g in groups:
                severity, title, confidence = min((m[0] for m in g), key=lambda m: (rank.get(m[0], 3), -m[2]))
                tasks = len({m[1] for m in g})
                yield rule, severity, title, tasks, min(1.0, confidence + 0.1 * (tasks - 1)), len(g)

        def table(out):
            return pd.DataFrame(out, columns=["rule_id", "severity", "title", "tasks", "confidence", "members"])

        rule, groups, at, started = None, [], {}, False
        for frame in batches:
            out = []
            for r in frame.itertuples():
                if not started or r.rule_id != rule:
                    out += close(rule, groups)
                    rule, groups, at, started = r.rule_id, [], {}, True
                spans = [(x["file"], x["start_line"], x["end_line"] if x["end_line"] is not None else x["start_line"]) for x in r.locations]
                near = sorted({g for f, _, _ in spans for g in at.get(f, ())})
                home = next((g for g in near if any(f == f2 and s <= e2 and s2 <= e for m in groups[g] for f, s, e in spans for f2, s2, e2 in m[2])), None)
                if home is None:
                    home = len(groups)
                    groups.append([])
                groups[home].append(((r.severity, r.title, r.confidence), r.task_id, spans))
                for f, _, _ in spans:
                    at.setdefault(f, set()).add(home)
            yield table(out)
        yield table([*close(rule, groups)])

    return rows.mapInPandas(fold, "rule_id string, severity string, title string, tasks long, confidence double, members long")


def inline_suppressions(files: DataFrame) -> DataFrame:
    """file, line, rule, reason of suppression comments; each covers its own line and the next, if there is one.  files: file, content."""
    lines = F.split("content", "\n", -1)
    rows = files.select("file", F.size(lines).alias("last"), F.posexplode(lines).alias("n", "line"))
    pattern = r'//\s*audit-suppress\s+([\w-]+)(?:\s+"([^"]*)")?'
    rows = rows.filter(F.col("line").rlike(pattern))
    return rows.select("file", F.explode(F.sequence(F.col("n") + 1, F.least(F.col("n") + 2, "last"))).alias("line"), F.regexp_extract("line", pattern, 1).alias("rule"), F.regexp_extract("line", pattern, 2).alias("reason"))


def suppressed(found: DataFrame, rules: list[dict], inline: DataFrame | None = None) -> DataFrame:
    """found with reason: that of the first configured rule that matches, else of an inline comment, else null.

    found: rule_id, file, start_line.  rules: dicts of rule and optionally file, glob, reason.
    """
    reason = F.lit(None).cast("string")
    for r in reversed(rules):
        hit = F.col("rule_id") == r["rule"]
        if r.get("file"):
            hit = hit & (F.col("file") == r["file"])
        if r.get("glob"):
            hit = hit & F.col("file").rlike(glob_regex(r["glob"]))
        reason = F.when(hit, F.lit(r.get("reason") or "Suppressed by configuration")).otherwise(reason)
    rows = found.withColumn("_config", reason)
    if inline is None:
        return rows.withColumnRenamed("_config", "reason")
    notes = inline.groupBy(F.col("rule").alias("rule_id"), "file", F.col("line").alias("start_line")).agg(F.min("reason").alias("_inline"))
    return rows.join(notes, ["rule_id", "file", "start_line"], "left").withColumn("reason", F.coalesce("_config", "_inline")).drop("_config", "_inline")


def severity_summary(found: DataFrame, *keys: str) -> DataFrame:
    """Counts by severity and in all."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    return found.groupBy(*keys).agg(*counts, F.count("*").alias("total"))


def coverage(pairs: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """pairs with checked, whether a completed task covered them."""
    return pairs.join(done.select(*keys).distinct().withColumn("checked", F.lit(True)), list(keys), "left").fillna(False, ["checked"])


def coverage_ratio(covered: DataFrame, key: str) -> DataFrame:
    """Share of distinct keys with anything checked."""
    return covered.agg((F.count_distinct(F.when(F.col("checked"), F.col(key))) / F.count_distinct(key)).alias("ratio"))


def weighted_score(rows: DataFrame, score: str, weight: str, *keys: str) -> DataFrame:
    """Weighted mean, 0 without weight."""
    return rows.groupBy(*keys).agg(F.coalesce(F.sum(F.col(score) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0)), F.lit(0.0)).alias("score"))


def drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """rule_id, file, status, both severities and changes of findings matched one to one by overlap, first fit.

    Both: rule_id, ord, severity, confidence, and either file, start_line and end_line or locations
    (an array of such structs; file is then the first one's).  A null end_line is the start_line.
    Current findings, in order, take the first free baseline finding of their rule that they overlap
    in some location: stable or changed; others are new, baseline findings left over resolved.
    changes lists (field, old, new).  With one location a task folds a rule and file, else a rule.
    """
    many = "locations" in baseline.columns
    kind = "rule_id string, file string, status string, before string, after string, changes array<struct<field:string,old:string,new:string>>"

    def spans(row):
        places = row.locations if many else [{"file": row.file, "start_line": row.start_line, "end_line": row.end_line}]
        return [(p["file"], p["start_line"], p["start_line"] if p["end_line"] is None or p["end_line"] != p["end_line"] else p["end_line"]) for p in places]

    def match(rule, old, new):
        places = [spans(b) for b in old]
        at: dict = {}
        for k, of in enumerate(places):
            for f in {f for f, _, _ in of}:
                at.setdefault(f, []).append(k)
        free, out = set(range(len(old))), []
        first = lambda of: of[0][0] if of else None
        for c in new:
            mine = spans(c)
            files = {f for f, _, _ in mine}
            near = at.get(mine[0][0], ()) if len(files) == 1 else sorted({k for f in files for k in at.get(f, ())})
            home = next((k for k in near if k in free and any(f == g and s <= e2 and s2 <= e for f, s, e in mine for g, s2, e2 in places[k])), None)
            if home is None:
                out.append((rule, first(mine), "new", None, c.severity, []))
                continue
            free.remove(home)
            b = old[home]
            changes = [{"field": "severity", "old": b.severity, "new": c.severity}] if b.severity != c.severity else []
            if b.confidence != c.confidence:
                changes.append({"field": "confidence", "old": f"{b.confidence:.2f}", "new": f"{c.confidence:.2f}"})
            out.append((rule, first(mine), "changed" if changes else "stable", b.severity, c.severity, changes))
        return out + [(rule, first(places[k]), "resolved", old[k].severity, None, []) for k in sorted(free)]

    keys = ["rule_id"] if many else ["rule_id", "file"]
    columns = ["rule_id", "ord", "severity", "confidence", *(["locations"] if many else ["file", "start_line", "end_line"])]

    def fold(batches):
        import pandas as pd

        key, sides, begun = None, ([], []), False
        for frame in batches:
            out = []
            for r in frame.itertuples(index=False):
                now = tuple(getattr(r, k) for k in keys)
                if not begun or now != key:
                    out += match(key[0], *sides) if begun else []
                    key, sides, begun = now, ([], []), True
                sides[r.late].append(r)
            yield pd.DataFrame(out, columns=["rule_id", "file", "status", "before", "after", "changes"])
        yield pd.DataFrame(match(key[0], *sides) if begun else [], columns=["rule_id", "file", "status", "before", "after", "changes"])

    # streamed through one sort, a group at a time: a call for each group costs more than its matching
    both = baseline.select(*columns, F.lit(0).alias("late")).unionByName(current.select(*columns, F.lit(1).alias("late")))
    return both.repartition(*keys).sortWithinPartitions(*keys, "late", "ord").mapInPandas(fold, kind)


def trend(changes: DataFrame) -> DataFrame:
    """One row: improving if more was resolved than is new, regressing if less, else stable."""
    n = F.count_if(F.col("status") == "resolved") - F.count_if(F.col("status") == "new")
    return changes.agg(F.when(n > 0, "improving").when(n < 0, "regressing").otherwise("stable").alias("trend"))


def rules_for_components(components: DataFrame, rules: DataFrame) -> DataFrame:
    """component, rule_id where a tag of either side holds one of the other; rules without tags fit all.

    components: name, tags; rules: id, applies_to.  Rules are a small written list, joined by the
    substrings of tags: both sides meet on every common tag part by equality where they are equal,
    and the containment test runs on the distinct tags only.
    """
    tags = components.select("name", F.explode("tags").alias("t")).select("name", F.lower(F.trim("t")).alias("t")).distinct()
    wants = rules.select("id", F.explode("applies_to").alias("w")).select("id", F.lower(F.trim("w")).alias("w")).distinct()
    fits = tags.select("t").distinct().join(F.broadcast(wants.select("w").distinct()), F.col("w").contains(F.col("t")) | F.col("t").contains(F.col("w")))
    named = tags.join(fits, "t").join(wants, "w").select(F.col("name").alias("component"), F.col("id").alias("rule_id"))
    free = components.select(F.col("name").alias("component")).crossJoin(F.broadcast(rules.filter(F.size("applies_to") == 0).select(F.col("id").alias("rule_id"))))
    return named.unionByName(free).distinct()


def min_rank(rules: DataFrame, *keys: str) -> DataFrame:
    """Worst severity rank of each key."""
    return rules.groupBy(*keys).agg(F.min(severity_rank(F.col("severity"))).alias("priority"))


def overlap_groups(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """rows with grp: runs of intervals that overlap one another in turn, by key (transitive, unlike deduplicate)."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_new", (F.coalesce(reach, F.col(start) - 1) < F.col(start)).cast("int")).withColumn("grp", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
