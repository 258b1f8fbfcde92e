"""Documents and imports of components: discovery, link integrity, inferred dependencies, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.paths import dirname, normalised, owners
from weftline.functions.text import markdown_links


def component_paths(components: DataFrame) -> DataFrame:
    """name, path: one row for each path of a component."""
    return components.select("name", F.explode("path").alias("path"))


def discovered_docs(components: DataFrame, files: DataFrame) -> DataFrame:
    """component, doc, auto: listed documents, then README.md and docs/*.md under each path, each once.

    A trailing src directory of a path is looked through in both directions.
    """
    listed = components.select(F.col("name").alias("component"), F.posexplode("docs").alias("ord", "doc")).select("component", F.regexp_replace("doc", r"^\./", "").alias("doc"), F.lit(False).alias("auto"))
    p = F.regexp_replace("path", "/+$", "")
    roots = component_paths(components).select(F.col("name").alias("component"), F.explode(F.array_distinct(F.array(p, F.regexp_replace(p, "/src$", ""), F.concat(p, F.lit("/src"))))).alias("root"))
    inner = F.regexp_replace("file", r"(?:/docs)?/[^/]+\.md$", "")
    docs = files.filter(F.col("file").rlike(r"(?:^|/)README\.md$|(?:^|/)docs/[^/]+\.md$")).select(F.col("file").alias("doc"), inner.alias("root")).distinct()
    found = roots.join(docs, "root").select("component", "doc", F.lit(True).alias("auto"))
    return listed.unionByName(found).groupBy("component", "doc").agg(F.min("auto").alias("auto"))


def files_of(files: DataFrame, components: DataFrame) -> DataFrame:
    """component, files (sorted), n: files by owner."""
    owned = owners(files, component_paths(components))
    return owned.groupBy("component").agg(F.array_sort(F.collect_list("file")).alias("files"), F.count("*").alias("n"))


def resolved_links(docs: DataFrame) -> DataFrame:
    """doc, label, target, resolved: links of Markdown documents (doc, content), anchors taken off."""
    rows = docs.select("doc", F.explode(markdown_links(F.col("content"))).alias("l"))
    clean = F.regexp_replace("l.target", "#.*$", "")
    return rows.select("doc", "l.label", "l.target", normalised(F.concat_ws("/", dirname(F.col("doc")), clean)).alias("resolved"))


def broken_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """Links that lead to no file and to no directory of one."""
    there = files.select(F.col("file").alias("resolved")).distinct()
    dirs = files.select(dirname(F.col("file")).alias("resolved")).distinct()
    return links.join(there, "resolved", "left_anti").join(dirs, "resolved", "left_anti")


def evidence(edges: DataFrame, most: int | None = None) -> DataFrame:
    """src, dst, n and evidence (file, specifier; sorted) of rows src, dst, file, specifier; src <> dst.

    most: keep only so many of a pair, the least by file; None: all.  A pair's evidence is one row; where
    a pair may have very many, `numbered_evidence` keeps them as rows.
    """
    rows, item = edges.filter("src <> dst"), F.struct("file", "specifier")
    if most is not None:
        nth = F.row_number().over(Window.partitionBy("src", "dst").orderBy("file", "specifier"))
        rows = rows.withColumn("k", nth)
        item = F.when(F.col("k") <= most, item)
    return rows.groupBy("src", "dst").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(item)).alias("evidence"))


def numbered_evidence(edges: DataFrame) -> DataFrame:
    """src, dst, n, file, specifier: each row of evidence with its pair's count, however many a pair has."""
    rows = edges.filter("src <> dst").select("src", "dst", "file", "specifier")
    return rows.join(rows.groupBy("src", "dst").agg(F.count("*").alias("n")), ["src", "dst"])


def inferred(rows: DataFrame, components: DataFrame, file: str, target: str, specifier: str) -> DataFrame:
    """src, dst, file, specifier: owners of both ends of links or imports; unowned ends are left out."""
    both = rows.select(F.col(file).alias("file"), F.col(target).alias("to")).select(F.explode(F.array("file", "to")).alias("file")).distinct()
    own = owners(both.filter("file is not null"), component_paths(components))
    out = rows.select(F.col(file).alias("file"), F.col(target).alias("to"), F.col(specifier).alias("specifier"))
    out = out.join(own.withColumnRenamed("component", "src"), "file").join(own.select(F.col("file").alias("to"), F.col("component").alias("dst")), "to")
    return out.select("src", "dst", "file", "specifier")


def through_barrels(imports: DataFrame, barrels: DataFrame) -> DataFrame:
    """imports (file, resolved_path, specifier) with imports of re-exporting files led on to what these re-export.

    barrels: path, resolved_path.
    """
    via = barrels.select(F.col("path").alias("_b"), F.col("resolved_path").alias("_to")).distinct()
    rows = imports.join(via, F.col("resolved_path") == F.col("_b"), "left")
    return rows.withColumn("resolved_path", F.coalesce("_to", "resolved_path")).drop("_b", "_to").distinct()


def references(refs: DataFrame, components: DataFrame) -> DataFrame:
    """ref, component: references (column ref) by name, else by tag; an unknown one is an error."""
    by_name = components.select(F.col("name").alias("ref"), F.col("name").alias("_n"))
    by_tag = components.select(F.explode("tags").alias("ref"), F.col("name").alias("_t")).distinct()
    rows = refs.select("ref").distinct().join(by_name, "ref", "left").join(by_tag, "ref", "left")
    found = F.coalesce("_n", "_t")
    return rows.select("ref", F.when(found.isNull(), F.raise_error(F.concat(F.lit("unknown component or tag: "), F.col("ref")))).otherwise(found).alias("component")).distinct()


def visible_docs(touched: DataFrame, docs: DataFrame) -> DataFrame:
    """component, doc of what a task sees: README files of all it touches, other documents of what it writes.

    touched: component, mode (r or w); docs: component, doc.
    """
    readme = F.col("doc").rlike(r"(?:^|/)README\.md$")
    return touched.join(docs, "component").filter(readme | (F.col("mode") == "w")).select("component", "doc").distinct()
