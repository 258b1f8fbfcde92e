"""Component suggestions from the layout of a tree of paths (column file)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.paths import stem, unscoped

#: Directories that hold packages, that mark a component, and layers.
CONTAINERS = ("packages", "apps", "modules", "libs")
INDICATORS = ("src", "app", "lib", "test", "tests", "node_modules")
LAYERS = ("controllers", "services", "repositories", "handlers", "models", "routes", "middleware", "providers", "resolvers", "validators", "schemas", "entities", "components", "pages", "api", "hooks", "utils")


def workspace_packages(packages: DataFrame) -> DataFrame:
    """packages: dir, package_name."""
    return packages.select(unscoped(F.col("package_name")).alias("name"), F.array("dir").alias("paths"), F.lit(0).alias("priority"))


def containers(files: DataFrame) -> DataFrame:
    """Directories right under a container directory."""
    p = F.split("file", "/")
    rows = files.filter(p[0].isin(*CONTAINERS) & (F.size(p) > 2)).select(p[1].alias("name"), F.concat_ws("/", p[0], p[1]).alias("dir")).distinct()
    return rows.select("name", F.array("dir").alias("paths"), F.lit(1).alias("priority"))


def indicated(files: DataFrame) -> DataFrame:
    """Top directories with a marking subdirectory; the evidence prefers src, then app."""
    p = F.split("file", "/")
    rows = files.filter((F.size(p) > 2) & p[1].isin(*INDICATORS)).select(p[0].alias("name"), p[1].alias("mark"))
    prefer = F.when(F.col("mark") == "src", 0).when(F.col("mark") == "app", 1).otherwise(2)
    return rows.groupBy("name").agg(F.min_by("mark", F.struct(prefer, F.col("mark"))).alias("mark")).select("name", F.array("name").alias("paths"), F.lit(2).alias("priority"))


def layer_dirs(files: DataFrame) -> DataFrame:
    """Top directories that are layers, sorted."""
    return files.select(F.split("file", "/")[0].alias("layer")).filter(F.col("layer").isin(*LAYERS)).distinct().orderBy("layer")


def stem_clusters(files: DataFrame) -> DataFrame:
    """Stems that occur in two layers or more."""
    p = F.split("file", "/")
    rows = files.filter(p[0].isin(*LAYERS)).select(p[0].alias("layer"), stem(F.col("file")).alias("name")).filter("name is not null")
    return rows.groupBy("name").agg(F.array_sort(F.collect_set("layer")).alias("paths")).filter(F.size("paths") >= 2).withColumn("priority", F.lit(4))


def domains(files: DataFrame) -> DataFrame:
    """Directories with two layer subdirectories or more."""
    p = F.split("file", "/")
    rows = files.filter((F.size(p) > 2) & p[1].isin(*LAYERS)).select(p[0].alias("name"), F.concat_ws("/", p[0], p[1]).alias("dir"))
    return rows.groupBy("name").agg(F.array_sort(F.collect_set("dir")).alias("paths")).filter(F.size("paths") >= 2).withColumn("priority", F.lit(3))


def first_wins(*parts: DataFrame) -> DataFrame:
    """One row for each name, from the part of least priority."""
    rows = reduce(DataFrame.unionByName, parts)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("priority", F.to_json("paths")))).filter("_n = 1").drop("_n")


def suggest(files: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """All strategies merged."""
    parts = [containers(files), indicated(files), domains(files), stem_clusters(files)]
    return first_wins(*([workspace_packages(packages)] if packages is not None else []), *parts)
