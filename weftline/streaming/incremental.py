"""Incremental maintenance: file streams with checkpoints whose micro-batches merge additive tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import cochange


def run_available(stream: DataFrame, checkpoint: str, each) -> None:
    """Process all that is new since the last run, batch by batch, and stop."""
    done = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    done.awaitTermination()


def increments(commits: DataFrame, batch_id: int, **how) -> DataFrame:
    """Edge and frequency increments of a batch of whole commits as one table (table, a, b, weight, n, batch)."""
    found = cochange.analyze(commits, **how)
    edges = found["edges"].select(F.lit("edge").alias("table"), "a", "b", "weight", "n")
    seen = found["frequencies"].select(F.lit("frequency").alias("table"), F.col("item").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0.0).alias("weight"), "n")
    return edges.unionByName(seen).withColumn("batch", F.lit(batch_id))


def maintain(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, **how) -> None:
    """Keep co-change increments of a folder of commit files (JSON lines) up to date.

    Each micro-batch writes its own partition, overwritten if the batch is repeated after a failure,
    so every commit counts exactly once; `current` adds the partitions up.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        increments(batch, batch_id, **how).drop("batch").write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    run_available(spark.readStream.schema(schema).json(source), checkpoint, each)


def current(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame]:
    """Edges and frequencies as of the last run."""
    rows = spark.read.parquet(target)
    edges = cochange.merge_edges(rows.filter("table = 'edge'").select("a", "b", "weight", "n"))
    return edges, cochange.merge_frequencies(rows.filter("table = 'frequency'").select(F.col("a").alias("item"), "n"))


def compact(spark: SparkSession, target: str, out: str) -> None:
    """Write the sums of all increments as one snapshot."""
    edges, seen = current(spark, target)
    edges.write.mode("overwrite").parquet(f"{out}/edges")
    seen.write.mode("overwrite").parquet(f"{out}/frequencies")


def file_events(spark: SparkSession, folder: str, delay: str = "10 minutes") -> DataFrame:
    """Stream of (path, modified, size) of files that appear in a folder, each path and time once within the delay."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(folder)
    rows = rows.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    return rows.withWatermark("modified", delay).dropDuplicatesWithinWatermark(["path", "modified"])


def snapshot(rows: DataFrame, folder: str, version: str) -> None:
    """Write a version of a table beside the others."""
    rows.write.mode("overwrite").parquet(f"{folder}/version={version}")


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version (by name) of a table; names of folders are listed, only its files are read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = [f.getPath().getName() for f in found if f.getPath().getName().startswith("version=")]
    version = max(names).removeprefix("version=")
    return spark.read.parquet(f"{folder}/version={version}").withColumn("version", F.lit(version))


def run_jobs(jobs: list, workers: int = 5) -> list:
    """Run callables that start Spark jobs, so many at a time; (result, error) of each, in order.

    An error stops no other job.
    """
    from concurrent.futures import ThreadPoolExecutor

    def one(job):
        try:
            return job(), None
        except Exception as error:
            return None, error

    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(one, jobs))
