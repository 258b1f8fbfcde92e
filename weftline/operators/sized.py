"""How many tasks a step is dealt to, by its rows: a fixed number of partitions makes each task grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of one task.
ROWS = 500_000


def tasks_for(rows: int, each: int = ROWS) -> int:
    """Tasks for so many rows, at least one."""
    return max(1, -(-rows // each))


def dealt(df: DataFrame, rows: int, *keys: str, each: int = ROWS) -> DataFrame:
    """df dealt by keys to as many tasks as so many rows ask for, at least as many as a shuffle of the session has.

    A number given is kept by adaptive execution, so a small table that becomes a large one later (by
    explode or join) is still spread.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, tasks_for(rows, each)), *keys)
