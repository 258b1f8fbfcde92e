"""Order-dependent folds over token counts: chunks with a reset, and admission under a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_chunks(files: DataFrame, key: str, order: list[str], tokens: str, most: int, safety: float = 0.9) -> DataFrame:
    """key, order columns, tokens, chunk (0-based) of files put into chunks of at most safety * most.

    In order, a file that would exceed the limit starts a new chunk; a file above the limit stands
    alone and counts as the limit.  A fold over the rows of a key, streamed in one sorted pass by
    partition, so no group is held.
    """
    limit = int(most * safety)
    rows = files.select(key, *order, F.col(tokens).alias("tokens")).repartition(key).sortWithinPartitions(key, *order)

    def fold(batches):
        import pandas as pd

        now, chunk, total, filled = object(), 0, 0, False
        for frame in batches:
            out = []
            for k, t in zip(frame[key].tolist(), frame["tokens"].tolist()):
                if k != now:
                    now, chunk, total, filled = k, 0, 0, False
                if t > limit:
                    chunk += filled
                    out.append((limit, chunk))
                    chunk, total, filled = chunk + 1, 0, False
                    continue
                if filled and total + t > limit:
                    chunk, total = chunk + 1, 0
                total, filled = total + t, True
                out.append((t, chunk))
            yield frame.assign(tokens=pd.Series([t for t, _ in out], index=frame.index, dtype="int64"), chunk=pd.Series([c for _, c in out], index=frame.index, dtype="int64"))

    types = dict(files.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in (key, *order)] + ["tokens long", "chunk long"])
    return rows.mapInPandas(fold, schema)


def admitted(tasks: DataFrame, key: str, order: list[str], tokens: str, budget: int) -> DataFrame:
    """key, order columns, tokens, admitted: in order, a task goes in if it still fits; others are skipped."""
    rows = tasks.select(key, *order, F.col(tokens).alias("tokens")).repartition(key).sortWithinPartitions(key, *order)

    def fold(batches):
        import pandas as pd

        now, left = object(), 0
        for frame in batches:
            out = []
            for k, t in zip(frame[key].tolist(), frame["tokens"].tolist()):
                if k != now:
                    now, left = k, budget
                out.append(t <= left)
                left -= t if t <= left else 0
            yield frame.assign(admitted=pd.Series(out, index=frame.index, dtype=bool))

    types = dict(tasks.dtypes)
    return rows.mapInPandas(fold, ", ".join([f"`{c}` {types[c]}" for c in (key, *order)] + ["tokens long", "admitted boolean"]))


def chunk_summary(chunks: DataFrame, *keys: str) -> DataFrame:
    """Files and tokens of each chunk."""
    return chunks.groupBy(*keys, "chunk").agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens"))


def truncated(content, tokens: int, marker: str = "\n\n[... truncated ...]"):
    """Content cut to a token budget with a marker, unchanged if it fits."""
    room = max(0, tokens - -(-len(marker) // 4)) * 4
    return F.when(F.length(content) <= tokens * 4, content).otherwise(F.concat(F.substring(content, 1, room), F.lit(marker)))
