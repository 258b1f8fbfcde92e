"""From raw documents to token ids: the stages of a training-data pipeline, each one operator.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept.  All but
the last return the columns of documents.

Extra columns pass through; an empty table gives an empty result at each stage; repeated rows are
treated alike where a stage keeps or changes rows, and near_duplicates keeps one of them.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import bpe, langid, mixing, pii, similar, simhash
from weftline.llm.common import reliable, table

#: A document goes if no language is found or its calibrated probability is below this.
LEAST_LANGUAGE_SCORE = 0.35
#: Bytes of an Arrow batch that goes to a worker.
ARROW_BYTES = 2 << 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; texts without a letter, empty and null texts go.

    If no document can be learned from, nothing is recognised.
    """
    return langid.predict(docs, langid.train(docs), keep=f"{{lang}} <> 'und' and {{score}} >= {LEAST_LANGUAGE_SCORE}")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near duplicates.

    Texts are linked if the sets of their five-word shingles have a Jaccard similarity of at least
    0.8: fingerprints and their Gray-order index propose links, whole sets confirm them.  Rows with
    one doc_id are one document; rows without doc_id stay.
    """
    return simhash.keep_first(docs, find=similar.similar_texts, width=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind; null texts stay null."""
    return pii.redact_pii(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents of each source up to its target, some twice, some not at all; a null source is one too."""
    return mixing.mixed_documents(docs)


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of what they decode to; null is empty.

    Executors still hold memory of the stages before, so workers take less of it than by default.
    """
    return bpe.encode_documents(docs, batch_bytes=1 << 18, memo=100_000)


def in_small_batches(stage):
    """The stage, with texts sent to Python workers few at a time, in this session from now on.

    Spark's limit of bytes is for one batch; each task of an executor fills one outside of its heap and
    a worker holds it.  Results do not depend on it.
    """

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(stage.__name__, in_small_batches(stage)) for stage in (language_id, near_duplicates, personal_data, mixing_sources, byte_pairs)]

#: A trained classifier, fingerprints, Luhn and mod-97 checks, a knapsack and merges: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, checkpointed between stages."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = reliable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
