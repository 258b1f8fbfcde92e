"""The pipeline's stages on a small corpus, each on what the one before kept."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import langid, pii


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    vocabulary = [f"word{i}" for i in range(3000)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(rng.choices(vocabulary, k=200)) + (" mail me at a@b.com or 10.0.0.1" if i % 10 == 0 else ""), "en", f"src{i % 3}", None))
    rows += [(100, rows[1][1], "en", "src1", None), (101, rows[2][1].replace(rows[2][1].split()[100], "new", 1), "en", "src1", None), (102, "12345 !!", None, "src0", None), (103, None, None, None, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "personal_data", "mixing_sources", "byte_pairs"]
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        kept[name] = docs
        if name != names[-1]:
            assert docs.columns == columns
    ids = lambda n: sorted(r.doc_id for r in kept[n].select("doc_id").collect())
    assert ids("language_id") == [*range(60), 100, 101]
    assert ids("near_duplicates") == list(range(60)) == ids("personal_data")
    assert all(not r.pii_spans for r in pii.find_pii(kept["personal_data"]).collect())
    words = sum(len(r.text.split()) for r in kept["personal_data"].collect())
    assert abs(sum(len(r.text.split()) for r in kept["mixing_sources"].collect()) - 1.5 * words) < 400
    assert kept["byte_pairs"].count() == kept["mixing_sources"].count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept["byte_pairs"].count()


def test_stages_on_no_rows_and_odd_rows(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long, hash string, row string"
    odd = [(None, None, None, None, None, None, None), (1, "", "en", None, 0, "h", "r"), (1, "", "en", None, 0, "h", "r"), (2, "long word " * 60_000, "en", "s", 5, "h", "r"), (3, "a b c", "de", "s", 5, None, None), (3, "other words", "de", "s", 5, None, None)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, kind)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            n = out.count()
            assert n == 0 if not rows else n <= 2 * len(rows)
            if name != "byte_pairs":
                assert out.columns == docs.columns
                if name == "near_duplicates" and rows:  # one of each group, and rows without an id
                    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 2, 3]


def token_peak(batch_bytes):
    """Peak MB that a worker allocates for a megabyte of texts of new words, codec and memory of chunks aside."""
    import tracemalloc

    import pyarrow as pa

    from weftline.llm import bpe
    from weftline.llm.common import as_bytes, parts

    rng = random.Random(8)
    texts = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**9):x}" for _ in range(2500)) for _ in range(45)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(45), pa.int64()), "text": pa.array(texts)})
    codec = bpe.load_codec(None, None)
    codec.known = {}
    peaks = []
    for part in parts(batch, 1, batch_bytes):
        tracemalloc.start()
        codec.encode_batch([b.decode() for b in as_bytes(part.column(1))])
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    return max(peaks)


def test_byte_pairs_encodes_few_texts_together(monkeypatch):
    asked = {}
    monkeypatch.setattr(corpus_pipeline.bpe, "encode_documents", lambda docs, **how: asked.update(how))
    corpus_pipeline.byte_pairs(None, None, "")
    monkeypatch.undo()
    assert token_peak(asked["batch_bytes"]) < 60


def test_texts_reach_workers_a_few_at_a_time(spark):
    """A partition of 20 MB is not one batch."""

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.nbytes])})

    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), 10_000).alias("text"))
    old = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        dict(corpus_pipeline.STAGES)["byte_pairs"](spark, docs, "")
        got = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", old)
    assert sum(got) >= 20_000_000 and max(got) < 3_000_000


def test_training_starts_no_other_workers(spark, monkeypatch):
    """Shares of languages are literals: a table made from a list is a Python RDD, with a pool of workers of its own."""
    rows = [(h, lang) for lang, n in (("en", 900), ("it's", 40), ("", 3)) for h in range(n)]
    texts = spark.createDataFrame(rows, "h long, lang string")
    texts = texts.localCheckpoint()

    def refuse(*args, **how):
        raise AssertionError("a local list")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refuse)
    got = [tuple(r) for r in langid.drawn_texts(texts, 300).collect()]
    assert sorted(got) == sorted((h, lang) for lang, n in (("en", 257), ("it's", 40), ("", 3)) for h in range(n))
