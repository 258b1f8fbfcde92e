"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (FTRL-proximal) under elastic-net penalties, then
calibrated by one temperature.  Document frequencies cover all labelled documents that may be
learned from; the regression is fitted on a bounded sample of them (`fit_rows`, by hash of doc_id).
Prediction is one pass without a shuffle: n-grams are hashed with array operations and each
document's logits are a mean of table rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, parts, reliable, table, whole_row, worker_state

#: Hash buckets of n-grams, longest n-gram, and characters hashed at once (bounds memory only).
BUCKETS, LONGEST, STRIP = 1 << 16, 3, 1 << 17


def letters() -> object:
    """Boolean table of all code points that are letters, made once for each worker."""
    import numpy as np

    state = worker_state()
    if "letters" not in state:
        state["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return state["letters"]


def grams(text: str):
    """Buckets of every n-gram of the letters of a text (other characters: one gap), n from 1 to LONGEST.

    Arrays of buckets, one for each n and strip of the text; what a strip begins with is carried
    over from the one before, so the n-grams are those of the whole text.
    """
    import numpy as np

    raw = text.lower()
    tail, last, first = np.zeros(1, np.uint64), np.uint64(0), True
    for at in range(0, len(raw) + 1, STRIP):
        code = np.frombuffer((raw[at : at + STRIP] + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        code = np.where(letters()[code], code, np.uint64(0))
        if at + STRIP <= len(raw):
            code = code[:-1]  # the blank closes the text
        code = code[(code != 0) | (np.concatenate(([last], code[:-1])) != 0)]
        if not len(code):
            continue
        last, old = code[-1], len(tail)
        code = np.concatenate((tail, code))
        for n in range(1, LONGEST + 1):
            start = 0 if first else max(0, old - n + 1)  # those that end in this strip
            m = len(code) - n + 1 - start
            h = np.full(m, n, dtype=np.uint64)
            for k in range(n):
                h = (h ^ code[start + k : start + k + m]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            yield (h >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)
        tail, first = code[-(LONGEST - 1) :], False


def counted(text: str):
    """(buckets, counts) of the n-grams of a text, or None if it has no letter."""
    import numpy as np

    found = list(grams(text))
    if not found:
        return None
    if sum(map(len, found)) < BUCKETS:
        return np.unique(np.concatenate(found), return_counts=True)
    total = np.zeros(BUCKETS, dtype=np.int64)
    for g in found:
        total += np.bincount(g, minlength=BUCKETS)
    at = total.nonzero()[0]
    return at, total[at]


@dataclass
class Model:
    """Table of logits for each bucket (idf folded in), bias, languages and temperature."""

    weight: object
    bias: object
    langs: list[str]
    temperature: float

    def logits(self, text: str):
        """Mean logits over the n-grams of a text, None if it has no letter."""
        import numpy as np

        total, n = np.zeros(len(self.langs)), 0
        for g in grams(text):
            total += self.weight[g].sum(axis=0, dtype=np.float64)
            n += len(g)
        return (total / n + self.bias) if n else None


def ftrl(rows: list, target, n_classes: int, alpha=0.5, beta=1.0, l1=0.02, l2=0.05, epochs=4):
    """FTRL-proximal with elastic net for softmax regression; rows are (buckets, values) pairs."""
    import numpy as np

    z, n = np.zeros((BUCKETS + 1, n_classes)), np.zeros((BUCKETS + 1, n_classes))

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[target[i]] -= 1
            g = x[:, None] * p
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    return weights(np.arange(BUCKETS + 1))


def drawn_texts(texts: DataFrame, most: int) -> DataFrame:
    """Pairs of h and lang to learn from: different ones, at most `most` (or one for each language, if those are more).

    Copies count once.  Each language has a share: an equal one of half of `most`, or all its pairs if
    they are fewer, and of what is left in proportion to its pairs.  Within a language the pairs of least h (its last 40 bits) are taken.
    """
    from pyspark.sql import Window

    pairs = reliable(texts.distinct())
    n = {r["lang"]: r["n"] for r in pairs.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # languages
    if not n:
        return pairs
    least = {lang: min(k, max(1, most // (2 * len(n)))) for lang, k in n.items()}
    left, open_ = max(0, most - sum(least.values())), sum(n.values()) - sum(least.values())
    quota = {lang: k + (n[lang] - k) * left // open_ if open_ > left else n[lang] for lang, k in least.items()}
    # a threshold on the hash lets twice the share through (all, where that is few), so that no task gets a language's pairs
    cut = {lang: min(1.0, 2 * max(k, 100) / n[lang]) for lang, k in quota.items()}
    # literals, as a table made from a list starts workers of its own on the executors, which stay for a minute
    shares = [F.struct(F.lit(lang).alias("lang"), F.lit(k).cast("long").alias("quota"), F.lit(int(cut[lang] * (1 << 40)) + 1).cast("long").alias("cut")) for lang, k in quota.items()]
    share = pairs.sparkSession.range(1).select(F.inline(F.array(*shares)))
    near = pairs.join(F.broadcast(share), "lang").filter(F.pmod(F.col("h"), F.lit(1 << 40)) < F.col("cut"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.col("h"), F.lit(1 << 40)), "h"))
    return near.withColumn("nth", nth).filter("nth <= quota").select("h", "lang")


def train(docs: DataFrame, fit_rows: int = 3000, seed: int = 17, scale: float = 40.0) -> Model | None:
    """Model from the documents that may be learned from; None if no such document has letters.

    The regression is fitted on at most fit_rows different texts, those of least hash in each language;
    copies count once, so however many there are, no other text and no language is lost to them.  The
    frequencies of n-grams cover all documents.  Languages are taken to be few: the model has BUCKETS
    weights for each.
    """
    import numpy as np

    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))

    def frequencies(batches):
        import pyarrow as pa

        df, seen = np.zeros(BUCKETS + 1, dtype=np.int64), 0
        for batch in (part for whole in batches for part in parts(whole, 0)):
            for text in batch.column(0).to_pylist():
                here = np.zeros(BUCKETS, dtype=bool)
                for g in grams(text):
                    here[g] = True
                if here.any():
                    df[:-1] += here
                    seen += 1
        df[-1] = seen
        at = df.nonzero()[0]
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at), "df": pa.array(df[at])})

    df = np.zeros(BUCKETS + 1)
    for bucket, n in rows.select("text").mapInArrow(frequencies, "bucket long, df long").groupBy("bucket").agg(F.sum("df")).collect():  # at most BUCKETS + 1 rows
        df[bucket] = n
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    chosen = drawn_texts(rows.filter(F.col("text").rlike(r"\p{L}")).select(F.xxhash64("text", F.lit(seed)).alias("h"), "lang"), fit_rows)
    some = rows.withColumn("h", F.xxhash64("text", F.lit(seed))).join(F.broadcast(chosen), ["h", "lang"])  # at most fit_rows pairs

    def bags(batches):
        import pyarrow as pa

        met = set()  # at most fit_rows
        for batch in (part for whole in batches for part in parts(whole, 1)):
            out: list[list] = [[], [], [], []]
            for h, text, lang in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if (h, lang) in met:
                    continue
                met.add((h, lang))
                found = counted(text)
                if found is not None:
                    for column, value in zip(out, (h, lang, found[0].astype("<u2").tobytes(), found[1].astype("<u4").tobytes())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(list(map(pa.array, out, (pa.int64(), pa.string(), pa.binary(), pa.binary()))), names=["h", "lang", "at", "n"])

    drawn = some.select("h", "text", "lang").mapInArrow(bags, "h long, lang string, at binary, n binary")
    # copies are one row; texts whose hashes collide are two, the least of which counts
    drawn = drawn.distinct().groupBy("h", "lang").agg(F.min(F.struct("at", "n")).alias("b")).select("h", "lang", "b.*").orderBy("h", "lang")
    made, target, names = [], [], []
    for r in drawn.collect():  # at most fit_rows, each of at most 6 bytes for each bucket
        at, count = np.frombuffer(r["at"], dtype="<u2").astype(np.int64), np.frombuffer(r["n"], dtype="<u4")
        made.append((np.append(at, BUCKETS), np.append(scale * count / count.sum() * idf[at], 1.0)))
        names.append(r["lang"])
    langs = sorted(set(names))
    target = [langs.index(x) for x in names]
    if not made:
        return None
    cut = max(1, len(made) * 4 // 5)
    w = ftrl(made[:cut], target, len(langs))
    rest = range(cut, len(made)) if cut < len(made) else range(len(made))
    logits = np.array([made[i][1] @ w[made[i][0]] for i in rest])
    truth = np.array([target[i] for i in rest])

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]).mean())

    temperature = min(np.geomspace(0.05, 20, 200), key=loss)
    return Model((scale * idf[:, None] * w[:-1]).astype(np.float32), w[-1], langs, float(temperature))


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: str | None = None) -> DataFrame:
    """doc_id, lang_pred and score of every row; `keep` (a condition on both) returns whole rows instead.

    Null texts and texts without a letter are `und` with score 0; without a model all are.
    Repeated rows get equal results; other columns are ignored.
    """
    def guess_(texts):
        import numpy as np
        import pyarrow as pa

        lang, score = [], []
        for t in (t for part in parts(pa.RecordBatch.from_arrays([texts], ["t"]), 0) for t in part.column(0).to_pylist()):
            s = model.logits(t) if model is not None and t else None
            if s is None:
                lang.append("und")
                score.append(0.0)
                continue
            p = np.exp((s - s.max()) / model.temperature)
            k = int(p.argmax())
            lang.append(model.langs[k])
            score.append(float(p[k] / p.sum()))
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    guess = F.arrow_udf(guess_, "lang_pred string, score double")

    if keep is None:
        rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), guess(docs[text].cast("string")).alias("_guess"))
        return rows.select("doc_id", "_guess.lang_pred", "_guess.score")
    rows = docs.select(whole_row(docs).alias("row"), guess(docs[text].cast("string")).alias("guess"))
    return rows.filter(F.expr(keep.format(lang="guess.lang_pred", score="guess.score"))).select("row.*")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
