"""Toxicity by a weighted finite-state pattern grammar.

A transducer over letters reads each word: insults are learned word forms or word beginnings (in any
language) with log odds from labels as weights, threats are inflected verbs.  Its outputs are the
symbols of a clause, which transducers over symbols read in turn: insult and threat (is a threat
announced?), negation (covers the next few words), reported speech (covers the rest of the clause)
and target (an addressee in the clause).  The target transducer reads a clause in both directions;
the others and its forward half are composed into one.  Outputs name how an insult or threat stands
there, each reading has a weight, and a clause scores the weighted sum, so a denied or quoted insult
counts for less than one thrown at somebody; a threat counts only if it is aimed.  A logistic layer
maps a document's clause scores to a probability.  Learning uses a bounded sample of labelled rows;
scoring is one pass, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, parts, reliable, table

#: Closed word classes of the grammar (en, de, fr, es); verbs as stems with their endings.
VERBS = (
    (("kill", "hurt", "destroy", "beat", "stab", "stabb", "shoot", "burn", "crush", "murder", "strangl"), ("", "s", "es", "e", "ed", "ing", "en")),
    (("töt", "schlag", "schläg", "vernicht", "erschieß"), ("e", "st", "t", "en", "et", "te", "est")),
    (("tu", "frapp", "massacr"), ("e", "es", "er", "erai", "eras", "era", "ez", "ons")),
    (("détrui",), ("s", "t", "re", "rai", "ra", "sez")),
    (("mat", "golpe", "quem"), ("o", "as", "ar", "aré", "ará", "aremos", "arte", "arlos")),
    (("destru",), ("ir", "iré", "yo", "ye", "irte")),
)
TARGETS = "you your yours u he she they them him her du dich dir ihr euch sie tu toi vous te ton ils elle tú vosotros usted ustedes ti él ella".split()
NEGATIONS = "not never no isn't aren't don't doesn't nobody nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say wrote writes called calls quoted quote claims claimed reported sagte sagt schrieb nannte dit disait écrit appelle dijo dice escribió llamó".split()
INTENTS = "will gonna going shall i'll we'll werde werden wird vais va allons voy vamos".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT, OTHER, END = "insult threat target negation report intent other end".split()
ALPHABET = [INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT, OTHER, END]
#: Words that a negation covers, weight of a threat, and how much each reading of an insult or threat weighs.
SCOPE, THREAT_WEIGHT = 3, 2.0
WEIGHTS = {"plain": 1.0, "aimed": 1.4, "negated": 0.3, "reported": 0.6, "negated+reported": 0.2, "aimed+negated": 0.4, "aimed+reported": 0.8, "aimed+negated+reported": 0.25}
WEIGHTS |= {"+".join(sorted({"announced", *filter("plain".__ne__, k.split("+"))})): 1.2 * w for k, w in WEIGHTS.items()}
#: What is taken off the ends of a blank-delimited token.
STRIP = ".,;:!?\"'()[]{}«»„“”…-*#%$&"
STOPS = (".", "!", "?", ";", ":")


@dataclass(frozen=True)
class Transducer:
    """Deterministic: next state and output by (state, symbol); others loop and copy the symbol."""

    start: object
    steps: dict = field(hash=False)

    def step(self, state, symbol):
        base, _, marks = symbol.partition(":")
        nxt, mark = self.steps.get((state, base), (state, None))
        if mark:
            symbol = base + ":" + "+".join(sorted({mark, *filter(None, marks.split("+"))}))
        return nxt, symbol


def compose(first: Transducer, second: Transducer, alphabet: list[str]) -> Transducer:
    """The transducer that feeds the outputs of first to second, over reachable states."""
    start, steps = (first.start, second.start), {}
    todo, seen = [start], {start}
    while todo:
        state = todo.pop()
        for symbol in alphabet:
            a, out = first.step(state[0], symbol)
            b, out = second.step(state[1], out)
            mark = out.partition(":")[2]
            steps[(state, symbol)] = ((a, b), mark or None)
            if (a, b) not in seen:
                seen.add((a, b))
                todo.append((a, b))
    return Transducer(start, steps)


def target_machine() -> Transducer:
    """Marks insults and threats of a clause behind an addressee."""
    return Transducer(0, {(0, TARGET): (1, None), (1, END): (0, None)} | {(1, x): (1, "aimed") for x in (INSULT, THREAT)})


def grammar() -> Transducer:
    """Threat, then negation, then reported speech, then target."""
    threat = {(0, INTENT): (1, None), (1, END): (0, None), (1, THREAT): (1, "announced")}
    neg: dict = {(s, NEGATION): (SCOPE, None) for s in range(SCOPE + 1)}
    for s in range(1, SCOPE + 1):
        neg |= {(s, x): (s - 1, None) for x in (OTHER, TARGET, REPORT, INTENT)} | {(s, x): (s - 1, "negated") for x in (INSULT, THREAT)} | {(s, END): (0, None)}
    rep = {(0, REPORT): (1, None), (1, END): (0, None)} | {(1, x): (1, "reported") for x in (INSULT, THREAT)}
    machine = Transducer(0, threat)
    for follow in (Transducer(0, neg), Transducer(0, rep), target_machine()):
        machine = compose(machine, follow, ALPHABET)
    return machine


class Letters:
    """Weighted transducer over the letters of a word.

    States are the beginnings of known forms.  An insult's weight is the largest of those met on the
    way: a beginning ("begin") counts as soon as it is read, a whole form ("word$") at the word's end.
    """

    def __init__(self, weights: dict[str, float]):
        self.next: list[dict[str, int]] = [{}]
        self.weight, self.final, self.symbol = [0.0], [0.0], [None]
        for form, w in weights.items():
            if form.endswith("$"):
                at = self._state(form[:-1])
                self.final[at] = max(self.final[at], w)
            else:
                at = self._state(form)
                self.weight[at] = max(self.weight[at], w)
        classes = [(THREAT, [stem + e for stems, endings in VERBS for stem in stems for e in endings]), (NEGATION, NEGATIONS), (REPORT, REPORTS), (INTENT, INTENTS), (TARGET, TARGETS)]
        for symbol, words in classes:
            for word in words:
                at = self._state(word)
                self.symbol[at] = self.symbol[at] or symbol

    def _state(self, word: str) -> int:
        at = 0
        for letter in word:
            if letter not in self.next[at]:
                self.next[at][letter] = len(self.next)
                self.next.append({})
                for column, empty in ((self.weight, 0.0), (self.final, 0.0), (self.symbol, None)):
                    column.append(empty)
            at = self.next[at][letter]
        return at

    def __call__(self, word: str):
        """(symbol, weight) of a word, None for other words."""
        at, best = 0, 0.0
        for letter in word:
            at = self.next[at].get(letter, -1)
            if at < 0:
                break
            best = max(best, self.weight[at])
        if at >= 0:
            best = max(best, self.final[at])
        if best > 0:
            return INSULT, best
        symbol = self.symbol[at] if at > 0 else None
        return (symbol, THREAT_WEIGHT if symbol == THREAT else 0.0) if symbol else None


@dataclass
class Lexicon:
    """Weights of insulting word forms ("word$") and beginnings ("begin")."""

    weights: dict[str, float]
    shortest: int = 3
    longest: int = 9


def forms(word: str, shortest: int, longest: int):
    """What may carry a weight: the word itself and its beginnings."""
    yield word + "$"
    for n in range(shortest, min(longest, len(word)) + 1):
        yield word[:n]


class Scorer:
    """Features of texts under a lexicon: clause scores of the grammar."""

    def __init__(self, lexicon: Lexicon, memo: int = 250_000):
        self.machine, self.back = grammar(), target_machine()
        self.steps = self.machine.steps
        letters = Letters(lexicon.weights)

        class Known(dict):
            def __missing__(self, word):
                if len(self) >= memo:
                    self.clear()
                got = self[word] = letters(word.strip(STRIP))
                return got

        self.known = Known()

    def clause(self, symbols: list):
        """Marks of each symbol of a clause: what the composed machine says, and the target read backwards."""
        marks, state = [], self.back.start
        for symbol in reversed(symbols):
            state, out = self.back.step(state, symbol)
            marks.append(out.endswith(":aimed"))
        marks.reverse()
        state = self.machine.start
        for j, symbol in enumerate(symbols):
            state, mark = self.steps[(state, symbol)]
            if marks[j] and "aimed" not in (mark or ""):
                mark = "+".join(sorted({"aimed", *filter(None, (mark or "").split("+"))}))
            marks[j] = mark
        return marks

    def features(self, text: str | None):
        """(sum of clause scores, best clause, distinct insults, words, sum for 100 of words and 50 more)."""
        words = (text or "").lower().split()
        found = list(map(self.known.__getitem__, words))
        core = [i for i, x in enumerate(found) if x is not None and x[1] > 0]
        if not core:
            return 0.0, 0.0, 0, len(words), 0.0
        total = best = 0.0
        distinct = set()
        lo, at = 0, 0
        for hi, w in enumerate(words):  # clauses, each read once
            if not (w.endswith(STOPS) or hi == len(words) - 1):
                continue
            if at < len(core) and core[at] <= hi:
                symbols = [x[0] if x else OTHER for x in found[lo : hi + 1]]
                marks, score = self.clause(symbols), 0.0
                while at < len(core) and core[at] <= hi:
                    i = core[at]
                    symbol, weight = found[i]
                    mark = marks[i - lo]
                    if symbol == INSULT or "aimed" in (mark or ""):
                        score += weight * WEIGHTS[mark or "plain"]
                        distinct.add(words[i].strip(STRIP))
                    at += 1
                total += score
                best = max(best, score)
            lo = hi + 1
        return total, best, len(distinct), len(words), 100 * total / (len(words) + 50)


def vector(f):
    """Features as the logistic layer sees them."""
    import math

    total, best, distinct, words, rate = f
    return [1.0, math.log1p(total), math.log1p(best), math.log1p(distinct), math.log1p(rate), math.log1p(words) / 5]


@dataclass
class Model:
    lexicon: Lexicon
    coef: list[float]

    def score(self, features) -> float:
        import math

        s = sum(a * b for a, b in zip(self.coef, vector(features)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, s))))


def learn_lexicon(toxic: list[set[str]], clean: list[set[str]], least: int = 5, factor: float = 6.0, surprise: float = 22.0, shortest: int = 3, longest: int = 9) -> Lexicon:
    """Forms that mark toxic texts: odds of at least factor, with a likelihood ratio of at least surprise."""
    import math
    from collections import Counter

    def count(docs, only=None):
        c = Counter()
        for words in docs:
            here = {f for w in words for f in forms(w, shortest, longest)}
            c.update(here if only is None else here & only)
        return c

    t = count(toxic)
    t = Counter({f: n for f, n in t.items() if n >= least})
    c = count(clean, t.keys())
    nt, nc, out = len(toxic) + 1, len(clean) + 1, {}
    for f, n in t.items():
        odds = math.log((n + 0.5) / nt) - math.log((c[f] + 0.5) / nc)
        if odds > math.log(factor):
            p = (n + c[f]) / (nt + nc)
            ratio = sum(k * math.log(k / (m * q)) for k, m, q in ((n, nt, p), (nt - n, nt, 1 - p), (c[f], nc, p), (nc - c[f], nc, 1 - p)) if k)
            if 2 * ratio >= surprise:
                out[f] = odds
    return Lexicon(out, shortest, longest)


def fit_logistic(x, y, l2: float = 1e-2, rounds: int = 60):
    """Newton steps of penalised logistic regression."""
    import numpy as np

    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + l2 * len(y) * w * np.r_[0, np.ones(len(w) - 1)] / 100
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.eye(len(w)) * l2 * len(y) / 100
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, fit_toxic: int = 2000, fit_clean: int = 4000, seed: int = 11) -> Model:
    """Model from labelled documents that may be learned from, at most fit_toxic and fit_clean of them.

    Samples are the rows of least hash of doc_id; of several rows with one doc_id the smallest text
    stands for all.  The driver gets the sets of their words; clauses are read by the workers, and the
    logistic layer is fitted on features under a lexicon from the other half of the sample.
    Without labels of both kinds the score is 0.5 everywhere.
    """
    import numpy as np

    known = labels.filter(F.col("toxic").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    first = [known.filter(F.col("toxic") == toxic).orderBy("h", "doc_id").limit(most) for toxic, most in ((1, fit_toxic), (0, fit_clean))]
    # at most fit_toxic + fit_clean ids, so texts need no shuffle
    chosen = F.broadcast(first[0].unionByName(first[1]).select(F.col("doc_id").alias("id"), "toxic", "h"))
    texts = docs.select(docs["doc_id"].alias("id"), docs["text"].cast("string").alias("text")).filter("text is not null").join(chosen, "id")
    sample = reliable(texts.groupBy("id", "toxic", "h").agg(F.min("text").alias("text")))

    def words_of(batches):
        import pyarrow as pa

        for batch in (part for whole in batches for part in parts(whole, 3)):
            bags = [sorted({w.strip(STRIP) for w in t.lower().split()} - {""}) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "toxic": batch.column(1), "h": batch.column(2), "bag": pa.array(bags, pa.list_(pa.string()))})

    typed = sample.select(F.col("id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"), "h", "text")
    rows = sorted(typed.mapInArrow(words_of, "id long, toxic int, h long, bag array<string>").collect(), key=lambda r: (r["h"], r["id"]))
    if len({r["toxic"] for r in rows}) < 2:
        return Model(Lexicon({}), [0.0] * 6)
    bags, half = [set(r["bag"]) for r in rows], {r["id"]: i % 2 for i, r in enumerate(rows)}

    def lexicon_of(part):
        return learn_lexicon([bags[i] for i in part if rows[i]["toxic"]], [bags[i] for i in part if not rows[i]["toxic"]])

    other = [lexicon_of(range(1 - k, len(rows), 2)) for k in (0, 1)]

    def features_of(batches):
        import pyarrow as pa

        scorers = [Scorer(x) for x in other]
        for batch in (part for whole in batches for part in parts(whole, 3)):
            ids = batch.column(0).to_pylist()
            made = [vector(scorers[half[i]].features(t)) for i, t in zip(ids, batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "toxic": batch.column(1), "x": pa.array(made, pa.list_(pa.float64()))})

    fit = sorted(typed.mapInArrow(features_of, "id long, toxic int, x array<double>").collect(), key=lambda r: r["id"])
    coef = fit_logistic(np.array([r["x"] for r in fit]), np.array([r["toxic"] for r in fit], dtype=float))
    return Model(lexicon_of(range(len(rows))), coef.tolist())


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """doc_id, score, predicted and clause columns of every row.

    Null and empty texts score like a clean text; texts of any length are read whole; repeated rows
    get equal results; an empty table gives none; other columns are ignored.
    """

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(model.lexicon)
        for batch in (part for whole in batches for part in parts(whole, 1)):
            score, best, insults = [], [], []
            for t in batch.column(1).to_pylist():
                f = scorer.features(t)
                score.append(model.score(f))
                best.append(f[1])
                insults.append(f[2])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(score), "best_clause": pa.array(best), "n_insults": pa.array(insults, pa.int64())})

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, score double, best_clause double, n_insults long")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "best_clause", "n_insults")
