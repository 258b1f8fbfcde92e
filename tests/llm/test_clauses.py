"""Clauses of any length are read whole by the toxicity grammar; its scores against a scorer without automata."""

import itertools
import random

from weftline.llm import toxicity


def test_long_clauses():
    scorer = toxicity.Scorer(toxicity.Lexicon({"idiot$": 2.0}))
    filler = " ".join(f"w{i}" for i in range(60))
    for middle in ("", filler):
        best = lambda text: scorer.features(text.format(middle))[1]
        assert best("fine. you {} kill. you") == 2.0 * toxicity.WEIGHTS["aimed"]
        assert best("fine. he wrote {} idiot. you") == 2.0 * toxicity.WEIGHTS["aimed+reported"]
        assert best("you. he. {} kill. you") == 0.0


def brute(weights, text):
    """Sum of clause scores: every condition looked up anew for every word."""
    words = text.lower().split()
    total, insults = 0.0, set()
    ends = [i for i, w in enumerate(words) if w[-1] in ".!?;:" or i == len(words) - 1]
    for lo, hi in zip([0, *(e + 1 for e in ends[:-1])], ends):
        clause = [w.strip(toxicity.STRIP) for w in words[lo : hi + 1]]
        odds = [max([w for f, w in weights.items() if (f == c + "$" or "$" not in f and c.startswith(f))], default=0.0) for c in clause]
        verbs = {s + e for stems, endings in toxicity.VERBS for s, e in itertools.product(stems, endings)}
        kinds = ["i" if o else "t" if c in verbs else "n" if c in toxicity.NEGATIONS else "r" if c in toxicity.REPORTS else "w" if c in toxicity.INTENTS else "a" if c in toxicity.TARGETS else "o" for o, c in zip(odds, clause)]
        for i, k in enumerate(kinds):
            if k not in "it":
                continue
            aimed = "a" in kinds
            marks = (["aimed"] if aimed else []) + (["announced"] if k == "t" and "w" in kinds[:i] else [])
            marks += (["negated"] if "n" in kinds[max(0, i - toxicity.SCOPE) : i] else []) + (["reported"] if "r" in kinds[:i] else [])
            if k == "i" or aimed:
                total += (odds[i] or toxicity.THREAT_WEIGHT) * toxicity.WEIGHTS["+".join(sorted(marks)) or "plain"]
                insults.add(clause[i])
    return total, len(insults)


def test_scores_equal_brute_force():
    rng = random.Random(7)
    weights = {"idiot": 1.5, "fool$": 2.0, "dumb": 0.7, "dumbest$": 3.0}
    words = "idiot idiotic idiotisch fool fools dumb dumbest you du he said not never will kill kills killing töten tues mataré stabbed tree".split()
    scorer = toxicity.Scorer(toxicity.Lexicon(weights))
    for _ in range(400):
        text = " ".join(rng.choice(words) + rng.choice(["", "", "", "", ".", ",", "!"]) for _ in range(rng.randint(1, 25)))
        total, n = brute(weights, text)
        got = scorer.features(text)
        assert abs(got[0] - total) < 1e-9 and got[2] == n, text
