"""Personal data: regular expressions propose, checksums confirm, nearby words adjust the score.

Everything is a Spark SQL expression on one row; there is no shuffle and no Python on executors.

For each kind, splitting a text by the pattern gives the gaps and extracting all matches gives what
stands between them; running sums of their lengths are the positions in code points.  Patterns are
written so that the regex engine neither recurses nor scans a run twice: possessive quantifiers
where nothing after them could need the characters back, and, where a match can only begin at the
start of a run or right after the match before, an assertion that says so (\\G or a lookbehind).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole_row

#: Characters before and after a match in which words count as its context; lengths added up in one step.
CONTEXT, BLOCK = 40, 64


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    guard: a cheap necessary condition on the text.  valid: the confirming expression of a match.
    prior: score of a confirmed match; context words (lower case) add `boost`.  A match counts if
    its score reaches `least`; kinds of the base contract have least 0.
    """

    name: str
    pattern: str
    guard: str
    prior: float
    words: tuple[str, ...]
    base: bool = True
    least: float = 0.0
    boost: float = 0.2


#: The kinds and patterns of the base contract, in its order; then those added.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, ("mail", "contact", "write", "kontakt", "correo", "courriel")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.5, ("ip", "host", "server", "address", "login", "adresse")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]", 0.7, ("card", "visa", "credit", "pay", "karte", "carte", "tarjeta")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, ("phone", "call", "tel", "fax", "mobile", "ring")),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20(?![A-Z]{2}[0-9]{2}\x20)[A-Z0-9]{4}(?![A-Za-z0-9])){2,7}+(?:\x20[A-Z0-9]{1,3}(?![A-Za-z0-9]))?+)(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", 0.8, ("iban", "account", "bank", "konto", "cuenta"), base=False, least=0.5),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]", 0.4, ("ssn", "social", "security", "insurance"), base=False, least=0.5),
)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return acc + F.when(i % 2 == 0, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def mod97(c: Column) -> Column:
    """Whether a bank account number passes the mod-97 check."""
    plain = F.replace(c, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))

    def step(acc: Column, ch: Column) -> Column:
        v = F.ascii(ch)
        return F.when(v >= 65, (acc * 100 + v - 55) % 97).otherwise((acc * 10 + v - 48) % 97)

    return F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0), step) == 1


def iban_length(m: Column) -> Column:
    """Length of the longest part of a proposal, from its start to the end of a group, that is an account number; 0 if none."""
    groups = F.split(m, " ")
    joined = lambda k: F.array_join(F.slice(groups, F.lit(1), k), "")
    fits = lambda k: F.when(F.length(joined(k)).between(15, 34), mod97(joined(k))).otherwise(F.lit(False))
    ends = F.filter(F.reverse(F.sequence(F.lit(1), F.size(groups))), fits)
    return F.coalesce(F.length(F.array_join(F.slice(groups, F.lit(1), F.get(ends, F.lit(0))), " ")), F.lit(0))


def valid_length(kind: Kind, m: Column) -> Column:
    """Characters of a proposal, from its start, that pass the kind's check; 0 if none.

    A match of a base kind passes whole or not at all.
    """
    d = digits(m)
    if kind.name == "iban":
        return iban_length(m)
    if kind.name == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
        ok = m.rlike(rf"\A{part}(?:\.{part}){{3}}\z")
    elif kind.name == "card":
        ok = F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False))
    elif kind.name == "phone":
        ok = F.length(d).between(9, 15)
    else:
        return F.length(m)
    return F.when(ok, F.length(m)).otherwise(F.lit(0))


NO_INTS = "cast(array() AS array<int>)"


def blocks_of(values: str) -> str:
    """SQL for the numbers (from 0) of the blocks of an array."""
    return f"CASE WHEN size({values}) > 0 THEN sequence(0, cast(floor((size({values}) - 1) / {BLOCK}) AS int)) ELSE {NO_INTS} END"


def block_of(values: str) -> str:
    return f"slice({values}, b * {BLOCK} + 1, {BLOCK})"


def block_sums(values: str) -> Column:
    """Sum of each block of an array column."""
    return F.expr(f"transform({blocks_of(values)}, b -> aggregate({block_of(values)}, 0, (a, x) -> a + x))")


def running(values: str, start: str = "0") -> str:
    """SQL for the running sums of a short array, beginning from start."""
    first, following = f"named_struct('at', {start}, 'out', {NO_INTS})", "named_struct('at', acc.at + x, 'out', concat(acc.out, array(acc.at + x)))"
    return f"aggregate({values}, {first}, (acc, x) -> {following}).out"


def spread(values: str, sums: str) -> Column:
    """Running sums of an array column, given the running sums of its blocks' sums."""
    start = f"CASE WHEN b > 0 THEN get({sums}, b - 1) ELSE 0 END"
    return F.expr(f"CASE WHEN size({sums}) > 0 THEN flatten(transform({blocks_of(values)}, b -> {running(block_of(values), start)})) ELSE {NO_INTS} END")


def proposals(text: Column, kind: Kind) -> Column:
    """Struct of gaps and matches of a kind in a text (one gap more than matches)."""
    guard = text.contains("@") if kind.guard == "@" else text.rlike(kind.guard)
    none = F.struct(F.array(text).alias("gaps"), F.array().cast("array<string>").alias("matches"))
    some = F.struct(F.split(text, kind.pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("matches"))
    return F.when(guard, some).otherwise(none)


def around(found: Column) -> Column:
    """Array of struct(gap, match, after): each match with the text to the match before and after it."""
    n = F.size(found["matches"])
    zipped = F.arrays_zip(F.slice(found["gaps"], F.lit(1), n).alias("gap"), found["matches"].alias("match"), F.slice(found["gaps"], F.lit(2), n).alias("after"))
    return F.when(n > 0, zipped).otherwise(F.array().cast("array<struct<gap:string,match:string,after:string>>"))


def near_words(kind: Kind, one: Column) -> Column:
    """Whether context words stand before or after a match, up to the next matches of its kind."""
    words = r"\b(?:" + "|".join(kind.words) + ")"
    return F.lower(F.right(one["gap"], F.lit(CONTEXT))).rlike(words) | F.lower(F.left(one["after"], F.lit(CONTEXT))).rlike(words)


def score_of(kind: Kind, length: Column, near: Column) -> Column:
    """Score of a match, null if it does not count."""
    score = F.lit(kind.prior) + F.when(near, F.lit(kind.boost)).otherwise(F.lit(0.0))
    return F.when((length > 0) & (score >= kind.least), score)


def with_spans(rows: DataFrame, kinds: tuple[Kind, ...]) -> DataFrame:
    """doc_id and pii_<kind>, an array of struct(kind, start, end, score), from doc_id and found_<kind>.

    Each step reads columns of the step before several times, so the optimizer keeps the steps
    apart and nothing is computed again for every element: the cost is linear in the matches.
    Positions are running sums of lengths, in blocks of blocks.
    """
    names = [k.name for k in kinds]

    def looked_at(kind: Kind) -> Column:
        def look(m: Column) -> Column:
            return F.struct(F.length(m["gap"]).alias("g"), F.length(m["match"]).alias("m"), valid_length(kind, m["match"]).alias("v"), near_words(kind, m).alias("near"))

        return F.transform(around(F.col(f"found_{kind.name}")), look)

    ones = [f"one_{n}" for n in names]
    rows = rows.select("doc_id", *[c.alias(n) for c, n in zip(map(looked_at, kinds), ones)])
    rows = rows.select("doc_id", *ones, *[F.expr(f"CASE WHEN size(one_{n}) > 0 THEN transform(one_{n}, p -> p.g + p.m) ELSE {NO_INTS} END").alias(f"a_{n}") for n in names])
    rows = rows.select("*", *[block_sums(f"a_{n}").alias(f"b_{n}") for n in names])
    rows = rows.select("*", *[block_sums(f"b_{n}").alias(f"c_{n}") for n in names])
    rows = rows.select("*", *[F.expr(f"CASE WHEN size(c_{n}) > 0 THEN {running(f'c_{n}')} ELSE {NO_INTS} END").alias(f"d_{n}") for n in names])
    rows = rows.select("doc_id", *ones, *[f"a_{n}" for n in names], *[spread(f"b_{n}", f"d_{n}").alias(f"e_{n}") for n in names])
    rows = rows.select("doc_id", *ones, *[spread(f"a_{n}", f"e_{n}").alias(f"end_{n}") for n in names])

    def spans(kind: Kind) -> Column:
        def span(p: Column, e: Column) -> Column:
            score = score_of(kind, p["v"], p["near"])
            return F.struct(F.lit(kind.name).alias("kind"), (e - p["m"]).alias("start"), (e - p["m"] + p["v"]).alias("end"), score.alias("score"))

        return F.filter(F.zip_with(f"one_{kind.name}", f"end_{kind.name}", span), lambda r: r["score"].isNotNull())

    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    return rows.select("doc_id", *[F.when(F.size(f"one_{k.name}") > 0, spans(k)).otherwise(none).alias(f"pii_{k.name}") for k in kinds])


def written(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id, pii_<kind> span arrays and pii_spans, all spans by kind and start, for every row.

    Positions count code points, ends exclusive.  Null and empty texts have no spans; repeated rows
    get equal results; an empty table gives none; other columns of the input are ignored, so
    clashing names do no harm.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", *[proposals(F.col("text"), k).alias(f"found_{k.name}") for k in kinds])
    rows = with_spans(rows, kinds)
    return rows.withColumn("pii_spans", F.concat(*[F.col(f"pii_{k.name}") for k in kinds]))


def masked(kind: Kind):
    """Function of a match and its surroundings: the gap before it and what to show for the match."""

    def put(one: Column) -> Column:
        valid = valid_length(kind, one["match"])
        mark = F.lit(f"<{kind.name.upper()}>")
        if kind.name == "iban":  # a proposal may go on behind the number
            mark = F.concat(mark, F.substring(one["match"], valid + 1, F.length(one["match"])))
        shown = F.when(score_of(kind, valid, near_words(kind, one)).isNotNull(), mark).otherwise(one["match"])
        return F.concat(one["gap"], shown)

    return put


def redact_pii(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """The rows with every span that counts replaced by <KIND>, kind after kind, n_chars recounted.

    Cards and accounts go before phone numbers, whose pattern reads on over digits that follow.
    Null texts stay null; all other columns stay as they are; an empty table gives none.
    """
    order = {"email": 0, "iban": 1, "ip": 2, "card": 3, "ssn": 4, "phone": 5}
    rows = docs.select(whole_row(docs).alias("row"), docs[text].cast("string").alias("text"))
    for kind in sorted(kinds, key=lambda k: order.get(k.name, 9)):
        found = rows.withColumn("found", proposals(F.col("text"), kind))
        put = F.concat(F.array_join(F.transform(around(F.col("found")), masked(kind)), ""), F.element_at("found.gaps", -1))
        rows = found.withColumn("text", F.when(F.size("found.matches") > 0, put).otherwise(F.col("text"))).drop("found")
    out = {c: F.col("row")[c] for c in docs.columns} | {text: F.col("text")}
    if "n_chars" in out:
        out["n_chars"] = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), out["n_chars"])
    return rows.select(*[v.alias(c) for c, v in out.items()])


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    base = [k.name for k in KINDS if k.base]
    return found.select(
        "doc_id",
        *[F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in base],
        F.sha2(written(F.concat(*[F.col(f"pii_{k}") for k in base])), 256).alias("base_sha256"),
        written(F.col("pii_spans")).alias("spans"),
        F.array_join(F.transform("pii_spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )
