"""Repair of conversations by weighted finite-state composition.

A conversation is an acceptor of its rows, each a symbol of role initial and fault.  An edit transducer
reads a symbol and keeps, re-roles or deletes it, or writes a role out of nothing; a grammar accepts the
orders of roles that are wanted.  The three are composed lazily: a state is a place between rows and a
state of the grammar, and its arcs are made when it is reached.  Weights are pairs (cost, labels) in
lexicographic order.  Places are a topological order, so costs to the end are found from the last row to
the first, and labels by walking forward along the least label that lies on a cheapest path.  (Going
backward, a label is put before a rest, which keeps the order of rests; the other way round it does not.)

A conversation may hold a third of all rows, so rows are sorted by range over all tasks, and each run of
one conversation in a block of places is a segment.  A segment's costs between states of the grammar are
a (min, +) matrix; suffixes of a conversation's matrices give each segment the costs at its end, and maps
from entry to exit state give the state it begins in.  Only these small rows meet by conversation.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, reliable, table, with_hot, worker_state

#: Grammar (s?(ua)+)?: state and role initial to state; state 0 is the first, and these accept.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ACCEPT = 4, (0, 3)
#: Roles that an edit may write, by initial, and fixed values: what edits cost, and an undeleted truncated row.
WRITES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
INITIALS, FAULTS = "suax", ("", "blank", "duplicate", "truncated")
LEGAL = ("su", "ua", "au")
#: Rows of a segment at most, as a power of two.
SEGMENT_BITS = 12

#: What is counted in a segment: the first four as its rows lie, the others add up.
COUNTS = ("low", "high", "after", "before", "turns", "illegal", "blank", "duplicate", "truncated")

FAR = 1 << 60
NONBLANK = r"[^\x20\x09-\x0D]"


def edits(initial: str, fault: str):
    """Arcs of the edit transducer for a row: (label, initial written or "", cost)."""
    yield "D", "", DELETE
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        yield "K", initial, more
        for role in WRITES:
            yield "R", role, REROLE + more


class Composed:
    """Edit transducer and grammar, composed: arcs of a symbol, made once each, in the order of their labels."""

    def __init__(self):
        self.arcs: dict[int, list] = {}
        self.steps: dict[int, list] = {}
        self.inserts = [[("I", GRAMMAR[q, role], INSERT) for role in WRITES if (q, role) in GRAMMAR] for q in range(STATES)]

    def of(self, code: int) -> list:
        """For each state of the grammar, (label, next state, cost) of what may be done with a row."""
        if code not in self.arcs:
            initial, fault = INITIALS[code // 4], FAULTS[code % 4]
            follow = lambda q, out: q if not out else GRAMMAR.get((q, out))
            self.arcs[code] = [sorted((label, to, cost) for label, out, cost in edits(initial, fault) if (to := follow(q, out)) is not None) for q in range(STATES)]
        return self.arcs[code]

    def closed(self, costs: list[int]) -> list[int]:
        """Costs at a place once roles may be inserted there; no cheapest path inserts into one state twice."""
        for _ in range(STATES):
            costs = [min([costs[q], *(cost + costs[to] for _, to, cost in self.inserts[q])]) for q in range(STATES)]
        return costs

    def step(self, code: int) -> list[list[tuple[int, int]]]:
        """For each state before a row, (state after it, least cost with any roles inserted before it)."""
        if code not in self.steps:
            unit = [[0 if q == to else FAR for q in range(STATES)] for to in range(STATES)]
            columns = [self.closed([min([FAR, *(cost + one[to] for _, to, cost in arcs)]) for arcs in self.of(code)]) for one in unit]
            self.steps[code] = [[(to, columns[to][q]) for to in range(STATES) if columns[to][q] < FAR] for q in range(STATES)]
        return self.steps[code]

    def distances(self, codes: bytes, end: list[int]) -> list[list[int]]:
        """Costs from each place and state to the end, the last entry being `end`."""
        out, after = [end], end
        for code in reversed(codes):
            after = [min([cost + after[to] for to, cost in arcs]) for arcs in self.step(code)]
            out.append(after)
        return out[::-1]

    def finish(self) -> list[int]:
        """Costs after the last row of a conversation."""
        return self.closed([0 if q in ACCEPT else FAR for q in range(STATES)])

    def labels(self, codes: bytes, end: list[int], state: int, last: bool) -> tuple[str, int]:
        """The least labels of a cheapest path through a segment, and the state after it."""
        left, out = self.distances(codes, end), []
        for place, code in enumerate([*codes, None]):
            while True:
                here = left[place]
                choice = [(label, to, place) for label, to, cost in self.inserts[state] if cost + here[to] == here[state]]
                if code is None:
                    if not last or here[state] == 0:
                        return "".join(out), state
                else:
                    choice += [(label, to, place + 1) for label, to, cost in self.of(code)[state] if cost + left[place + 1][to] == here[state]]
                label, state, then = min(choice)
                out.append(label)
                if then > place:
                    break


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with faults by a hash of conversation and turn: dropped, emptied, without
    end marks, repeated, or said by the user; a null role or text is one space."""
    space = lambda c, kind="string": F.coalesce(rows[c].cast(kind), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    times = F.when(fault == 0, F.array_repeat(F.lit(0), 0)).when(fault == 3, F.array_repeat(F.lit(0), 2)).otherwise(F.array_repeat(F.lit(0), 1))
    return rows.select(rows["conv_id"], rows["turn"], F.when(fault == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.explode(times)).drop("col")


def sequence(rows: DataFrame) -> DataFrame:
    """Checkpointed rows in order: conv (text, "" for null), pos, turn, role, text, code (initial and fault)."""
    base = reliable(
        rows.select(
            F.coalesce(rows["conv_id"].cast("long").cast("string"), F.lit("")).alias("conv"), rows["turn"].cast("long").alias("turn"),
            F.coalesce(rows["role"].cast("string"), F.lit(" ")).alias("role"), F.coalesce(rows["text"].cast("string"), F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("row_no"),
        ).withColumn("mark", F.md5("text"))
    )
    key = ["conv", "role", "mark"]
    first = base.groupBy(*key).agg(F.min(F.struct("turn", "row_no")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    rows = with_hot(base, reliable(first), key, base.count(), "left")
    said = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    fault = F.when(~F.col("text").rlike(NONBLANK), 1).when(F.struct("turn", "row_no") > F.col("first"), 2).when(~F.substring(said, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) * 4 + fault
    order = ["conv", "turn", "role", "mark", "row_no"]
    ordered = rows.withColumn("code", code).repartitionByRange(*order).sortWithinPartitions(*order)
    return reliable(ordered.select("conv", F.monotonically_increasing_id().alias("pos"), "turn", "role", "text", "code"))


def segment(bits: int) -> Column:
    return F.shiftright(F.col("pos"), bits).alias("seg")


def segments(seq: DataFrame, bits: int) -> DataFrame:
    """One row for each run of a conversation in a block of 2**bits places: its codes, its matrix and its counts.

    A run that has other conversations on both sides is its whole conversation, and has no matrix.
    """

    def run(batches):
        import pyarrow as pa

        whole = Composed()
        now, codes, turns, before = None, bytearray(), [], None

        def close(after):
            pair = [INITIALS[c // 4] for c in codes]
            known = [t for t in turns if t is not None]
            unit = [[0 if q == to else FAR for q in range(STATES)] for to in range(STATES)]
            alone = before not in (None, now[0]) and after not in (None, now[0])
            columns = None if alone else [whole.distances(bytes(codes), end)[0] for end in unit]
            return {
                "conv": now[0], "seg": now[1], "codes": bytes(codes), "matrix": columns and [min(FAR, columns[to][q]) for q in range(STATES) for to in range(STATES)],
                "low": known[0] if known else None, "high": known[-1] if known else None, "turns": len(set(known)),
                "after": codes[0], "before": codes[-1], "illegal": sum(a + b not in LEGAL for a, b in zip(pair, pair[1:])), **{f: sum(c % 4 == k for c in codes) for k, f in enumerate(FAULTS) if f},
            }

        kinds = [("conv", pa.string()), ("seg", pa.int64()), ("codes", pa.binary()), ("matrix", pa.list_(pa.int64())), *((c, pa.int64()) for c in COUNTS)]
        out = []
        for batch in batches:
            for conv, seg, turn, code in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if (conv, seg) != now:
                    if now is not None:
                        out.append(close(conv))
                        before = now[0]
                    now, codes, turns = (conv, seg), bytearray(), []
                codes.append(code)
                turns.append(turn)
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))
                out = []
        if now is not None:
            out.append(close(None))
        yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))

    return seq.select("conv", segment(bits), "turn", "code").mapInArrow(run, "conv string, seg long, codes binary, matrix array<long>, " + ", ".join(f"{c} long" for c in COUNTS))


def ends(parts_: DataFrame) -> DataFrame:
    """conv, seg, ending (costs after the segment), last, and of the conversation: cost and counts, on its first segment."""

    def memo():
        """One composed machine for each worker, as groups come one by one."""
        return worker_state().setdefault("repair", None) or worker_state().update(repair=Composed()) or worker_state()["repair"]

    def run(key, rows):
        import pyarrow as pa

        rows = sorted(rows.to_pylist(), key=lambda r: r["seg"])
        whole, out = memo(), []
        now = whole.finish()
        for r in reversed(rows):
            out.append([r["conv"], r["seg"], now, r is rows[-1], *[None] * 6])
            if r["matrix"] is None:  # the only one
                now = [whole.distances(r["codes"], now)[0][0]]
                break
            m = r["matrix"]
            now = [min(FAR, *(m[q * STATES + to] + now[to] for to in range(STATES))) for q in range(STATES)]
        total = {c: sum(r[c] for r in rows) for c in COUNTS[4:]}
        for a, b in zip(rows, rows[1:]):
            total["illegal"] += INITIALS[a["before"] // 4] + INITIALS[b["after"] // 4] not in LEGAL
            total["turns"] -= a["high"] is not None and a["high"] == b["low"]
        low, high = [r["low"] for r in rows if r["low"] is not None], [r["high"] for r in rows if r["high"] is not None]
        gaps = max(high) - min(low) + 1 - total["turns"] if low else 0
        out[-1][4:] = [now[0], gaps, *(total[c] for c in COUNTS[5:])]
        kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), *[pa.int64()] * 6]
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["conv", "seg", "ending", "last", "cost", "gaps", *COUNTS[5:]])

    kind = "conv string, seg long, ending array<long>, last boolean, cost long, gaps long, " + ", ".join(f"{c} long" for c in COUNTS[5:])
    return parts_.select("conv", "seg", "matrix", F.when(F.col("matrix").isNull(), F.col("codes")).alias("codes"), *COUNTS).groupBy("conv").applyInArrow(run, kind)


def labelled(parts_: DataFrame, ended: DataFrame) -> DataFrame:
    """conv, seg, labels and state (of the grammar, at its first place) of each segment."""
    work = parts_.select("conv", "seg", "codes").join(ended.select("conv", "seg", "ending", "last"), ["conv", "seg"])

    def exits(batches):
        import pyarrow as pa

        whole = Composed()
        for batch in batches:
            to = [[0 if last else whole.labels(codes, end, q, last)[1] for q in range(STATES)] for codes, end, last in zip(*[batch.column(c).to_pylist() for c in ("codes", "ending", "last")])]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("seg"), batch.column("last"), pa.array(to, pa.list_(pa.int64()))], names=["conv", "seg", "last", "exits"])

    def entries(key, rows):
        import pyarrow as pa

        rows, state, out = sorted(rows.to_pylist(), key=lambda r: r["seg"]), 0, []
        for r in rows:
            out.append((r["conv"], r["seg"], state))
            state = r["exits"][state]
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["conv", "seg", "state"])

    def walk(batches):
        import pyarrow as pa

        whole = Composed()
        for batch in batches:
            said = [whole.labels(*row)[0] for row in zip(*[batch.column(c).to_pylist() for c in ("codes", "ending", "state", "last")])]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("seg"), batch.column("state"), pa.array(said, pa.string())], names=["conv", "seg", "state", "labels"])

    begun = work.mapInArrow(exits, "conv string, seg long, last boolean, exits array<long>").groupBy("conv").applyInArrow(entries, "conv string, seg long, state long")
    return work.join(begun, ["conv", "seg"]).mapInArrow(walk, "conv string, seg long, state long, labels string")


def applied(seq: DataFrame, said: DataFrame, bits: int) -> DataFrame:
    """conv, pos, nth, edit, role, text of the rows after repair, in order of pos and nth."""
    marks = said.select("conv", "seg", F.lit(-1).cast("long").alias("pos"), "labels", "state", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    rows = seq.select("conv", segment(bits), "pos", F.lit(None).cast("string").alias("labels"), F.lit(None).cast("long").alias("state"), "role", "text")
    both = marks.unionByName(rows).repartition("conv", "seg").sortWithinPartitions("conv", "seg", "pos")

    def run(batches):
        import pyarrow as pa

        labels, at, state, body = "", 0, 0, 0

        def inserts(conv, pos, nth):
            """Roles inserted at this place."""
            nonlocal at, state
            while at < len(labels) and labels[at] == "I":
                role = next(r for r in WRITES if (state, r) in GRAMMAR)
                at, state = at + 1, GRAMMAR[state, role]
                yield conv, pos, nth, "I", WRITES[role], ""
                nth += 1

        for batch in (part for whole in batches for part in parts(whole, 6)):
            out = []
            for conv, _, pos, said_, begin, role, text in zip(*[batch.column(i).to_pylist() for i in range(7)]):
                if pos < 0:
                    labels, at, state, body = said_, 0, begin, len(said_.rstrip("I"))
                    continue
                out += inserts(conv, pos, 0)
                edit, at = labels[at], at + 1
                if edit != "D":
                    if edit == "R":
                        role = next(WRITES[r] for r in WRITES if (state, r) in GRAMMAR)
                    state = GRAMMAR[state, role[0]]
                    out.append((conv, pos, STATES, edit, role, text))
                if at >= body:
                    out += inserts(conv, pos, STATES + 1)  # after the last row
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["conv", "pos", "nth", "edit", "role", "text"])

    return both.mapInArrow(run, "conv string, pos long, nth int, edit string, role string, text string")


def repair(rows: DataFrame, bits: int = SEGMENT_BITS) -> tuple[DataFrame, DataFrame]:
    """The repaired rows (conv_id, pos, nth, edit, role, text; to be read in order of pos and nth), and for each
    conversation conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit.

    rows: conv_id, turn, role, text.  They are taken by turn, null first, equal turns by role and a hash
    of the text; a null role or text is one space; rows with a null conv_id are one conversation; a role
    counts by its first character, an empty one never fits; repeated rows are rows of their own (and so
    duplicates); texts may be very long; other columns are ignored; an empty table gives none.  A
    conversation whose rows all go is repaired to none.
    """
    seq = sequence(rows)
    found = reliable(segments(seq, bits))
    ended = reliable(ends(found))
    said = reliable(labelled(found, ended))
    number = F.expr("try_cast(conv as long)").alias("conv_id")
    audit = said.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "labels"))), lambda x: x["labels"]), "").alias("audit"))
    of = ended.filter("cost is not null").join(audit, "conv").select(number, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return applied(seq, said, bits).select(number, "pos", "nth", "edit", "role", "text"), of


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: role:text of a conversation's rows joined by newlines, hashed as they stream by."""
    rows = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "nth").select("conv_id", "role", "text")

    def run(batches):
        import pyarrow as pa

        now, grown, out = None, None, []
        for batch in (part for whole in batches for part in parts(whole, 2)):
            for conv, role, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if grown is None or conv != now:
                    if grown is not None:
                        out.append((now, grown.hexdigest()))
                    now, grown = conv, hashlib.sha256()
                else:
                    grown.update(b"\n")
                grown.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.string()))], names=["conv_id", "repaired_sha256"])
            out = []
        if grown is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([grown.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return rows.mapInArrow(run, "conv_id long, repaired_sha256 string")


def repaired_digests(conversations: DataFrame, bits: int = SEGMENT_BITS) -> DataFrame:
    """What repair finds in damaged conversations, one row for each conversation before the damage, with the digest of its repaired rows."""
    rows, found = repair(damaged(conversations), bits)
    every = conversations.select(conversations["conv_id"].cast("long").alias("conv_id")).distinct()
    found = found.withColumnRenamed("conv_id", "id")
    sha = digests(rows).withColumnRenamed("conv_id", "own")
    out = every.join(found, every["conv_id"].eqNullSafe(found["id"]), "left").join(sha, every["conv_id"].eqNullSafe(sha["own"]), "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *map(number, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_digests(table(spark, sf_dir, "conversations"))
