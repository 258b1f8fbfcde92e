"""Chat formatting: a finite-state machine over roles and a declarative template.

Rows of a conversation are read in order of turn.  The machine says whether each role may follow
what came before and which segments the turn becomes; every segment carries a loss flag.  Control
strings of the template that occur inside texts or role names are escaped reversibly.  Rows stream
through one sort by conversation and turn: a task holds one turn at a time, so even a conversation
with very many turns needs no memory of its own.  The reader parses the segments' text again by the
template alone and gives back roles, texts and what the loss mask covers.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, table

#: Characters (and 64 for each segment) that a batch of segments holds before it is sent on.
BATCH_CHARS = 2 << 20


@dataclass(frozen=True)
class Role:
    """How a role's turns are marked, and whether their text counts in the loss."""

    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role, marks of a role without marks of its own (its name stands between the first
    two), the escape character, and the machine: by state, the next state for each role."""

    roles: dict[str, Role] = field(hash=False)
    other: tuple[str, str, str]
    begin: str
    end: str
    machine: dict[str, dict[str, str]] = field(hash=False)
    start: str = "start"
    accept: tuple[str, ...] = ("assistant",)
    escape: str = "\\"

    def controls(self) -> list[str]:
        """All control strings, longest first."""
        marks = {self.begin, self.end, *self.other, *(m for r in self.roles.values() for m in (r.open, r.close))}
        return sorted(marks, key=lambda m: (-len(m), m))

    def check(self) -> Template:
        """Refuse templates whose control strings could arise where a text meets a mark."""
        marks = self.controls()
        if not all(marks) or self.escape in "".join(marks):
            raise ValueError("control strings must not be empty nor hold the escape character")
        for a in marks:
            for b in marks:
                for cut in range(1, len(a)):
                    if a is not b and (b.startswith(a[cut:]) or a[cut:].startswith(b)):
                        raise ValueError(f"{a!r} could end in the beginning of {b!r}")
        return self

    def escaped(self, text: str) -> str:
        """Text in which no control string occurs: the escape character goes before each and before itself."""
        return re.sub("|".join(map(re.escape, [self.escape, *self.controls()])), lambda m: self.escape + m[0] if m[0] == self.escape else m[0][0] + self.escape + m[0][1:], text)

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.?)", lambda m: m[1] if m[1] == self.escape else m[1], text, flags=re.S)


#: Marks in square brackets and angles; a system turn may come first, then user and assistant alternate.
TEMPLATE = Template(
    roles={"system": Role("[SYS]", "[/SYS]"), "user": Role("[INST]", "[/INST]"), "assistant": Role("[ANS]", "[/ANS]", loss=True)},
    other=("[ROLE]", "[TEXT]", "[/TEXT]"),
    begin="<s>",
    end="</s>",
    machine={"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}},
).check()


def segments_of(template: Template, role: str, text: str):
    """(text, loss) segments of one turn."""
    known = template.roles.get(role)
    if known:
        yield known.open, False
        yield template.escaped(text), known.loss
        yield known.close, False
    else:
        yield template.other[0] + template.escaped(role) + template.other[1], False
        yield template.escaped(text), False
        yield template.other[2], False


def read_segments(template: Template, formatted: str):
    """(role, text, loss) of each turn of formatted text, by the template alone."""
    pattern = re.compile("|".join(map(re.escape, template.controls())))
    opens = {r.open: (name, r) for name, r in template.roles.items()}
    at, role, out = 0, None, []
    loss = False
    for m in pattern.finditer(formatted):
        mark, before = m[0], formatted[at : m.start()]
        at = m.end()
        if mark in opens:
            role, loss = opens[mark][0], opens[mark][1].loss
        elif mark == template.other[1]:
            role, loss = template.unescaped(before), False
        elif mark == template.other[2] or (role in template.roles and mark == template.roles[role].close):
            out.append((role, template.unescaped(before), loss))
            role = None
    return out


def format_conversations(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Segments: conv_id, seq, turn, role, text, loss, valid.

    valid is false from the first turn on whose role the machine does not allow, and on the last
    segment also if the conversation ends in a state that does not accept.  Null texts and roles are
    empty; turns are ordered by turn (null first), equal turns by role and text; repeated rows are
    turns of their own; rows with a null conv_id are one conversation; other columns are ignored; an
    empty table gives none.  Batches are cut by size, so texts may be very long.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        import pyarrow as pa

        out: list[list] = [[] for _ in range(7)]
        conv, state, ok, seq, turn, room = object(), None, True, 0, None, BATCH_CHARS

        def put(*row):
            nonlocal room
            room -= 64 + len(row[3]) + len(row[4])
            for column, value in zip(out, row):
                column.append(value)

        def flush():
            nonlocal room
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()))], names=["conv_id", "seq", "turn", "role", "text", "loss", "valid"])
            for c in out:
                c.clear()
            room = BATCH_CHARS
            return batch

        started = False
        for batch in (part for whole in batches for part in parts(whole, 3)):
            for c, t, role, text in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if not started or c != conv:
                    if started:
                        put(conv, seq, turn, "", template.end, False, ok and state in template.accept)
                    started, conv, state, ok, seq = True, c, template.start, True, 1
                    put(c, 0, t, "", template.begin, False, True)
                follow = template.machine.get(state, {}).get(role)
                ok, state, turn = ok and follow is not None, follow or state, t
                for part, loss in segments_of(template, role, text):
                    put(c, seq, t, role, part, loss, ok)
                    seq += 1
                if room <= 0:
                    yield flush()
        if started:
            put(conv, seq, turn, "", template.end, False, ok and state in template.accept)
            yield flush()

    return rows.mapInArrow(run, "conv_id long, seq long, turn long, role string, text string, loss boolean, valid boolean")


def read_back(segments: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """One row for each conversation, parsed from the segments' text, whose rows must lie in order.

    Digests grow turn by turn, so only the text between two marks is held.
    """

    def run(batches):
        import pyarrow as pa

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        out: list[list] = [[] for _ in names]
        conv = now = None

        def close():
            if now is not None:
                for column, value in zip(out, (conv, now["n"], now["turns"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["size"], now["ok"])):
                    column.append(value)

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()))], names=names)
            for c in out:
                c.clear()
            return batch

        closing = {r.close for r in template.roles.values()} | {template.other[2]}
        for batch in (part for whole in batches for part in parts(whole, 4)):
            for c, seq, text, loss, ok in zip(*[batch.column(k).to_pylist() for k in ("conv_id", "seq", "text", "loss", "valid")]):
                if seq == 0:
                    close()
                    conv, now = c, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "ok": True, "held": [], "mask": []}
                now["size"] += len(text)
                now["ok"] = ok
                now["held"].append(text)
                if loss:
                    now["mask"].append(text)
                if text in closing:  # texts between are escaped, so this is a mark
                    for role, said, _ in read_segments(template, "".join(now["held"])):
                        now["n"] += 1
                        now["turns"].update(f"{role}\n{said}\n".encode())
                    masked = template.unescaped("".join(now["mask"]))
                    now["chars"] += len(masked)
                    now["loss"].update(masked.encode())
                    now["held"], now["mask"] = [], []
            if len(out[0]) >= 2048:
                yield flush()
        close()
        yield flush()

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(own)
    return read_back(format_conversations(rows))
