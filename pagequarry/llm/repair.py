r"""Conversation structure repair as secondary-sorted streaming.

Rows are repartitioned by conversation and sorted by turn, last turn first; one
``mapInPandas`` pass streams them and carries, from batch to batch, the cheapest cost of
making the rest of the conversation right from each state of the pattern
``(s?(ua)+)?`` over role initials. What is best in each state at a row fits in one byte,
two bits a state. When the first turn is reached these bytes are followed forwards, which
gives the cheapest edits, of equal ones those whose initials come first in ASCII.

A conversation of more than ``held_rows`` rows or ``held_chars`` characters isn't held:
its bytes leave the task as blocks of a written table, and a second pass, first turn
first, reads blocks and rows side by side. Memory is bounded in both, but for the audit
and one byte a row, since a conversation's audit is one value of the result.

Edits: Keep costs 0, Rerole to user or assistant 3, Delete 4, Insert of an empty turn 3.
Blank and duplicate rows must be deleted; truncated rows that stay cost 3 more. A row has
its first fault only: blank (nothing but white space), duplicate (role and text seen
earlier in the conversation), truncated (the last character is none of ``.!?``).

Defined results: rows are ordered by turn (null first), then role, then text, so repeated
rows follow each other; null roles and texts count as one space; an empty role has no
initial, so it can't be kept; rows of null ``conv_id`` are one conversation; rows whose
``absent`` holds only name their conversation, which is then empty if it has no others;
an empty table gives no rows; extra columns are ignored. The whole conversation passes
through one task, as the streaming order demands, however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.session import stage

HELD_ROWS, HELD_CHARS = 20_000, 16 << 20
#: Rows of a block of backpointers, and of a part of the repaired turns.
BLOCK = 65_536
DELETE, INSERT, KEEP, REROLE = range(4)
LETTERS = "DIKR"
COST = {DELETE: 4, INSERT: 3, REROLE: 3}
#: States: nothing yet, after a system turn, after a user's, after an assistant's (may end).
START, SYSTEM, USER, ASSISTANT = range(4)
#: The turn that a state asks for, and the state after it.
WANTS = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
AFTER = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Cost from each state at the end of a conversation.
AT_END = (0, 6, 3, 0)
FAULTS = ("", "blank", "duplicate", "truncated")

REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "part int, turns array<struct<edit:string,role:string,text:string>>"
STREAM = f"conv string, kind string, {REPORT}, {TURNS}, block int, back binary, turn string, role string, text string"
FIELDS = [f.split()[0] for f in STREAM.replace("struct<edit:string,role:string,text:string>", "x").split(", ")]
COUNTED = ("blank", "duplicate", "truncated")


def kept_state(state: int, initial: str) -> int | None:
    """The state after a kept turn, None if the pattern has no place for it."""
    if initial == "s":
        return SYSTEM if state == START else None
    return AFTER[state] if initial and initial == WANTS[state][0] else None


class Automaton:
    """Costs-to-go one row further back; few distinct steps occur, so each is worked out once."""

    def __init__(self):
        self.known: dict[tuple, tuple] = {}

    def step(self, costs: tuple[int, ...], initial: str, fault: str) -> tuple[tuple[int, ...], int, int]:
        """``(costs less their least, that least, best edits of the four states in one byte)``."""
        key = (costs, initial if initial in "sua" else "", fault)
        if key not in self.known:
            self.known[key] = self._step(*key)
        return self.known[key]

    def _step(self, costs, initial, fault):
        options: list[dict[int, int]] = []
        extra = 3 if fault == "truncated" else 0
        for state in range(4):
            found = {DELETE: COST[DELETE] + costs[state]}
            if fault not in ("blank", "duplicate"):
                after = kept_state(state, initial)
                if after is not None:
                    found[KEEP] = extra + costs[after]
                found[REROLE] = COST[REROLE] + extra + costs[AFTER[state]]
            options.append(found)
        best = [min(o.values()) for o in options]
        for _ in range(3):  # three insertions lead through all states
            best = [min(best[s], COST[INSERT] + best[AFTER[s]]) for s in range(4)]
        back = 0
        for state, found in enumerate(options):
            found[INSERT] = COST[INSERT] + best[AFTER[state]]
            back |= min(edit for edit, cost in found.items() if cost == best[state]) << (2 * state)
        least = min(best)
        return tuple(b - least for b in best), least, back


def edits(state: int, back: int) -> Iterator[tuple[int, str, int]]:
    """The edits at one row, insertions before it first: ``(edit, role it calls for, state after)``."""
    while True:
        edit = back >> (2 * state) & 3
        role, after = WANTS[state], AFTER[state]
        yield edit, role, after
        if edit != INSERT:
            return
        state = after


class Writer:
    """Follows the backpointers forwards: audit, digest, and the repaired turns if asked for."""

    def __init__(self, turns: bool):
        self.state, self.audit, self.sha, self.first = START, bytearray(), hashlib.sha256(), True
        self.keeps, self.turns = turns, []

    def _out(self, edit: int, role: str, text: str) -> None:
        self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False
        if self.keeps:
            self.turns.append({"edit": LETTERS[edit], "role": role, "text": text})

    def row(self, back: int, role: str, text: str) -> None:
        for edit, wanted, after in edits(self.state, back):
            self.audit.append(ord(LETTERS[edit]))
            if edit == INSERT:
                self._out(edit, wanted, "")
            elif edit == REROLE:
                self._out(edit, wanted, text)
            elif edit == KEEP:
                self._out(edit, role, text)
                after = kept_state(self.state, role[:1])
            if edit != DELETE:
                self.state = after

    def end(self) -> None:
        while AT_END[self.state]:
            self.audit.append(ord(LETTERS[INSERT]))
            self._out(INSERT, WANTS[self.state], "")
            self.state = AFTER[self.state]


class Conversation:
    """What one conversation carries from row to row, last turn first."""

    def __init__(self, conv: str | None):
        self.conv, self.costs, self.cost = conv, AT_END, 0
        self.count = dict.fromkeys(COUNTED, 0)
        self.illegal, self.later = 0, None
        self.high = self.low = None
        self.distinct = 0
        self.back, self.rows, self.chars = bytearray(), [], 0
        self.giant, self.blocks = False, 0

    def add(self, automaton: Automaton, turn: str | None, role: str, text: str, fault: str, limits: tuple[int, int]) -> None:
        initial = role[:1]
        self.costs, more, back = automaton.step(self.costs, initial, fault)
        self.cost += more
        self.back.append(back)
        if fault:
            self.count[fault] += 1
        if self.later is not None and initial + self.later not in ("su", "ua", "au"):
            self.illegal += 1
        self.later = initial
        if turn is not None:
            number = int(turn)
            self.distinct += number != self.low
            self.low = number
            self.high = number if self.high is None else self.high
        self.chars += len(role) + len(text)
        if not self.giant:
            self.rows.append((role, text))
            if len(self.rows) > limits[0] or self.chars > limits[1]:
                self.giant, self.rows = True, []

    def spill(self, first: tuple[str | None, str, str]) -> dict:
        """The bytes so far as a block, placed before its first row."""
        turn, role, text = first
        block = {"conv": self.conv, "kind": "block", "block": self.blocks, "back": bytes(reversed(self.back)), "turn": turn, "role": role, "text": text}
        self.blocks, self.back = self.blocks + 1, bytearray()
        return block

    def report(self) -> dict:
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.distinct
        return {"conv": self.conv, "gaps": gaps, "illegal": self.illegal, "cost": self.cost + self.costs[START], **self.count}


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({f: pd.Series([r.get(f) for r in rows], dtype=object) for f in FIELDS})


def _written(writer: Writer, report: dict, part: int, turns: bool) -> dict:
    if turns:
        return {"conv": report["conv"], "kind": "turns", "part": part, "turns": writer.turns}
    return report | {"kind": "report", "audit": writer.audit.decode(), "repaired_sha256": writer.sha.hexdigest()}


def _backwards(turns: bool, limits: tuple[int, int], block: int):
    """The first pass: last turn first. Whole conversations are answered, giant ones spilled."""

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, talk, first = Automaton(), None, None

        def ended() -> Iterator[dict]:
            if talk.giant:
                if talk.back:
                    yield talk.spill(first)
                yield talk.report() | {"kind": "giant"}
                return
            writer = Writer(turns)
            for back, (role, text) in zip(reversed(talk.back), reversed(talk.rows)):
                writer.row(back, role, text)
            writer.end()
            yield _written(writer, talk.report(), 0, turns)

        for batch in batches:
            out: list[dict] = []
            columns = [batch[c] for c in ("conv", "turn", "role", "text", "fault", "absent")]
            for conv, turn, role, text, fault, absent in zip(*columns):
                conv = None if pd.isna(conv) else conv
                if talk is None or conv != talk.conv:
                    if talk is not None:
                        out += ended()
                    talk = Conversation(conv)
                if absent:
                    continue
                first = (None if pd.isna(turn) else turn, role, text)
                talk.add(automaton, *first, FAULTS[fault], limits)
                if talk.giant and len(talk.back) >= block:
                    out.append(talk.spill(first))
            if out:
                yield _frame(out)
        if talk is not None:
            yield _frame(list(ended()))

    return stream


def _forwards(turns: bool, block: int):
    """The second pass, over giant conversations: report, then blocks and rows, first turn first."""

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        report = writer = None
        backs: list[Iterator[int]] = []
        part = 0

        def after() -> int:
            while True:
                found = next(backs[0], None)
                if found is not None:
                    return found
                backs.pop(0)

        def ended() -> dict:
            writer.end()
            return _written(writer, report, part, turns)

        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                if row["kind"] == "giant":
                    if writer is not None:
                        out.append(ended())
                    conv = None if pd.isna(row["conv"]) else row["conv"]
                    report = {"conv": conv} | {c: int(row[c]) for c in ("gaps", "illegal", "cost", *COUNTED)}
                    writer, backs, part = Writer(turns), [], 0
                elif row["kind"] == "block":
                    backs.append(iter(row["back"]))
                else:
                    writer.row(after(), row["role"], row["text"])
                    if len(writer.turns) >= block:
                        out.append(_written(writer, report, part, True))
                        writer.turns, part = [], part + 1
            if out:
                yield _frame(out)
        if writer is not None:
            yield _frame([ended()])

    return stream


def marked(rows: DataFrame) -> DataFrame:
    """``(conv, turn, role, text, fault, absent, _nth)``, each conversation's rows in one partition.

    ``fault`` is a place in ``FAULTS``; ``_nth`` numbers rows alike, the first of which is no duplicate. Earlier rows alike are found by a window inside the
    partitions of the conversations, so the texts are shuffled once.
    """
    one = lambda c: F.coalesce(F.col(c), F.lit(" "))
    absent = F.coalesce(F.col("absent"), F.lit(False)) if "absent" in rows.columns else F.lit(False)
    slim = rows.select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"),
        one("role").alias("role"), one("text").alias("text"), absent.alias("absent"),
    )
    alike = W.partitionBy("conv", "absent", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    seen = F.trim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    fault = (
        F.when(seen == "", 1)
        .when(F.col("_nth") > 1, 2)
        .when(~F.substring(seen, -1, 1).isin(".", "!", "?"), 3)
        .otherwise(0)
    )
    numbered = slim.repartition("conv").withColumn("_nth", F.row_number().over(alike))
    return numbered.select("conv", "turn", "role", "text", fault.alias("fault"), "absent", "_nth")


def _run(rows: DataFrame, turns: bool, held_rows: int, held_chars: int, block: int) -> DataFrame:
    whole = marked(rows)
    order = [F.col("conv").asc_nulls_first(), F.col("turn").desc_nulls_last(), F.desc("role"), F.desc("text"), F.desc("_nth")]
    given = ["conv", F.col("turn").cast("string").alias("turn"), "role", "text"]
    back = whole.sortWithinPartitions(*order).select(*given, "fault", "absent")
    first = stage(back.mapInPandas(_backwards(turns, (held_rows, held_chars), block), STREAM), "repair")
    done = first.filter(F.col("kind").isin("report", "turns"))
    giants = first.filter("kind = 'giant'")
    if giants.isEmpty():
        return done
    # a conversation's name may be null: null joins null here
    names = giants.select(F.col("conv").alias("_conv"))
    again = whole.filter(~F.col("absent")).join(names, F.col("conv").eqNullSafe(F.col("_conv")), "left_semi")
    again = again.select("conv", F.lit("row").alias("kind"), F.col("turn").cast("string").alias("turn"), "role", "text")
    spilled = first.filter(F.col("kind").isin("giant", "block")).select(
        "conv", "kind", "turn", "role", "text", "gaps", "illegal", "cost", *COUNTED, "block", "back"
    )
    both = spilled.unionByName(again, allowMissingColumns=True).repartition("conv")
    rank = F.when(F.col("kind") == "giant", 0).otherwise(1)
    line = [F.col("conv").asc_nulls_first(), rank, F.col("turn").cast("long").asc_nulls_first(), "role", "text", "kind", F.desc("block")]
    return done.unionByName(both.sortWithinPartitions(*line).mapInPandas(_forwards(turns, block), STREAM))


def report(rows: DataFrame, held_rows: int = HELD_ROWS, held_chars: int = HELD_CHARS, block: int = BLOCK) -> DataFrame:
    """One row per conversation: its faults, the cost and audit of its repair, and the digest of the repaired turns.

    ``rows`` hold conv_id, turn, role, text, and may hold a boolean ``absent``.
    """
    kind = rows.schema["conv_id"].dataType
    found = _run(rows, False, held_rows, held_chars, block)
    return found.select(F.col("conv").cast(kind).alias("conv_id"), *[f.split()[0] for f in REPORT.split(", ")])


def repaired(rows: DataFrame, held_rows: int = HELD_ROWS, held_chars: int = HELD_CHARS, block: int = BLOCK) -> DataFrame:
    """The repaired turns: ``(conv_id, place, edit, role, text)``, ``place`` from 0, deleted ones left out."""
    kind = rows.schema["conv_id"].dataType
    found = _run(rows, True, held_rows, held_chars, block)
    # parts of a giant conversation hold ``block`` turns or a few more, so places count up but may skip
    parts = found.select("conv", "part", F.posexplode("turns").alias("at", "own"))
    place = F.col("part").cast("long") * (2 * block) + F.col("at")
    return parts.select(F.col("conv").cast(kind).alias("conv_id"), place.alias("place"), "own.*")


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after one fault in five, drawn by the crc32 of ``conv_id:turn``; dropped ones are absent."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw: Column = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.translate(one("text"), ".!?", "")).otherwise(one("text"))
    copies = F.array_repeat(F.lit(0), F.when(draw == 3, 2).otherwise(1))
    return conversations.select(
        "conv_id", "turn", F.when(draw == 4, "user").otherwise(one("role")).alias("role"),
        text.alias("text"), (draw == 0).alias("absent"), F.explode(copies).alias("_copy"),
    ).drop("_copy")
