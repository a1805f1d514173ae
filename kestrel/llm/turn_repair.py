"""Repair of a conversation's structure at the least cost.

A conversation's rows in turn order are to have the role initials
``(s?(ua)+)?``. Keep costs nothing, Rerole (to user or assistant) 3, Delete 4,
Insert of an empty user or assistant turn 3; a truncated row that stays adds 3;
blank rows and repeats must go. Of the cheapest edits, those whose initials
(the audit) are ASCII-least are taken.

Both wishes are one integer. A path's weight has its cost in the high digits
and, below, one octal digit for each place of the audit: D, I, K, R are 1 to 4,
and the unused places at the end are 0, so that an audit comes before its own
continuations, as in ASCII order. An edit at place p weighs its cost plus its
letter at digit p, a path's weight is the plain sum, and a minimum of integers
over the graph (rows × four states of the pattern) decides everything. The letters and the repaired rows are read off the
winning integer. Two different paths to the same node never tie: with the same
cost neither audit continues the other, as every continuation costs something.

The width is fixed by taking ``BLOCK`` rows at a time. A block starts with one
more digit above the letters, the order of the audits of the states it starts
from. (States are taken just behind a row's edit; at that point the audits of
two states differ in a letter they both have, so their order is final.) Thus
weights stay short and a conversation of any length costs linear time.

What a reader makes of the repaired rows is folded block by block for each
state (``Fold``), so a task holds one block of rows, four folds and the audit.
A fold that keeps the rows (``TURNS``) holds them of one conversation; a digest
(``catalog``) holds no text. Rows of one conversation are read in
order by one task, as a SHA-256 of its text has to be; the sort before it spills,
equal rows are counted before they are shuffled, and a repeat is found by a
window that spills too.

Nulls: a null role or text is one space (such a row is blank or has no known
initial); null turns come first; null ids are one conversation. A role
without a known initial (the empty one too) has to be reroled or deleted. Ties
of a turn are in order of role, then text. Rows that are equal in turn, role
and text are repeats, also where a table holds them twice. A conversation of
which every row is dropped keeps a row of the result. An empty table gives
none. Other columns are ignored; ``gaps`` stops at 2^63 - 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import WHITE

BLOCK = 32
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LETTERS = "\0DIKR"  # the digit of a letter is its place
#: States of the pattern: nothing yet, after s, after u, after a; the next state by initial.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WANTED = ("user", "user", "assistant", "user")  # a turn that Rerole or Insert makes in a state
ENDS = (0, 3)
_PLACES = 3 * BLOCK + 2  # two inserts at most before a row and at the end
_WIDTH = 3 * (_PLACES + 1)


class Fold(NamedTuple):
    """What is made of the repaired rows, one after the other. ``add`` gives a
    new value and leaves the old one as it is."""

    start: Callable[[], Any]
    add: Callable[[Any, list[tuple[str, str]]], Any]
    done: Callable[[Any], Any]
    kind: str


def _unrolled(chain) -> list[dict]:
    parts = []
    while chain is not None:
        chain, rows = chain
        parts.append(rows)
    return [{"role": r, "text": t} for rows in reversed(parts) for r, t in rows]


#: The repaired rows themselves.
TURNS = Fold(lambda: None, lambda old, rows: (old, rows), _unrolled, "array<struct<role:string,text:string>>")


class Turn(NamedTuple):
    role: str
    text: str
    must_go: bool
    truncated: bool


def _edit(cost: int, letter: str, place: int) -> int:
    return (cost << _WIDTH) + (LETTERS.index(letter) << 3 * (_PLACES - 1 - place))


#: Weight of each edit at each place.
_WEIGHT = {(letter, late): [_edit(cost + late * TRUNCATED, letter, p) for p in range(_PLACES)]
           for letter, cost in (("D", DELETE), ("I", INSERT), ("K", 0), ("R", REROLE)) for late in (0, 1)}


def _step(nodes: dict[int, tuple[int, int]], turn: Turn) -> dict[int, tuple[int, int]]:
    """state → (least weight, places used) behind ``turn``'s edit."""
    out: dict[int, tuple[int, int]] = {}

    def offer(state: int, weight: int, place: int) -> None:
        if state not in out or weight < out[state][0]:
            out[state] = weight, place

    for state, (weight, place) in nodes.items():
        for inserted in range(3):
            offer(state, weight + _WEIGHT["D", 0][place], place + 1)
            if not turn.must_go:
                kept = NEXT[state].get(turn.role[:1])
                if kept is not None:
                    offer(kept, weight + _WEIGHT["K", turn.truncated][place], place + 1)
                offer(NEXT[state][WANTED[state][0]], weight + _WEIGHT["R", turn.truncated][place], place + 1)
            if inserted < 2:
                weight, place, state = weight + _WEIGHT["I", 0][place], place + 1, NEXT[state][WANTED[state][0]]
    return out


def _letters(weight: int) -> str:
    digits = f"{weight & ((1 << 3 * _PLACES) - 1):0{_PLACES}o}".rstrip("0")
    return "".join(LETTERS[int(x)] for x in digits)


def _replay(state: int, letters: str, turns: list[Turn]) -> list[tuple[str, str]]:
    """The rows that the edits leave, from ``state`` on."""
    out, at = [], 0
    for letter in letters:
        if letter == "I":
            out.append((WANTED[state], ""))
        else:
            turn, at = turns[at], at + 1
            if letter == "D":
                continue
            out.append((turn.role if letter == "K" else WANTED[state], turn.text))
        state = NEXT[state][out[-1][0][:1]]
    return out


class Repair:
    """One conversation, fed turn by turn."""

    def __init__(self, fold: Fold):
        self.fold, self.turns = fold, []
        # of each state: cost so far, audit as a chain of parts, fold, order among the states
        self.open = {0: (0, None, fold.start(), 0)}
        self._begin()

    def _begin(self) -> None:
        self.nodes = {s: ((cost << _WIDTH) + (rank << 3 * _PLACES), 0) for s, (cost, _, _, rank) in self.open.items()}
        self.turns = []

    def _close(self, state: int, weight: int) -> tuple:
        """What a state was before the block, and the block's letters behind it."""
        rank = (weight >> 3 * _PLACES) & 7
        start, (_, audit, made, _) = next((s, x) for s, x in self.open.items() if x[3] == rank)
        letters = _letters(weight)
        rows = _replay(start, letters, self.turns)
        return weight >> _WIDTH, (audit, letters), self.fold.add(made, rows) if rows else made

    def add(self, turn: Turn) -> None:
        if len(self.turns) == BLOCK:
            low = {s: w & ((1 << _WIDTH) - 1) for s, (w, _) in self.nodes.items()}
            order = sorted(low, key=low.get)
            self.open = {s: (*self._close(s, w), order.index(s)) for s, (w, _) in self.nodes.items()}
            self._begin()
        self.nodes = _step(self.nodes, turn)
        self.turns.append(turn)

    def done(self) -> tuple[int, str, Any]:
        """Cost, audit and fold of the best path to an end of the pattern."""
        best = None
        for state, (weight, place) in self.nodes.items():
            while state not in ENDS:
                weight, place, state = weight + _WEIGHT["I", 0][place], place + 1, NEXT[state][WANTED[state][0]]
            if best is None or weight < best[0]:
                best = weight, state
        cost, chain, made = self._close(best[1], best[0])
        parts = []
        while chain is not None:
            chain, part = chain
            parts.append(part)
        return cost, "".join(reversed(parts)), self.fold.done(made)


class _Conversation:
    """Counts of faults beside the repair."""

    LEGAL = {"su", "ua", "au"}

    def __init__(self, fold: Fold):
        self.repair, self.before = Repair(fold), None
        self.low = self.high = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        said = text.rstrip(WHITE)
        late = 0
        if not said:
            self.blank += 1
        elif again:
            self.duplicate += 1
        elif said[-1] not in ".!?":
            late = 1
            self.truncated += 1
        if self.before is not None and self.before + role[:1] not in self.LEGAL:
            self.illegal += 1
        self.before = role[:1]
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.distinct += turn != self.high
            self.high = turn
        self.repair.add(Turn(role, text, not said or again, late))

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (min(gaps, (1 << 63) - 1), self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.done())


def _repaired(fold: Fold, schema: pa.Schema):
    """Rows sorted by conversation and turn to one row for each conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now, out, size = object(), None, [], 0
        for batch in batches:
            for c, gone, turn, role, text, copies, first in zip(*(x.to_pylist() for x in batch.columns)):
                if now is None or c != conv:
                    if now is not None:
                        out.append((conv, *now.row()))
                        size += len(out[-1][7])
                        if len(out) == 1000 or size > 1 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
                            out, size = [], 0
                    conv, now = c, _Conversation(fold)
                if not gone:
                    for i in range(copies):
                        now.add(turn, role, text, i > 0 or not first)
        if now is not None:
            out.append((conv, *now.row()))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
    return run


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, gone): the rows of ``rows`` with
    faults by crc32 of ``conv_id:turn`` mod 20 (0 drops the row: ``gone``)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    base = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), space("role").alias("role"), space("text").alias("text"),
                       kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return base.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.when(F.col("kind") == 3, 2).otherwise(1).cast("bigint").alias("copies"), (F.col("kind") == 0).alias("gone"))


def repair(rows: DataFrame, fold: Fold = TURNS, made: str = "repaired", copies: Column | None = None, gone: Column | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    ``made``) of every conversation in ``rows`` (conv_id, turn, role, text).

    ``copies``: how often a row stands (else once); ``gone``: rows that only
    keep their conversation in the result.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    gone = F.lit(False) if gone is None else gone
    base = rows.select("conv_id", gone.alias("gone"), F.when(~gone, F.col("turn").cast("bigint")).alias("turn"),
                       F.when(gone, "").otherwise(space("role")).alias("role"), F.when(gone, "").otherwise(space("text")).alias("text"),
                       (F.lit(1).cast("bigint") if copies is None else copies).alias("copies"))
    counted = base.groupBy("conv_id", "gone", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    said = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    marked = counted.withColumn("first", F.row_number().over(said) == 1)
    ordered = marked.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    id_type = rows.schema["conv_id"].dataType.simpleString()
    out = (f"conv_id {id_type}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
           f"audit string, {made} {fold.kind}")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return ordered.mapInArrow(_repaired(fold, to_arrow_schema(StructType.fromDDL(out))), out)
