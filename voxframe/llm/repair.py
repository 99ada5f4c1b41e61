"""Conversation structure repair: the cheapest edits of the turns that give roles a grammar accepts.

The search is Dijkstra's on the implicit lattice of nodes (turns done, grammar state). Edges keep, rerole or delete the next turn or insert one
before it; the priority is (cost, audit), where the audit is the string of the edits' initials; the first accepting end node that is popped is the result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANKS = " \t\n\x0b\x0c\r"
_ENDS = ".!?"
SOUND, TRUNCATED, BLANK, DUPLICATE = 0, 1, 2, 3


@dataclass(frozen=True)
class Grammar:
    """States and what leads from one to another by a role's initial; `offers` are the roles that a state takes by rerole or insert."""

    start: int = 0
    accepting: frozenset[int] = frozenset({0, 3})
    moves: dict[tuple[int, str], int] = field(default_factory=lambda: {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2})
    offers: dict[int, tuple[str, ...]] = field(default_factory=lambda: {0: ("user",), 1: ("user",), 2: ("assistant",), 3: ("user",)})


@dataclass(frozen=True)
class Costs:
    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class _Audit:
    """A string that grows by letters at its end: full blocks are shared by all strings that go on from them, so a node of the lattice holds
    at most one block of its own, and two strings are compared from their last common block."""

    __slots__ = ("block", "tail")
    BLOCK = 64

    def __init__(self, block: tuple | None = None, tail: str = ""):
        self.block, self.tail = block, tail  # block: (block before, text, number of blocks)

    def then(self, letter: str) -> _Audit:
        if len(self.tail) < self.BLOCK:
            return _Audit(self.block, self.tail + letter)
        return _Audit((self.block, self.tail, self.block[2] + 1 if self.block else 1), letter)

    def __lt__(self, other: _Audit) -> bool:
        a, b, x, y = self.block, other.block, self.tail, other.tail
        while a is not b:
            deep_a, deep_b = a[2] if a else 0, b[2] if b else 0
            if deep_a >= deep_b:
                a, text_a = a[0], a[1]
            if deep_b >= deep_a:
                b, text_b = b[0], b[1]
            if deep_a > deep_b:
                x = text_a
            elif deep_b > deep_a:
                y = text_b
            elif text_a != text_b:
                x, y = text_a, text_b
        return x < y if x != y else len(self) < len(other)

    def __len__(self) -> int:
        return (self.block[2] * self.BLOCK if self.block else 0) + len(self.tail)

    def __str__(self) -> str:
        parts, block = [self.tail], self.block
        while block:
            parts.append(block[1])
            block = block[0]
        return "".join(reversed(parts))


def cheapest_edits(turns: list[tuple[str, int]], grammar: Grammar = Grammar(), costs: Costs = Costs()) -> tuple[int, str, list[tuple[int | None, str | None]]]:
    """Cost, audit and what stays, for turns given as (initial of the role, fault).

    What stays is named by the turn's number (None: inserted) and its new role (None: its own). Turns that are blank or repeated must be deleted; one that
    is truncated costs more where it stays. The search settles each (turn, state) once, so a conversation takes time and memory in proportion to its turns.
    """
    n = len(turns)
    settled, came = set(), {}
    heap: list[tuple] = [(0, _Audit(), 0, grammar.start, None, None)]
    while heap:
        cost, audit, i, state, before, made = heapq.heappop(heap)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        came[i, state] = before, made
        if i == n and state in grammar.accepting:
            stays, node = [], (i, state)
            while node is not None:
                node, made = came[node]
                if made is not None:
                    stays.append(made)
            return cost, str(audit), stays[::-1]
        here = (i, state)
        for role in grammar.offers[state]:
            to = grammar.moves[state, role[0]]
            if (i, to) not in settled:
                heapq.heappush(heap, (cost + costs.insert, audit.then("I"), i, to, here, (None, role)))
        if i == n:
            continue
        initial, fault = turns[i]
        heapq.heappush(heap, (cost + costs.delete, audit.then("D"), i + 1, state, here, None))
        if fault in (BLANK, DUPLICATE):
            continue
        more = cost + (costs.truncated if fault == TRUNCATED else 0)
        if (state, initial) in grammar.moves:
            heapq.heappush(heap, (more + costs.keep, audit.then("K"), i + 1, grammar.moves[state, initial], here, (i, None)))
        for role in grammar.offers[state]:
            heapq.heappush(heap, (more + costs.rerole, audit.then("R"), i + 1, grammar.moves[state, role[0]], here, (i, role)))
    raise ValueError("no edits lead to an accepted order of roles")


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with planted faults, and `gone` for rows that were dropped.

    A null role or text is one blank. By crc32 of `conv_id:turn` (a null there is one blank) modulo 20: 0 drops the row, 1 empties its text, 2 takes out the marks
    that end sentences, 3 repeats it, 4 makes its role user.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), kind.alias("kind"))
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy", "kind")


def _repaired(conv_id: int | None, rows: list[tuple[int | None, str, str]], grammar: Grammar, costs: Costs) -> tuple:
    seen, turns, faults = set(), [], [0, 0, 0, 0]
    for _, role, text in rows:
        bare = text.rstrip(_BLANKS)
        fault = BLANK if not bare else DUPLICATE if (role, text) in seen else TRUNCATED if bare[-1] not in _ENDS else SOUND
        seen.add((role, text))
        faults[fault] += 1
        turns.append((role[:1], fault))
    numbers = {t for t, _, _ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(turns, turns[1:], strict=False))
    cost, audit, stays = cheapest_edits(turns, grammar, costs)
    out = [{"role": role or rows[i][1], "text": rows[i][2] if i is not None else ""} for i, role in stays]
    return conv_id, gaps, faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], illegal, cost, audit, out


_SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"
_TURN = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def repair_conversations(conversations: DataFrame, grammar: Grammar = Grammar(), costs: Costs = Costs()) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (array of role, text) for each conv_id of conversations (conv_id, turn, role, text).

    Turns are read by turn, nulls first, then role and text, so that ties and repeated rows have one order. A turn's first fault counts: blank (nothing but
    blanks), duplicate (a turn before has its role and text) or truncated (its last character that is no blank ends no sentence). gaps are numbers that lack between the least and the
    greatest turn; illegal are neighbours in the wrong order. Where edits of equal cost exist, the audit that is least in ASCII is taken.

    A null role or text is one blank; null conv_ids are one conversation; rows whose `gone` is true, where there is such a column, count only as a mention of their
    conversation, and one without other rows has zeros and an empty audit; other columns are ignored; an empty table gives no rows. Conversations are dealt by conv_id and streamed in
    order: a task holds one conversation's turns at a time.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    gone = F.coalesce(F.col("gone").cast("boolean"), F.lit(False)) if "gone" in conversations.columns else F.lit(False)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"), gone.alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out, begun = None, [], [], False

        def handed() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64()] * 7 + [pa.string(), _TURN]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[p.split(" ")[0] for p in _SCHEMA.split(", ")])

        for b in batches:
            for conv_id, turn, role, text, is_gone in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not begun or conv_id != now:
                    if begun:
                        out.append(_repaired(now, held, grammar, costs))
                    now, held, begun = conv_id, [], True
                    if len(out) >= 512:
                        yield handed()
                        out = []
                if not is_gone:
                    held.append((turn, role, text))
        if begun:
            out.append(_repaired(now, held, grammar, costs))
            yield handed()

    line = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    return line.mapInArrow(run, _SCHEMA)


def repaired_text(repaired: Column) -> Column:
    """`role:text` of each turn, one a line."""
    return F.array_join(F.transform(repaired, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
