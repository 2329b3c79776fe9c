"""Conversation repair: the cheapest edits that make turns alternate.

A conversation is good if the initials of its roles read ``(s?(ua)+)?``: nothing, or
an optional system turn and pairs of user and assistant. Edits and costs: Keep 0 (the
initial fits), Rerole to user or assistant 2, Delete 3, Insert an empty user or
assistant turn 2. Blank and duplicate turns must be deleted; a truncated turn that
stays adds 1.

The turns are aligned by the Wagner-Fischer recurrence to the grammar's string of each
feasible length. A plain repair's cost is the incumbent, and Ukkonen's band follows from
it: a length more than cost / 2 above or cost / 3 below the turns is out, and so is a
cell from which insertions or deletions alone would cost more. The strings of all
lengths end alike, so their tables share their cells. Alignments of the least cost are
traced back and their edits' initials (D, I, K, R) compared; the least in ASCII order
is taken.

Faults, the first that holds: blank (no character other than space and 0x09-0x0D),
duplicate (role and text of an earlier turn), truncated (the last such character is
none of ``.!?``). Null roles and texts are one space, so they are blank or fit no
initial. Turns come by turn (nulls first), then role and text; equal rows are
adjacent, and one is a duplicate of the other. Rows of null id are one conversation.
An id whose only rows are not ``present`` is returned with zeros and empty strings.

Spark partitions and sorts rows by conversation; a task streams them and holds one
conversation at a time. Its table takes turns x 5/6 of the plain repair's cost, and its
repaired turns are one row in any case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weft.llm.common import bounded_batches, tidy

BLANK = " \t\n\x0b\x0c\r"
RESULT = (
    "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, roles array<string>, texts array<string>"
)
DELETE, KEEP, REROLE, INSERT = "D", "K", "R", "I"
DELETE_COST, CHANGE_COST, INSERT_COST = 3, 2, 2
LEGAL = frozenset(("su", "ua", "au"))
ROLES = {"u": "user", "a": "assistant"}
SHORT, SHAPES = 64, 1 << 14
_FAR = np.int64(1) << 40
Turn = tuple[str, bool, bool]


def greedy(turns: tuple[Turn, ...]) -> int:
    """Cost of a plain repair, the first incumbent: delete what must go, give each other turn the role due."""
    cost, place = 0, 0
    for initial, must_go, truncated in turns:
        if must_go:
            cost += DELETE_COST
            continue
        cost += truncated + CHANGE_COST * (initial != "ua"[place % 2])
        place += 1
    return min(cost + INSERT_COST * (place % 2), DELETE_COST * len(turns))


class Table:
    """Costs from turn i and r places before the target's end to both ends, inside the incumbent's band.

    The alternating strings of all lengths end alike, so one table serves them all. From
    a cell at least 3 (n - i - r) or 2 (r - n + i) must still be paid; ``above`` and
    ``below`` bound r - (n - i) where that is no more than the incumbent.
    """

    def __init__(self, turns: tuple[Turn, ...], incumbent: int):
        self.turns, n = turns, len(turns)
        self.below, self.above = incumbent // DELETE_COST, incumbent // INSERT_COST
        size = self.below + self.above + 1
        offset = np.arange(size) - self.below
        paid = INSERT_COST * np.arange(size)
        self.rows = np.full((n + 1, size + 1), _FAR)
        self.rows[n, :size] = np.where(offset >= 0, INSERT_COST * offset, _FAR)
        for i in range(n - 1, -1, -1):
            initial, must_go, truncated = turns[i]
            left, after = offset + n - i, self.rows[i + 1]
            row = DELETE_COST + after[1:]
            if not must_go:
                fits = (left % 2 == 0) if initial == "u" else (left % 2 == 1) if initial == "a" else False
                row = np.where(left > 0, np.minimum(row, after[:-1] + truncated + np.where(fits, 0, CHANGE_COST)), row)
            row = np.where(left >= 0, row, _FAR)
            # Insertions: the least over all smaller r, at 2 a place.
            self.rows[i, :size] = np.minimum(np.minimum.accumulate(row - paid) + paid, _FAR)

    def cost(self, i: int, left: int) -> int:
        k = left - len(self.turns) + i + self.below
        return int(self.rows[i, k]) if 0 <= k < self.rows.shape[1] - 1 else int(_FAR)

    def audit(self, i: int, left: int) -> str:
        """The ASCII-least edits of least cost from a cell on."""
        edits = []
        while i < len(self.turns) or left:
            here = self.cost(i, left)
            if i < len(self.turns) and here == DELETE_COST + self.cost(i + 1, left):
                edits.append(DELETE)
                i += 1
            elif left and here == INSERT_COST + self.cost(i, left - 1):
                edits.append(INSERT)
                left -= 1
            else:
                edits.append(KEEP if self.turns[i][0] == "au"[left % 2 == 0] else REROLE)
                i, left = i + 1, left - 1
        return "".join(edits)


def align(turns: tuple[Turn, ...]) -> tuple[int, str, str]:
    """(cost, audit, target) of the cheapest repair; the ASCII-least audit among equals."""
    n = len(turns)
    incumbent = greedy(turns)
    table = Table(turns, incumbent)
    # A system turn can only be kept, as the first: all turns before it are deleted.
    systems = [i for i, t in enumerate(turns) if t[0] == "s" and not t[1] and DELETE_COST * i <= incumbent]
    ends = [(table.cost(0, m), m, -1) for m in range(0, n + table.above + 1, 2)]
    ends += [
        (DELETE_COST * i + turns[i][2] + table.cost(i + 1, m), m, i)
        for i in systems for m in range(2, n - i + table.above + 1, 2)
    ]
    least = min(e[0] for e in ends)
    audits = []
    for cost, m, i in ends:
        if cost == least:
            head = DELETE * i + KEEP if i >= 0 else ""
            audits.append((head + table.audit(i + 1, m), "s" * (i >= 0) + "ua" * (m // 2)))
    return (least, *min(audits))


def cheapest(turns: tuple[Turn, ...], memo: dict) -> tuple[int, str, str]:
    """``align``, remembering the short conversations of a task: most have one of few shapes."""
    if len(turns) > SHORT:
        return align(turns)
    if turns not in memo:
        if len(memo) >= SHAPES:
            memo.clear()
        memo[turns] = align(turns)
    return memo[turns]


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """First fault of each (role, text): blank, duplicate, truncated or none (empty)."""
    seen: set[tuple[str, str]] = set()
    out = []
    for row in rows:
        text = row[1].rstrip(BLANK)
        if not text:
            out.append("blank")
        elif row in seen:
            out.append("duplicate")
        else:
            out.append("" if text[-1] in ".!?" else "truncated")
        seen.add(row)
    return out


def repaired(rows: list[tuple[str, str]], memo: dict) -> tuple:
    """(blank, duplicate, truncated, illegal, cost, audit, roles, texts) of one conversation's rows."""
    found = faults(rows)
    initials = [role[:1] for role, _ in rows]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    turns = tuple((i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, found))
    cost, audit, target = cheapest(turns, memo)
    roles, texts, own, place = [], [], iter(rows), 0
    for edit in audit:
        role, text = next(own) if edit != INSERT else ("", "")
        if edit == DELETE:
            continue
        roles.append(role if edit == KEEP else ROLES[target[place]])
        texts.append(text)
        place += 1
    return found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, roles, texts


def _repair(result: pa.Schema):
    """Task: one row per conversation from rows sorted by conversation and turn."""

    def finish(key, rows, turns, memo) -> tuple:
        known = [t for t in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        return (key, gaps, *repaired(rows, memo))

    def table(made: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*made)) or [[]] * len(result)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, result)], schema=result)

    def run(incoming):
        memo: dict = {}
        key, rows, turns, begun = None, [], [], False
        for batch in incoming:
            made = []
            for one, turn, role, text, present in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if not begun or one != key:
                    if begun:
                        made.append(finish(key, rows, turns, memo))
                    key, rows, turns, begun = one, [], [], True
                if present:
                    rows.append((role, text))
                    turns.append(turn)
            yield table(made)
        if begun:
            yield table([finish(key, rows, turns, memo)])

    return run


def repair(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", present_col: str | None = None,
) -> DataFrame:
    """(id_col, gaps, blank, duplicate, truncated, illegal, cost, audit, roles, texts) of each conversation.

    ``roles`` and ``texts`` are the repaired turns. ``gaps`` counts whole numbers missing
    between the least and the greatest turn. Rows whose ``present_col`` is false only
    name their conversation.
    """
    bounded_batches(conversations.sparkSession)
    blank = F.lit(" ")
    rows = conversations.select(
        F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), blank).alias("role"), F.coalesce(F.col(text_col).cast("string"), blank).alias("text"),
        (F.coalesce(F.col(present_col), F.lit(False)) if present_col else F.lit(True)).alias("present"),
    )
    sorted_ = rows.repartition("id").sortWithinPartitions("id", F.col("turn").asc_nulls_first(), "role", "text")
    kind = rows.schema["id"].dataType
    schema = RESULT.format(id=kind.simpleString())
    result = to_arrow_schema(StructType.fromDDL(schema))
    return sorted_.mapInArrow(tidy(_repair(result)), schema).withColumnRenamed("conv_id", id_col)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, present) after the contract's damage.

    By crc32(`conv_id:turn`) % 20: 0 drops the row (not ``present``), 1 empties its text, 2
    takes ``[.!?]`` out of it, 3 repeats it, 4 sets its role to user. Nulls are one space.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), code.alias("code"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("code") != 0).alias("present"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def digest(made: DataFrame) -> DataFrame:
    """Counts, cost, audit and the SHA-256 of the repaired turns as lines ``role:text``."""
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    return made.withColumn("repaired_sha256", F.sha2(lines, 256)).drop("roles", "texts")
