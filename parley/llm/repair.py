"""Structure repair of conversations by iterative-deepening A*."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import WHITE, stored

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Rows of a conversation that are searched together.
BLOCK = 128
#: What has been written so far: nothing, a system turn, a user turn last, an assistant turn last. The first and the last may end.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ENDS = frozenset({EMPTY, ASSISTANT})
_KEEP = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_LEGAL = frozenset({"su", "ua", "au"})
_NEVER = 1 << 60


class Row(NamedTuple):
    role: str
    text: str
    fault: str  # '', 'blank', 'duplicate' or 'truncated'


def fault(text: str, repeated: bool) -> str:
    seen = text.rstrip(WHITE)
    if not seen:
        return "blank"
    return "duplicate" if repeated else "" if seen[-1] in ".!?" else "truncated"


def written(state: int) -> tuple[str, int]:
    """The role that an inserted or rewritten turn takes here, and the state after it."""
    return ("assistant", ASSISTANT) if state == USER else ("user", USER)


def cheapest(rows: list[Row], entry: int = EMPTY, goals: frozenset[int] = ENDS) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from ``entry`` to one of ``goals``, the ASCII-least among equals; None if there are none.

    Depth-first search in the order D, I, K, R under a bound on the cost that grows to the least
    cost beyond it. What a failed state has at least ahead of it is kept over all bounds, so a
    state is only entered again with more to spend than has failed. Before that, a row that must
    go or is truncated costs what it costs in any case. The first path that arrives is the answer.
    """
    stays = any(r.role[:1] == "s" and r.fault not in ("blank", "duplicate") for r in rows)
    if not any(g in (USER, ASSISTANT) or g == entry or (g == SYSTEM and entry == EMPTY and stays) for g in goals):
        return None
    n = len(rows)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + {"": 0, "truncated": TRUNCATED}.get(rows[i].fault, DELETE)
    failed: dict[tuple[int, int], int] = {}

    def edits(i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        if i < n:
            yield "D", DELETE, i + 1, state
        role, after = written(state)
        yield "I", INSERT, i, after
        if i < n and rows[i].fault not in ("blank", "duplicate"):
            more = TRUNCATED if rows[i].fault else 0
            kept = _KEEP.get((state, rows[i].role[:1]))
            if kept is not None:
                yield "K", more, i + 1, kept
            if rows[i].role != role:
                yield "R", REROLE + more, i + 1, after

    def search(i: int, state: int, budget: int) -> tuple[int, str | None]:
        if i == n and state in goals:
            return 0, ""
        least = failed.get((i, state), ahead[i])
        if least > budget:
            return least, None
        least = _NEVER
        for letter, cost, j, after in edits(i, state):
            if cost > budget:
                more, rest = failed.get((j, after), ahead[j]), None
            else:
                more, rest = search(j, after, budget - cost)
            if rest is not None:
                return cost + more, letter + rest
            least = min(least, cost + more)
        failed[i, state] = least
        return least, None

    bound = ahead[0]
    while True:
        cost, audit = search(0, entry, bound)
        if audit is not None:
            return cost, audit
        bound = cost


def rewrite(rows: list[Row], audit: str, state: int = EMPTY) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn that the edits leave."""
    todo = iter(rows)
    for letter in audit:
        row = next(todo) if letter != "I" else None
        if letter == "D":
            continue
        role, after = written(state)
        if letter == "K":
            role, after = row.role, _KEEP[state, row.role[:1]]
        yield role, row.text if row else ""
        state = after


class Repair:
    """One conversation, row by row: its counts, and the cheapest edits so far into each state."""

    def __init__(self, block: int = BLOCK) -> None:
        self.block, self.rows = block, []
        self.ways = {EMPTY: (0, "", hashlib.sha256())}
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.turns, self.first, self.turn, self.role = 0, None, None, None

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        if len(self.rows) == self.block:
            self._advance([frozenset({g}) for g in range(4)])
        row = Row(role, text, fault(text, repeated))
        self.rows.append(row)
        if row.fault:
            self.counts[row.fault] += 1
        if self.role is not None:
            self.counts["illegal"] += self.role[:1] + role[:1] not in _LEGAL
        self.role = role
        if turn is not None and turn != self.turn:
            self.first, self.turn, self.turns = turn if self.first is None else self.first, turn, self.turns + 1

    def _advance(self, goals: list[frozenset[int]]) -> None:
        """Over the rows held, from every state to each of ``goals``; of equal costs the ASCII-least edits from the start."""
        ways: dict = {}
        for goal in goals:
            found = []
            for state, (cost, audit, _) in self.ways.items():
                if (way := cheapest(self.rows, state, goal)) is not None:
                    found.append((cost + way[0], audit + way[1], state, way[1]))
            if found:
                cost, audit, state, last = min(found)
                digest, empty = self.ways[state][2].copy(), state == EMPTY
                for role, text in rewrite(self.rows, last, state):
                    digest.update(f"{'' if empty else '\n'}{role}:{text}".encode("utf-8", "surrogatepass"))
                    empty = False
                ways[min(goal)] = cost, audit, digest
        self.ways, self.rows = ways, []

    def end(self) -> dict:
        self._advance([ENDS])
        ((cost, audit, digest),) = self.ways.values()
        gaps = 0 if self.first is None else self.turn - self.first + 1 - self.turns
        return {"gaps": gaps, **self.counts, "cost": cost, "audit": audit, "repaired_sha256": digest.hexdigest()}


OUT = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string", "repaired_sha256": "string"}


def repair(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conv_id of ``turns(conv_id, turn, role, text)``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Which rows say again what their conversation has heard comes from an aggregate by
    conversation, role and text. Conversations then pass through their tasks in order, and each
    is searched in stretches of ``block`` rows from every state to every state, which are put
    together by cost and audit; so a task holds one stretch, however long a conversation is, and
    the digest runs along. Shorter ones are one search from start to end.

    Null role or text is one space. Rows go by turn, nulls first, then by role and text. A null
    conv_id is a conversation like others. An empty table gives no rows; other columns are ignored.
    """
    said = ["conv_id", "role", "text"]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    rows = stored(rows.groupBy(*said, "turn").agg(F.count(F.lit(1)).alias("n")))
    first = stored(rows.groupBy(*said).agg(F.min(F.struct("turn"))["turn"].alias("first")).withColumnsRenamed({c: f"f_{c}" for c in said}))
    same = F.col("conv_id").eqNullSafe(F.col("f_conv_id")) & (F.col("role") == F.col("f_role")) & (F.col("text") == F.col("f_text"))
    told = rows.join(first.hint("merge"), same).select("conv_id", "turn", "role", "text", "n", (~F.col("turn").eqNullSafe(F.col("first"))).alias("again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *(pa.string() if k == "string" else pa.int64() for k in OUT.values())]

        def done(ended: list[tuple]) -> pa.RecordBatch:
            columns = zip(*((i, *out.values()) for i, out in ended), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", *OUT])

        own, at = None, None
        for b in batches:
            ended = []
            for conv, turn, role, text, n, again in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own is None or conv != at:
                    if own is not None:
                        ended.append((at, own.end()))
                    own, at = Repair(block), conv
                for copy in range(n):
                    own.add(turn, role, text, again or copy > 0)
            if ended:
                yield done(ended)
        if own is not None:
            yield done([(at, own.end())])

    told = told.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return told.mapInArrow(run, ", ".join(["conv_id long", *(f"{c} {t}" for c, t in OUT.items())]))


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): a twentieth each of the rows dropped, emptied, without ends, repeated or given to the user, by crc32 of ``conv_id:turn``."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))
