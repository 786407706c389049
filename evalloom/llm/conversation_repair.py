"""Operator 12: repair of conversations by A* on the edit lattice.

A node of the lattice is (rows consumed, state of the role pattern); edges keep, rerole or delete the next row or insert
an empty turn. The search is keyed (cost + heuristic, audit), where the audit is the string of edits so far. The heuristic
adds up, over the rows that are left, the deletions that blank and duplicate rows need and the charge of one that a
truncated row can't avoid (deleting it costs more). It never falls by more than an edge costs, so the first time that a
node leaves the queue its cost is least, and among equal costs its audit is least in ASCII order.

Rows arrive sorted by conversation and turn, and a task holds ``segment`` rows of a conversation at a time: after each
segment there is one best (cost, audit) a state, and the next segment's search starts from these. That is exact: paths that
meet in a node differ before it only, and audits of equal cost are never prefixes of each other, since a further insertion
costs. The hash of the repaired text runs along, one for each state. So one conversation of any length takes the memory of
its audit, though, as its hash is one chain, one task.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import partitions

#: Rows of a conversation that one search covers.
SEGMENT = 256

#: The pattern ``(s?(ua)+)?`` of role initials: by state, the states that an initial leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: What a reroled or inserted turn becomes, by state; a whole pattern ends in one of FINAL.
NEXT_ROLE = ("user", "user", "assistant", "user")
FINAL = (START, ASSISTANT)
KEEP, REROLE, DELETE, INSERT = "KRDI"
PRICE = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}

FAULTS = ("blank", "duplicate", "truncated")
_OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


@dataclass
class Path:
    """The best way to a state: its cost and audit, and the hash of the repaired rows."""

    cost: int = 0
    audit: str = ""
    digest: object = field(default_factory=hashlib.sha256)
    empty: bool = True

    def extended(self, edits: str, cost: int, state: int, rows: list[tuple[str, str]]) -> Path:
        """This path with the ``edits`` of ``rows`` (role, text) after it, from ``state``."""
        out = Path(cost, self.audit + edits, self.digest.copy(), self.empty)
        at = 0
        for edit in edits:
            role, text = ("", "") if edit == INSERT else rows[at]
            at += edit != INSERT
            if edit == DELETE:
                continue
            if edit != KEEP:
                role = NEXT_ROLE[state]
            state = STEPS[state][role[:1]]
            out.digest.update(f"{'' if out.empty else chr(10)}{role}:{text}".encode())
            out.empty = False
        return out


def search(starts: dict[int, Path], initials: list[str], faults: list[str | None], whole: bool) -> dict[int, tuple[int, str, int]]:
    """Best ``(cost, edits of these rows, start state)`` by the state after the rows; if ``whole``, of the best final one only."""
    n = len(initials)
    left = [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        left[k] = left[k + 1] + (PRICE[DELETE] if faults[k] in ("blank", "duplicate") else faults[k] == "truncated")
    queue = [(p.cost + left[0], p.audit, 0, state, state, p.cost) for state, p in starts.items()]
    heapq.heapify(queue)
    seen: set[tuple[int, int]] = set()
    out: dict[int, tuple[int, str, int]] = {}
    while queue:
        _, audit, at, state, start, cost = heapq.heappop(queue)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == n and (not whole or state in FINAL):
            out[state] = cost, audit[len(starts[start].audit) :], start
            if whole or len(out) == len(STEPS):
                break

        def go(edit: str, to: int, then: int, more: int = 0, audit=audit, start=start, cost=cost) -> None:
            total = cost + PRICE[edit] + more
            heapq.heappush(queue, (total + left[to], audit + edit, to, then, start, total))

        ahead = STEPS[state][NEXT_ROLE[state][0]]
        go(INSERT, at, ahead)
        if at < n:
            go(DELETE, at + 1, state)
            if faults[at] not in ("blank", "duplicate"):
                charge = int(faults[at] == "truncated")
                go(REROLE, at + 1, ahead, charge)
                if initials[at] in STEPS[state]:
                    go(KEEP, at + 1, STEPS[state][initials[at]], charge)
    return out


class Conversation:
    """Counts of one conversation's rows, in order, and the frontier of its search."""

    def __init__(self, segment: int = SEGMENT):
        self.segment = segment
        self.counts = dict.fromkeys(FAULTS, 0)
        self.illegal = self.turns = 0
        self.first = self.last = self.initial = None
        self.frontier = {START: Path()}
        self.rows: list[tuple[str, str]] = []
        self.faults: list[str | None] = []

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if len(self.rows) == self.segment:
            self._advance(whole=False)
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        if turn is not None:
            self.turns += turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        self.rows.append((role, text))
        self.faults.append(fault)

    def _advance(self, whole: bool) -> None:
        initials = [role[:1] for role, _ in self.rows]
        found = search(self.frontier, initials, self.faults, whole)
        self.frontier = {state: self.frontier[start].extended(edits, cost, start, self.rows) for state, (cost, edits, start) in found.items()}
        self.rows, self.faults = [], []

    def result(self) -> tuple:
        self._advance(whole=True)
        (best,) = self.frontier.values()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (gaps, *(self.counts[f] for f in FAULTS), self.illegal, best.cost, best.audit, best.digest.hexdigest())


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, there``: the rows after damage by crc32(conv_id:turn) % 20; dropped rows aren't ``there``."""
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(key) % 20).alias("damage"),
    )

    def when(damage: int, value: Column, otherwise: Column) -> Column:
        return F.when(F.col("damage") == damage, value).otherwise(otherwise)

    text = when(1, F.lit(""), when(2, F.regexp_replace("text", "[.!?]", ""), F.col("text")))
    copies = F.array_repeat(F.lit(1), F.when(F.col("damage") == 3, 2).otherwise(1))
    there = F.col("damage") != 0
    out = rows.select("conv_id", "turn", F.when(there, when(4, F.lit("user"), F.col("role"))).alias("role"), F.when(there, text).alias("text"), there.alias("there"), F.explode(copies).alias("copy"))
    return out.drop("copy")


def faulty(rows: DataFrame) -> DataFrame:
    """The rows with ``nth`` among those of equal role and text in their conversation, and their first ``fault`` or null."""
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn")))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", "blank").when(F.col("nth") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return rows.withColumn("nth", nth).withColumn("fault", fault)


def repair(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of each conv_id.

    ``conversations`` has ``conv_id, turn, role, text``; other columns are ignored. Null roles, texts, and nulls in the
    damage's key read as one space; rows without a conv_id are one conversation, whose conv_id is null. Rows of one turn
    are taken in order of role and text (as damaged). A role is known by its first character; one that the pattern hasn't,
    or an empty role, can be reroled or deleted but not kept. Repeated rows are duplicates. Texts are read whole,
    conversations of any length in segments. A conversation whose rows were all dropped gives zeros, an empty audit
    and the hash of nothing. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None

        def rows_of(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [()] * 9
            types = [*[pa.int64()] * 7, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in _OUT.split(", ")])

        for batch in batches:
            done = []
            for conv, turn, role, text, there, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "there", "fault")), strict=True):
                if held is None or conv != key:
                    if held is not None:
                        done.append((key, *held.result()))
                    key, held = conv, Conversation(segment)
                if there:
                    held.add(turn, role, text, fault)
            yield rows_of(done)
        if held is not None:
            yield rows_of([(key, *held.result())])

    rows = faulty(damaged(conversations))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "nth"]
    dealt = rows.repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "turn", "role", "text", "there", "fault").mapInArrow(run, _OUT)
