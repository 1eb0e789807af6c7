"""Repair of the role order of conversations by the cheapest edits, with a survivor-coalescence Viterbi.

A repaired conversation has the role initials ``(s?(ua)+)?``. That is an automaton of four states: nothing yet, after
the system row, after a user row, after an assistant row. Row by row, the best way into each state survives: the least
cost, then the least text of edit initials. The ways form a tree of back pointers whose nodes count who refers to them. A node
that nobody refers to goes; as long as the root has one child only, all survivors share it: its edits are decided and
handed out. What stays in memory is the part of the tree on which the survivors still differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barvault.llm.support import WHITE, small_batches
from barvault.operators.joins import join_unique

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
STOPS = ".!?"

_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_STATES = range(4)
#: the role an inserted or re-roled row takes in each state, and the state after it
_TURN = {_START: ("user", _USER), _SYSTEM: ("user", _USER), _ASSISTANT: ("user", _USER), _USER: ("assistant", _ASSISTANT)}
#: the state after a kept row, by state and role initial
_KEPT = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_ASSISTANT, "u"): _USER, (_USER, "a"): _ASSISTANT}


class Row(NamedTuple):
    role: str
    text: str


class Edit(NamedTuple):
    """One decided edit with the row that results from it; a deleted row is the one that goes."""

    kind: str
    row: Row


class _Node:
    """A step of a way: the edits of one row, the inserts before it included."""

    __slots__ = ("parent", "edits", "row", "children", "refs")

    def __init__(self, parent: _Node | None, edits: str, row: Row | None):
        self.parent, self.edits, self.row = parent, edits, row
        self.children: list[_Node] = []
        self.refs = 0


def _inserted(state: int, count: int) -> int:
    for _ in range(count):
        state = _TURN[state][1]
    return state


def _mimic() -> dict[tuple[int, int], int]:
    """The most that a way in one state pays to do what a way in another one goes on to do.

    A way that is worse than another one by more than that cannot win. A system row that may still come is deleted, a
    missing assistant row inserted; a way behind the system row that is to end with nothing gets a user and an assistant.
    """
    delete, insert = COST[DELETE], COST[INSERT]
    return {
        (_ASSISTANT, _START): delete, (_USER, _START): insert + delete, (_SYSTEM, _START): max(delete, 2 * insert),
        (_ASSISTANT, _SYSTEM): 0, (_START, _SYSTEM): 0, (_USER, _SYSTEM): insert,
        (_START, _ASSISTANT): 0, (_SYSTEM, _ASSISTANT): 2 * insert, (_USER, _ASSISTANT): insert,
        (_START, _USER): insert, (_SYSTEM, _USER): insert, (_ASSISTANT, _USER): insert,
    }


_MIMIC = _mimic()


class Repair:
    """The cheapest edits of one conversation; ``add`` and ``finish`` hand out those that are decided."""

    def __init__(self) -> None:
        self.root = _Node(None, "", None)
        self.root.refs = 1
        self.survivors: dict[int, tuple[int, _Node]] = {_START: (0, self.root)}
        self.state = _START  # of what was handed out
        self.cost = 0

    @staticmethod
    def _before(a: _Node, edits_a: str, b: _Node, edits_b: str) -> bool:
        """Whether way ``a`` with its next edits comes before way ``b`` with its own: all that is not decided yet is
        compared, back to where the ways part. Both have passed the same rows."""
        first, second = [edits_a], [edits_b]
        while a is not b:
            first.append(a.edits)
            second.append(b.edits)
            a, b = a.parent, b.parent
        return "".join(reversed(first)) < "".join(reversed(second))

    def _offer(self, into: dict, state: int, cost: int, parent: _Node, edits: str, row: Row | None) -> None:
        best = into.get(state)
        if best is None or cost < best[0] or (cost == best[0] and self._before(parent, edits, best[1], best[2])):
            into[state] = (cost, parent, edits, row)

    def _release(self, node: _Node) -> None:
        node.refs -= 1
        while not node.refs and node.parent is not None:
            node.parent.children.remove(node)
            node = node.parent
            node.refs -= 1

    def _advance(self, best: dict) -> None:
        old, self.survivors = self.survivors, {}
        for state, (cost, parent, edits, row) in best.items():
            if any(c + _MIMIC[t, state] < cost for t, (c, *_) in best.items() if t != state):
                continue
            node = _Node(parent, edits, row)
            node.refs = 1
            parent.children.append(node)
            parent.refs += 1
            self.survivors[state] = (cost, node)
        for _, node in old.values():
            self._release(node)

    def _decided(self) -> Iterator[Edit]:
        """Edits that all survivors share."""
        while self.root.refs == 1 and self.root.children:
            node = self.root.children[0]
            node.parent, self.root = None, node
            for kind in node.edits:
                if kind == INSERT:
                    role, self.state = _TURN[self.state]
                    yield Edit(kind, Row(role, ""))
                elif kind == REROLE:
                    role, self.state = _TURN[self.state]
                    yield Edit(kind, Row(role, node.row.text))
                else:
                    if kind == KEEP:
                        self.state = _KEPT[self.state, node.row.role[:1]]
                    yield Edit(kind, node.row)
            node.row = None

    def add(self, row: Row, must_go: bool, truncated: bool) -> Iterator[Edit]:
        best: dict = {}
        worse = TRUNCATED_COST if truncated else 0
        for state, (cost, parent) in self.survivors.items():
            for inserts in range(3):
                here, lead = _inserted(state, inserts), INSERT * inserts
                paid = cost + COST[INSERT] * inserts
                self._offer(best, here, paid + COST[DELETE], parent, lead + DELETE, row)
                if must_go:
                    continue
                self._offer(best, _TURN[here][1], paid + COST[REROLE] + worse, parent, lead + REROLE, row)
                kept = _KEPT.get((here, row.role[:1]))
                if kept is not None:
                    self._offer(best, kept, paid + COST[KEEP] + worse, parent, lead + KEEP, row)
        self._advance(best)
        yield from self._decided()

    def finish(self) -> Iterator[Edit]:
        best: dict = {}
        for state, (cost, parent) in self.survivors.items():
            for inserts in range(3):
                if _inserted(state, inserts) in (_START, _ASSISTANT):
                    self._offer(best, _START, cost + COST[INSERT] * inserts, parent, INSERT * inserts, None)
        self._advance(best)
        self.cost = best[_START][0]
        yield from self._decided()


def is_blank(text: str) -> bool:
    return not text.strip(WHITE)


def is_truncated(text: str) -> bool:
    return text.rstrip(WHITE)[-1:] not in STOPS


class _Conversation:
    """Counts and edits of one conversation whose rows come in order."""

    def __init__(self, key):
        self.key = key
        self.repair = Repair()
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.before: tuple | None = None
        self.turns, self.low, self.high = 0, None, None

    def add(self, turn: int | None, row: Row, seen: bool) -> Iterator[Edit]:
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        if self.before and self.before[1].role[:1] + row.role[:1] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        # equal rows of one turn follow one another
        fault = (
            "blank" if is_blank(row.text)
            else "duplicate" if seen or self.before == (turn, row)
            else "truncated" if is_truncated(row.text)
            else None
        )
        if fault:
            self.counts[fault] += 1
        self.before = turn, row
        return self.repair.add(row, fault in ("blank", "duplicate"), fault == "truncated")

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _edited(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[_Conversation, Iterable[Edit], bool]]:
    """(conversation, edits now decided, whether that was all) for rows sorted by conversation and turn."""
    now: _Conversation | None = None
    for batch in batches:
        for key, turn, role, text, absent, seen in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if now is None or now.key != key:
                if now is not None:
                    yield now, now.repair.finish(), True
                now = _Conversation(key)
            if not absent:
                yield now, now.add(turn, Row(role, text), seen), False
    if now is not None:
        yield now, now.repair.finish(), True


def _prepared(rows: DataFrame, key: str, turn: str, role: str, text: str, absent: str | None) -> DataFrame:
    """(key, turn, role, text, absent, seen) dealt by conversation and sorted; ``seen`` tells that an earlier turn has the
    same role and text. That is found by a grouped join, not by a set per conversation."""
    small_batches(rows.sparkSession, rows=2048)
    own = rows.select(
        F.col(key).alias("key"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        (F.coalesce(F.col(absent), F.lit(False)) if absent else F.lit(False)).alias("absent"),
    ).withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "text", "role")})
    held = own.where("NOT absent").groupBy("key", "h1", "h2").agg(
        F.min("turn").alias("first"), F.max("turn").alias("last"), F.max(F.col("turn").isNull()).alias("unplaced")
    )
    often = held.where("first < last OR (unplaced AND first IS NOT NULL)").drop("last")
    marked = join_unique(own, often, ["key", "h1", "h2"]).select(
        "key", "turn", "role", "text", "absent",
        F.coalesce(F.col("unplaced") & F.col("turn").isNotNull() | (F.col("first") < F.col("turn")), F.lit(False)).alias("seen"),
    )
    return marked.repartition("key").sortWithinPartitions("key", "turn", "role", "text")


def _batch(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def repaired_rows(
    rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    absent: str | None = None,
) -> DataFrame:
    """(key, place, edit, role, text) for every edit of every conversation, in order from place 0; deleted rows are there
    with edit ``D``. See ``repair_report`` for what is decided how."""
    prepared = _prepared(rows, key, turn, role, text, absent)
    kind = prepared.schema["key"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {"key": [], "place": [], "edit": [], "role": [], "text": []}
        place, size, schema = 0, 0, None

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for batch in batches:
                schema = schema or pa.schema(
                    [("key", batch.schema.field("key").type), ("place", pa.int64())]
                    + [(name, pa.string()) for name in ("edit", "role", "text")]
                )
                yield batch

        for conversation, edits, done in _edited(typed()):
            for edit in edits:
                for name, value in zip(out, (conversation.key, place, edit.kind, *edit.row), strict=True):
                    out[name].append(value)
                place, size = place + 1, size + len(edit.row.text)
            place = 0 if done else place
            if len(out["key"]) >= 2048 or size > 1 << 22:
                yield _batch(out, schema)
                out, size = {name: [] for name in out}, 0
        if out["key"]:
            yield _batch(out, schema)

    found = prepared.mapInArrow(run, f"key {kind}, place bigint, edit string, role string, text string")
    return found.select(F.col("key").alias(key), "place", "edit", F.col("role").alias(role), F.col("text").alias(text))


def repair_report(
    rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    absent: str | None = None,
) -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation.

    Rows are taken by turn, null turns first, equal turns by role and text (all three in code-point order); the first
    fault of each counts: blank, seen earlier with the same role, cut off before a full stop. Blank and seen rows are
    deleted; the rest is kept, re-roled or deleted, and empty rows are inserted, at the least total cost, of equal
    costs with the least text of edit initials (``audit``). ``repaired_sha256`` is over the repaired ``role:text``, joined
    by newlines. Null roles and texts read as one blank, and a row with a blank or empty role is never kept; a null key is a conversation of its own. Rows whose column
    ``absent`` is true only name their conversation; one with no others has zeros, no edits and the hash of nothing. An
    empty table gives an empty result; further columns are ignored.

    Each conversation is streamed once through one task, as its audit and its hash are one text each. Only the rows
    between the decided edits and the newest row are held; a run of rows that must all be deleted leaves that open.
    """
    prepared = _prepared(rows, key, turn, role, text, absent)
    kind = prepared.schema["key"].dataType.simpleString()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {name: [] for name in ("key", *counts, "audit", "repaired_sha256")}
        audit: list[str] = []
        digest, separator, schema = hashlib.sha256(), b"", None

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for batch in batches:
                schema = schema or pa.schema(
                    [("key", batch.schema.field("key").type)]
                    + [(name, pa.int64()) for name in counts]
                    + [("audit", pa.string()), ("repaired_sha256", pa.string())]
                )
                yield batch

        for conversation, edits, done in _edited(typed()):
            for edit in edits:
                audit.append(edit.kind)
                if edit.kind != DELETE:
                    digest.update(separator + f"{edit.row.role}:{edit.row.text}".encode())
                    separator = b"\n"
            if not done:
                continue
            values = (
                conversation.key, conversation.gaps(), *conversation.counts.values(), conversation.repair.cost,
                "".join(audit), digest.hexdigest(),
            )
            for name, value in zip(out, values, strict=True):
                out[name].append(value)
            audit, digest, separator = [], hashlib.sha256(), b""
            if len(out["key"]) >= 2048:
                yield _batch(out, schema)
                out = {name: [] for name in out}
        if out["key"]:
            yield _batch(out, schema)

    longs = ", ".join(f"{name} bigint" for name in counts)
    found = prepared.mapInArrow(run, f"key {kind}, {longs}, audit string, repaired_sha256 string")
    return found.withColumnRenamed("key", key)


def damaged(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turn, role, text, absent): conversations with faults to be repaired, put in by the CRC-32 of ``key:turn``.

    Its remainder by 20 says what happens to a row: 0 drops it (``absent``), 1 empties its text, 2 takes its stops away, 3
    repeats it, 4 makes it the user's. Nulls read as one blank, but turns stay null.
    """
    blank = F.lit(" ")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    fate = F.crc32(F.concat(shown(key), F.lit(":"), shown(turn)).cast("binary")) % 20
    marked = rows.select(
        F.col(key).alias(key), F.col(turn).alias(turn), shown(role).alias(role), shown(text).alias(text),
        fate.alias("fate"),
    ).select(
        key, turn, F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col(role)).alias(role),
        _damaged_text(F.col(text), F.col("fate")).alias(text), (F.col("fate") == 0).alias("absent"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1))).alias("copy"),
    )
    return marked.drop("copy")


def _damaged_text(text: Column, fate: Column) -> Column:
    return (
        F.when(fate.isin(0, 1), F.lit("")).when(fate == 2, F.translate(text, STOPS, "")).otherwise(text)
    )
