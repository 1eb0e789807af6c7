"""Conversation repair against all scripts of short conversations, and against plain backward search on longer ones."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from barvault.llm import conversations, registered
from barvault.llm.conversations import Repair, Row
from tests.llm.helpers import SF_DIR, needs_tables

WELL = re.compile(r"(s?(ua)+)?$")
WHITE = " \t\n\x0b\x0c\r"


def all_scripts(rows):
    """(cost, audit) of every script with at most two inserts at a place, plainly enumerated; rows (role, fault)."""
    choices = []
    for _, fault in rows:
        choices.append(["D"] if fault in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"])
    inserts = ["", "u", "a", "ua", "au"]
    best = None
    for edits in itertools.product(*choices):
        for added in itertools.product(inserts, repeat=len(rows) + 1):
            initials, audit, cost = "", "", 0
            for (role, fault), edit, extra in zip(rows, edits, added, strict=False):
                initials, audit, cost = initials + extra, audit + "I" * len(extra) + edit[0], cost + 2 * len(extra)
                cost += {"D": 3, "K": 0, "R": 2}[edit[0]] + (fault == "truncated" and edit != "D")
                initials += {"D": "", "K": role[:1], "R": edit[1:]}[edit[0]]
            initials, audit, cost = initials + added[-1], audit + "I" * len(added[-1]), cost + 2 * len(added[-1])
            if any(e == "K" and not role for e, (role, _) in zip(edits, rows, strict=True)):
                continue  # a row without a role has no place in the order
            if WELL.match(initials) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def backward(rows):
    """(cost, audit) by recursion on what is still to come."""

    @lru_cache(maxsize=None)
    def rest(i, state):
        turn = {"": "u", "s": "u", "a": "u", "u": "a"}[state]
        found = []
        if i == len(rows):
            if state in ("", "a"):
                return (0, "")
            found = []
        here = [(state, 0, "")]
        after, cost, lead = turn, 2, "I"
        here.append((after, cost, lead))
        after = {"u": "a", "a": "u"}[after]
        here.append((after, 4, "II"))
        for now, paid, lead in here:
            if i == len(rows):
                if now in ("", "a"):
                    found.append((paid, lead))
                continue
            role, fault = rows[i]
            then = {"": "u", "s": "u", "a": "u", "u": "a"}[now]
            options = [("D", now, 3)]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                options.append(("R", then, 2 + more))
                if role[:1] == then or (now == "" and role[:1] == "s"):
                    options.append(("K", role[:1], more))
            for edit, target, price in options:
                cost, audit = rest(i + 1, target)
                found.append((paid + price + cost, lead + edit + audit))
        return min(found)

    return rest(0, "")


def repaired(rows):
    """(cost, audit, kept initials) by the operator's own class."""
    repair = Repair()
    edits, most = [], 0
    for role, fault in rows:
        edits += repair.add(Row(role, "x"), fault in ("blank", "duplicate"), fault == "truncated")
        most = max(most, held(repair))
    edits += repair.finish()
    initials = "".join(e.row.role[:1] for e in edits if e.kind != "D")
    return repair.cost, "".join(e.kind for e in edits), initials, most


def held(repair):
    """Nodes of the tree."""
    count, todo = 0, [repair.root]
    while todo:
        node = todo.pop()
        assert node.refs == len(node.children) + sum(n is node for _, n in repair.survivors.values())
        count, todo = count + 1, todo + node.children
    return count


def random_rows(r, count, roles=("user", "assistant", "system", "tool", " ", "u", "")):
    faults = [None] * 6 + ["blank", "duplicate", "truncated", "truncated"]
    return [(r.choice(roles), r.choice(faults)) for _ in range(count)]


def test_against_all_scripts():
    r = random.Random(1)
    for _ in range(60):
        rows = random_rows(r, r.randint(0, 3))
        assert repaired(rows)[:2] == all_scripts(rows), rows
        assert backward(rows) == all_scripts(rows)


def test_against_backward_search():
    r = random.Random(2)
    for _ in range(3000):
        rows = random_rows(r, r.randint(0, 14), r.choice([("user", "assistant"), ("user", "assistant", "system"), ("system", "x")]))
        cost, audit, initials, _ = repaired(rows)
        assert (cost, audit) == backward(rows), rows
        assert WELL.match(initials)


def test_tree_stays_small():
    """Thousands of rows, and never more than a few nodes; decided edits leave early."""
    r = random.Random(3)
    rows = [("user" if i % 2 == 0 else "assistant", None) for i in range(5000)]
    for i in r.sample(range(5000), 1000):
        rows[i] = r.choice(random_rows(r, 5))
    *_, most = repaired(rows)
    assert most < 150


def test_long_ties_are_compared_whole():
    """Rows that must go keep the ways apart; their suffixes are compared to the last edit."""
    for last in ("user", "assistant", "system"):
        rows = [("system", None)] + [("user", "blank")] * 300 + [(last, None)]
        assert repaired(rows)[:2] == backward(rows)


def plain(rows):
    """The report of every conversation, by plain loops over (conv_id, turn, role, text)."""
    found = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in rows:
        name = ":".join(" " if v is None else str(v) for v in (conv, turn))
        fate = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        found[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = {}
    for conv, all_rows in found.items():
        all_rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faults = set(), []
        for _, role, text in all_rows:
            fault = None
            if not text.strip(WHITE):
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            elif text.rstrip(WHITE)[-1] not in ".!?":
                fault = "truncated"
            seen.add((role, text))
            faults.append(fault)
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(all_rows)]
        turns = [t for t, *_ in all_rows if t is not None]
        cost, audit = backward([(role, fault) for (_, role, _), fault in zip(all_rows, faults, strict=True)])
        lines, queue, state = [], list(all_rows), ""
        for edit in audit:
            turn = {"": "user", "s": "user", "a": "user", "u": "assistant"}[state]
            role, text = ("", "") if edit == "I" else queue.pop(0)[1:]
            if edit != "D":
                lines.append(f"{role if edit == 'K' else turn}:{text}")
                state = lines[-1][:1]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def awkward(seed, count):
    r = random.Random(seed)
    texts = ["One.", "Two!", "cut off", "", " \t\n", None, "Why?\n", "é…", "end.\x0b", "x" * 5000 + "."]
    return [
        (
            r.choice([None, *range(25)]),
            r.choice([None, None, *range(-3, 12)]),
            r.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool"]),
            r.choice(texts) if r.random() < 0.5 else f"text {r.random()}.",
        )
        for _ in range(count)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_report_of_awkward_rows(spark, seed):
    rows = awkward(seed, 400)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("key", "h1", "seen", "fate", "_on")})
    report = conversations.repair_report(conversations.damaged(df), absent="absent").collect()
    own = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in report}
    assert len(own) == len(report)
    assert own == plain(rows)


def test_repaired_rows_tell_the_same(spark):
    rows = awkward(3, 300)
    df = conversations.damaged(spark.createDataFrame(rows, SCHEMA))
    edits = {}
    for r in conversations.repaired_rows(df, absent="absent").collect():
        edits.setdefault(r.conv_id, []).append((r.place, r.edit, r.role, r.text))
    for conv, values in plain(rows).items():
        mine = sorted(edits.get(conv, []))
        assert [e[0] for e in mine] == list(range(len(mine)))
        assert "".join(e[1] for e in mine) == values[6]
        lines = "\n".join(f"{e[2]}:{e[3]}" for e in mine if e[1] != "D")
        assert hashlib.sha256(lines.encode()).hexdigest() == values[7]


def test_empty_table_and_dropped_conversation(spark):
    assert conversations.repair_report(spark.createDataFrame([], SCHEMA)).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hello.")], SCHEMA)
    (row,) = conversations.repair_report(conversations.damaged(df), absent="absent").collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@needs_tables
def test_query_against_plain_loops(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    report = registered.op12_conversation_repair(spark, SF_DIR).collect()
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in report} == plain(rows)
