"""Audits against plain loops, and the number of times a table is read for them."""

import random

import pytest
from pyspark.sql import functions as F

from barvault.operators import audit
from barvault.schemas import Col
from barvault.session import materialise

LINES = "line bigint, part int, maker bigint, note string"


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    some = lambda *values: draw.choice(values)
    # part 1 holds a third of the rows
    return [
        (i, some(1, 1, None, draw.randrange(60)), some(None, draw.randrange(9), 2**40), some("", None, "long note", "ok", "x" * 40))
        for i in range(500)
    ]


@pytest.fixture(scope="module")
def parents(spark):
    parts = spark.createDataFrame([(p,) for p in [*range(0, 40), 1, 1, None, 2**40]], "id bigint")
    makers = spark.createDataFrame([(m,) for m in range(5)], "id int")
    return {"part": (parts, "id"), "maker": (makers, "id")}


def expected(rows):
    found = []
    for line, part, maker, note in rows:
        if part is not None and part >= 40:
            found.append(("foreign_key", "part", str(line), str(part)))
        if maker is not None and maker >= 5:
            found.append(("foreign_key", "maker", str(line), str(maker)))
        if note is None:
            found.append(("not_null", "note", str(line), None))
        elif len(note) > 8:
            found.append(("length", "note", str(line), str(len(note))))
    return sorted(found, key=str)


def told(report):
    return sorted(((r.rule, r.column, r.key, r.detail) for r in report.collect()), key=str)


@pytest.mark.parametrize("broadcast", [True, False])
def test_rules_of_single_rows(spark, rows, parents, broadcast):
    lines = spark.createDataFrame(rows, LINES)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        if not broadcast:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert told(audit.row_violations(lines, "lines", [Col("note", "string", 8, True)], parents, "line")) == expected(rows)
        alone = told(audit.orphans(lines, "lines", "part", *parents["part"], key="line"))
        assert alone == [r for r in expected(rows) if r[1] == "part"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_a_table_is_read_once(spark, rows, parents):
    lines = materialise(spark.createDataFrame(rows, LINES).withColumn("unused", F.lit("never read")))
    report = audit.row_violations(lines, "lines", [Col("note", "string", 8, True)], parents, "line")
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "unused" not in plan
    assert told(report) == expected(rows)


def test_nothing_to_check_and_nothing_there(spark, rows, parents):
    lines = spark.createDataFrame(rows, LINES)
    assert audit.row_violations(lines, "lines", key="line").collect() == []
    empty = spark.createDataFrame([], LINES)
    assert audit.row_violations(empty, "lines", [Col("note", "string", 8, True)], parents, "line").collect() == []
    no_parents = {"part": (spark.createDataFrame([], "id bigint"), "id")}
    lost = audit.row_violations(lines, "lines", parents=no_parents, key="line")
    assert lost.count() == sum(r[1] is not None for r in rows)


def test_double_keys(spark, rows):
    lines = spark.createDataFrame([*rows, rows[3], rows[3], rows[9]], LINES)
    assert told(audit.duplicate_keys(lines, "lines", "line")) == [("unique", "line", "3", "3"), ("unique", "line", "9", "2")]
