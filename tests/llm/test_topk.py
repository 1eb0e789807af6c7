import math
import random

import pytest
from pyspark.sql import functions as F

from barvault.llm import topk
from tests.llm.helpers import with_clashes

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, k, every):
    units = []
    for key, vector in rows:
        if vector is None or any(v is None or not math.isfinite(v) for v in vector):
            continue
        units.append((key, [math.floor(256 * v) for v in vector]))
    out = []
    for i, (key, query) in enumerate(units):
        if key is None or key % every:
            continue
        scored = [
            (-sum(a * b for a, b in zip(query, other)), name is None, name)
            for j, (name, other) in enumerate(units)
            if j != i and len(other) == len(query)
        ]
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(key, rank, name, -score) for rank, (score, _, name) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, k=5, every=10, clash=False, **blocks):
    table = spark.createDataFrame([(key, vector, 0) for key, vector in rows], SCHEMA)
    table = with_clashes(table) if clash else table
    got = topk.top_k(table, F.col("vec_id") % every == 0, k=k, **blocks)
    return sorted((tuple(r) for r in got.collect()), key=str)


def vectors(seed, count, dim, levels=None):
    r = random.Random(seed)
    draw = (lambda: r.choice(levels)) if levels else (lambda: r.gauss(0, 0.2))
    # floats as the table stores them
    import numpy as np

    return [(i, [float(np.float32(draw())) for _ in range(dim)]) for i in range(count)]


@pytest.mark.parametrize(("dim", "levels"), [(16, None), (3, None), (4, (-0.5, 0.0, 0.5)), (2, (0.0,))])
def test_against_plain_loops(spark, dim, levels):
    rows = vectors(dim, 400, dim, levels)
    assert found(spark, rows, block=64, query_block=8) == plain(rows, 5, 10)


def test_awkward_rows_and_clashing_names(spark):
    rows = vectors(7, 60, 4) + [(0, [0.5, 0.5, 0.5, 0.5]), (0, [0.5, 0.5, 0.5, 0.5]), (10, None), (20, [1.0, None, 0.0, 0.0])]
    rows += [(30, [float("nan"), 1.0, 1.0, 1.0]), (40, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.5, 0.5, 0.5, 0.5]), (None, None)]
    rows += [(50, [1.0, 2.0]), (51, [2.0, 1.0]), (60, []), (61, []), (70, [0.25])]
    assert found(spark, rows, clash=True) == plain(rows, 5, 10)


def test_components_beyond_doubles_and_longs(spark):
    rows = [(i, [float(2.0 ** (20 + i % 5)), float(-(2.0 ** (22 - i % 3))), 1.0]) for i in range(40)]
    assert found(spark, rows) == plain(rows, 5, 10)
    huge = [(i, [1e30, 1.0]) for i in range(3)]
    assert {r[3] for r in found(spark, huge, every=1)} == {2**63 - 1}


def test_few_or_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0])]) == []
    rows = vectors(9, 3, 5)
    assert found(spark, rows, every=1) == plain(rows, 5, 1)


def test_reading_stops_early_on_long_tails():
    import numpy as np

    r = np.random.default_rng(1)
    rows = np.floor(r.pareto(1.0, (5000, 3)) * 10)
    lists = np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").T)
    scored = []
    products = topk._products
    topk._products = lambda a, q, e: scored.append(len(a)) or products(a, q, e)
    try:
        scores, at = topk.threshold_top(rows, np.arange(5000), lists, np.array([2.0, 1.0, 3.0]), 5, True)
    finally:
        topk._products = products
    assert sorted(scores) == sorted((rows @ np.array([2.0, 1.0, 3.0])))[-5:] and sum(scored) < 1000


def test_many_rounds_of_blocks(spark):
    rows = vectors(11, 300, 6) + [(0, [0.1] * 6)] * 40
    assert found(spark, rows, block=8, query_block=3) == plain(rows, 5, 10)


@pytest.mark.parametrize("tail", [0.7, 30.0])
def test_a_floor_changes_nothing_but_the_work(tail):
    import numpy as np

    r = np.random.default_rng(2)
    units = np.floor(r.pareto(tail, (3000, 4)) * 10 * tail).astype(np.int64)
    units[r.random(units.shape) < 0.5] *= -1
    block = topk.Block(list(range(3000)), units, 6)
    queries = units[:40]
    products = queries @ units.T
    free = {i: (list(s), list(at)) for i, s, at in block.answers(queries, [None] * 40)}
    for i, (scores, at) in free.items():
        best = sorted(range(3000), key=lambda j: (-products[i, j], j))[:6]
        assert at == best and scores == [products[i, j] for j in best]
    floors = [int(free[i][0][i % 6]) for i in range(40)]
    for i, scores, at in block.answers(queries, floors):
        kept = [(s, j) for s, j in zip(*free[i]) if s >= floors[i]]
        assert list(zip(scores, at)) == kept


def test_rows_are_scored_about_once_where_the_bound_does_not_help():
    import numpy as np

    rows = np.floor(np.random.default_rng(3).normal(0, 60, (8192, 64)))
    lists = np.argsort(rows.T, axis=1, kind="stable")
    scored = []
    products = topk._products
    topk._products = lambda a, q, e: scored.append(len(a)) or products(a, q, e)
    try:
        scores, _ = topk.threshold_top(rows, np.arange(8192), lists, rows[0], 6, True)
        first, floor = sum(scored), scores[-1]
        topk.threshold_top(rows, np.arange(8192), lists, rows[0], 6, True, floor)
    finally:
        topk._products = products
    assert list(scores) == sorted(rows @ rows[0], reverse=True)[:6]
    # the first entries of 64 lists, two bounds, then all rows at once
    read = 64 * topk.FIRST_DEPTH + 2
    assert first <= 8192 + read and sum(scored) - first <= 8192 + read
