import itertools
import random
import re

import pytest

from barvault.llm import mixing
from tests.llm.helpers import AWKWARD, collected, documents, random_texts, with_clashes


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {s: 0.0 for s in names if not sizes[s]}
    while True:
        free = [s for s in names if s not in fixed]
        left, shares = total - sum(fixed.values()), sum(weight[s] for s in free)
        target = fixed | {s: left * weight[s] / shares for s in free}
        above = [s for s in free if target[s] > most * sizes[s]]
        if not above:
            return target
        fixed |= {s: float(most * sizes[s]) for s in above}


@pytest.mark.parametrize("seed", range(25))
def test_budget_is_fitted_as_well_as_can_be(seed):
    r = random.Random(seed)
    lengths = r.sample(range(1, 40), r.randint(1, 5))
    counts = [r.randint(1, 3) for _ in lengths]
    whole = sum(a * b for a, b in zip(lengths, counts))
    budget = r.randint(0, whole + 3)
    taken = mixing.fit_budget(lengths, counts, budget)
    assert all(0 <= t <= c for t, c in zip(taken, counts))
    # the equal share taken first can cost a perfect fit, but never more than the shortest free document
    got = sum(a * t for a, t in zip(lengths, taken))
    start = [c * min(budget, whole) // whole for c in counts]
    best = max(
        s
        for more in itertools.product(*(range(c - b + 1) for c, b in zip(counts, start)))
        if (s := sum(a * (b + m) for a, b, m in zip(lengths, start, more))) <= budget
    )
    assert got == best


def test_budget_with_a_small_table():
    lengths, counts = [7, 1000, 90_000], [50, 400, 30]
    for budget in (0, 5, 10_000, 1_000_001, 3_000_000):
        taken = mixing.fit_budget(lengths, counts, budget, span=500)
        left = budget - sum(a * t for a, t in zip(lengths, taken))
        assert all(0 <= t <= c for t, c in zip(taken, counts)) and 0 <= left < 1000


def run(docs):
    return collected(mixing.mix_sources(docs), "key", "size", "source", "source_size", "target", "taken")


def check(rows, found):
    sizes, taken = {}, {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    targets = plain_targets(sizes)
    assert len(found) == len(rows)
    for _, size, source, source_size, target, took in found:
        assert source_size == sizes[source] and target == pytest.approx(targets[source])
        assert took <= 3 * size and (took % size == 0 if size else took == 0)
        taken[source] = taken.get(source, 0) + took
    return {s: targets[s] - taken[s] for s in sizes}


def test_targets_are_met(spark):
    r = random.Random(1)
    rows = [(i, t, f"s{r.choice([0, 0, 0, 1, 2, 3, 4, 5])}") for i, t in enumerate(random_texts(5, 400, 90))]
    docs = documents(spark, rows)
    found = run(docs)
    assert max(abs(d) for d in check(rows, found).values()) <= 1
    assert run(docs) == found
    assert run(docs.repartition(7, "text")) == found


def test_a_row_repeated_very_often(spark):
    rows = [(1, "a b c d e", "x")] * 300 + [(i, "w " * (i % 9 + 1), "y") for i in range(300)]
    docs = documents(spark, rows)
    assert max(abs(d) for d in check(rows, run(docs)).values()) <= 5
    assert run(docs) == run(docs.repartition(5))


def test_awkward_rows_and_clashing_names(spark):
    rows = [(key, text, s) for (key, text), s in zip(AWKWARD, itertools.cycle(["b", None, "é", "a", "empty"]))]
    rows.append((50, "", "only empty"))
    check(rows, run(with_clashes(documents(spark, rows))))


def test_empty_tables(spark):
    assert run(documents(spark, [])) == []
    assert run(documents(spark, [(1, ""), (2, None)])) == [(1, 0, "src", 0, 0.0, 0), (2, 0, "src", 0, 0.0, 0)]
