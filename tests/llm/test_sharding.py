from collections import Counter

import pytest

from barvault.llm import sharding
from tests.llm.helpers import AWKWARD, documents, with_clashes


def test_shards_take_turns():
    names, size = sharding.shard_names(5), 31
    walks = []
    for name in names:
        offset, step = sharding.preference(name, size)
        walks.append([(offset + i * step) % size for i in range(size)])
    assert all(sorted(w) == list(range(size)) for w in walks)
    owner = [None] * size
    turn = 0
    while None in owner:
        slot = next(s for s in walks[turn % 5] if owner[s] is None)
        owner[slot] = turn % 5
        turn += 1
    assert sharding.fill(names, size) == owner


def test_shares_are_even_and_few_keys_move():
    names = sharding.shard_names(64)
    before = sharding.fill(names)
    sizes = Counter(before).values()
    assert max(sizes) - min(sizes) <= 1
    after = sharding.fill(names[:-1])
    moved = sum(a != b for a, b in zip(before, after) if a != 63)
    assert moved < 0.05 * len(before)


def test_bad_tables():
    for shards, size in (([], 7), (["a"], 8), (["a", "a"], 7), (list("abcdefgh"), 7)):
        with pytest.raises(ValueError):
            sharding.fill(shards, size)


def test_rows_keep_their_columns(spark):
    docs = documents(spark, AWKWARD)
    placed = sharding.assign_shards(docs, "doc_id", "text")
    assert placed.columns == [*docs.columns, "shard"] and placed.count() == len(AWKWARD)
    assert placed.where("shard IS NULL OR shard < 0 OR shard >= 64").isEmpty()
    assert placed.where("doc_id = 1").select("shard").distinct().count() == 1
    assert sharding.assign_shards(documents(spark, []), "doc_id").count() == 0


def test_clashing_names_and_spread_null_keys(spark):
    docs = with_clashes(documents(spark, [(None, f"text {i}") for i in range(500)]))
    placed = sharding.assign_shards(docs, "doc_id", "text")
    assert sorted(placed.columns) == sorted(docs.columns)
    assert placed.select("shard").distinct().count() > 50
