import random
import re

import xxhash
from pyspark.sql import functions as F

from barvault.llm import simhash
from barvault.llm.components import connected_components
from tests.llm.helpers import AWKWARD, collected, documents, random_texts, with_clashes

SHINGLE = simhash.SHINGLE


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(keys, prints, distance):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, key in enumerate(keys):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [least.get(find(i)) for i in range(len(keys))]


def check(spark, rows, distance=2, clash=False):
    docs = documents(spark, rows)
    found = simhash.near_duplicates(with_clashes(docs) if clash else docs, distance=distance)
    prints = [plain_fingerprint(text) for _, text in rows]
    groups = plain_groups([key for key, _ in rows], prints, distance)
    expected = [(key, f"{p:016x}", g) for (key, _), p, g in zip(rows, prints, groups)]
    assert collected(found, "doc_id", "fingerprint", "component_id") == sorted(
        expected, key=lambda r: tuple((v is not None, str(v)) for v in r)
    )


def test_against_plain_loops(spark):
    check(spark, list(enumerate(random_texts(1, 150))))


def test_awkward_rows_and_clashing_names(spark):
    check(spark, AWKWARD, clash=True)


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_long_text_is_cut_without_loss(monkeypatch):
    text = " ".join(random_texts(2, 60)).encode()
    monkeypatch.setattr("barvault.llm.rolling.pieces.__defaults__", (50,))
    assert simhash.fingerprint(text) & (2**64 - 1) == plain_fingerprint(text.decode())


def test_all_pairs_within_any_distance_are_connected(spark):
    r = random.Random(5)
    prints = [r.getrandbits(64) for _ in range(20)]
    for _ in range(200):
        p = r.choice(prints)
        for _ in range(r.randint(0, 3)):
            p ^= 1 << r.randrange(64)
        prints.append(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(s,) for s in signed] + [(None,)], "fingerprint bigint")
    for distance in (0, 1, 2, 3):
        pairs = simhash.linking_pairs(table, distance)
        for row in pairs.collect():
            assert ((row["u"] ^ row["v"]) & (2**64 - 1)).bit_count() <= distance and row["u"] > row["v"]
        roots = {row["node"]: row["root"] for row in connected_components(pairs).collect()}
        groups = plain_groups(signed, prints, distance)
        assert [roots.get(s, s) for s in signed] == groups


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(300)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)]
    edges += [(5, 5), (7, 6)]
    r = random.Random(3)
    names = {n: r.getrandbits(40) for e in edges for n in e}
    pairs = spark.createDataFrame([(names[a], names[b]) for a, b in edges], "u bigint, v bigint")
    found = {row["node"]: row["root"] for row in connected_components(pairs).collect()}
    for members in (range(301), range(1000, 1301), range(2000, 2050)):
        least = min(names[m] for m in members)
        assert {found.get(names[m], names[m]) for m in members} == {least}


def test_a_variant_never_meets_more_than_a_ball(spark):
    centre = 0x0123456789ABCDEF
    near = {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)}
    table = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in near] * 3, "fingerprint bigint")
    pairs = simhash.linking_pairs(table, 2)
    assert pairs.count() < 65 * len(near)
    roots = connected_components(pairs).agg(F.countDistinct("root"), F.count("*")).first()
    assert tuple(roots) == (1, len(near) - 1)
