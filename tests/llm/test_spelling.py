"""Spelling groups against all pairs of words, by plain loops."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barvault.llm import registered, spelling
from tests.llm.helpers import AWKWARD, SF_DIR, documents, needs_tables, with_clashes

LOWER = {i: i + 32 for i in range(65, 91)}


def counted(rows):
    out = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(vocab):
    near = {w: [o for o in vocab if abs(len(o) - len(w)) < 2 and one_apart(w, o)] for w in vocab}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-vocab[o], o.encode()), default=None)
        form[w] = best if best is not None and vocab[best] >= 2 * vocab[w] else None
    out = {}
    for w in vocab:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, vocab[w], len(near[w]), vocab.get(form[w]))
    return out


def collected(df):
    rows = df.collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


def words(seed, count, letters="abé", low=5, high=9):
    r = random.Random(seed)
    return list({"".join(r.choice(letters) for _ in range(r.randint(low, high))) for _ in range(count)})


@pytest.mark.parametrize("letters", ["ab", "abé", "abcdefghijklmnopqrstuvwxyzéÀ"])
def test_groups_of_random_words(spark, letters):
    """Few letters make many near words, repeated bigrams and ties in the order."""
    r = random.Random(len(letters))
    vocab = {w: r.choice([3, 4, 6, 8, 12, 24, 50, 100]) for w in words(1, 350, letters)}
    for w in list(vocab)[:60]:
        i = r.randrange(len(w))
        vocab.setdefault(w[:i] + w[i + 1 :] + "xy", r.randint(3, 9))
    df = spark.createDataFrame(list(vocab.items()), "word string, n bigint")
    assert collected(spelling.spelling_groups(df)) == grouped(vocab)


def test_long_chain_of_forms(spark):
    """Every word points to the next; the root of all is the last."""
    vocab = {"abcdefghijklm"[:5] + "abcdefghijklm"[5 : 5 + i] + "zzzzzzzz"[i:]: 3 * 2**i for i in range(8)}
    df = spark.createDataFrame(list(vocab.items()), "word string, n bigint")
    found = collected(spelling.spelling_groups(df))
    assert found == grouped(vocab)
    assert len({root for _, root, *_ in found.values()}) == 1


def test_pivots_are_the_cheapest_disjoint_grams(spark):
    vocab = words(5, 200, "abcd")
    often = Counter(w[i : i + 2] for w in vocab for i in range(len(w) - 1))
    rank = {g: i for i, g in enumerate(sorted(often, key=lambda g: (often[g], g)), 1)}
    df = spark.createDataFrame([(w, 3) for w in vocab], "word string, n bigint")
    for row in spelling.gram_index(df).collect():
        grams = sorted((rank[row.word[i : i + 2]], i + 1) for i in range(len(row.word) - 1))
        assert row.limit == grams[2][0] and row.prefix == [at for r, at in grams if r <= row.limit]
        cost = lambda at: often[row.word[at - 1 : at + 1]]  # noqa: B023, E731
        pairs = [cost(p) + cost(q) for _, p in grams[:3] for _, q in grams[:3] if q - p >= 2]
        assert row.b - row.a >= 2 and cost(row.a) + cost(row.b) == min(pairs)


def test_awkward_documents(spark):
    r = random.Random(7)
    rows = [(i, " ".join(r.choices(["Hauses", "hause", "Häuser", "häuser×", "ÄRGER", "ärger", "colour", "color", "x1colour"], k=40))) for i in range(30)]
    rows += [*AWKWARD, *AWKWARD, (99, "z" * 3000 + " " + "Zz" * 1500), (99, "z" * 3000), (98, "z" * 3001), (97, "z" * 3000)]
    docs = with_clashes(documents(spark, rows)).withColumn("word", F.lit("own")).withColumn("n", F.lit(1))
    assert collected(spelling.group_spellings(docs)) == grouped(counted(rows))


def test_empty_table(spark):
    assert collected(spelling.group_spellings(documents(spark, []))) == {}
    assert collected(spelling.group_spellings(documents(spark, [(1, None), (2, "a b c")]))) == {}


def test_arguments():
    with pytest.raises(ValueError):
        spelling.group_spellings(None, min_length=3)
    with pytest.raises(ValueError):
        spelling.spelling_groups(None, ratio=1)


@needs_tables
def test_query_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert collected(registered.op13_spelling_variants(spark, SF_DIR)) == grouped(counted(rows))
