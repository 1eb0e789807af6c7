import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from barvault.llm import rolling, suffix_dedup
from barvault.llm.suffix_sort import BlindTrie, common_prefix, sort_suffixes
from tests.llm.helpers import AWKWARD, documents, random_texts, with_clashes


@pytest.mark.parametrize("seed", range(40))
def test_sorting_suffixes(seed):
    r = random.Random(seed)
    size, length = r.randint(60, 500), r.choice([8, 20, 24, 33, 50])
    letters = b"ab" if seed % 2 else b"abcdefgh\x00\xff"
    text = bytes(r.choice(letters) for _ in range(size))
    for _ in range(r.randint(0, 5)):
        a, b = r.randrange(size), r.randint(0, len(text))
        text = text[:b] + text[a : a + r.randint(10, 200)] + text[b:]
    if seed % 7 == 0:
        text = b"xyz" * 200
    positions = np.arange(len(text) - length + 1)
    order, same = sort_suffixes(text, positions, length, r.choice([8, 16, 32]))
    strings = [text[p : p + length] for p in order]
    assert sorted(order) == list(positions) and strings == sorted(strings)
    assert [bool(x) for x in same] == [i > 0 and s == strings[i - 1] for i, s in enumerate(strings)]


def test_blind_trie_and_prefixes():
    assert [common_prefix(b"abcd", x) for x in (b"abcd", b"abce", b"bbcd", b"ab\x00d")] == [4, 3, 0, 2]
    strings = [bytes(random.Random(i).choices(b"ab", k=12)) for i in range(300)]
    trie = BlindTrie()
    for i, s in enumerate(strings):
        trie.insert(s, i)
    leaves = list(trie.leaves())
    assert [strings[leaf[0]] for leaf in leaves] == sorted(set(strings))
    assert sorted(i for leaf in leaves for i in leaf) == list(range(300))


def test_equal_strings_have_equal_anchors():
    r = random.Random(4)
    shared = bytes(r.choices(b"abcdef ", k=40))
    texts = [bytes(r.choices(b"abcdef ", k=r.randint(0, 90))) + shared + bytes(r.choices(b"abcdef ", k=50)) for _ in range(20)]
    marks = []
    for text in texts:
        at = text.index(shared)
        own = [(m, s, n) for ms, ss, ns in suffix_dedup.anchors(text, 40, 16) for m, s, n in zip(ms, ss, ns)]
        assert sum(n for _, _, n in own) == len(text) - 39
        marks.append(next(m for m, s, n in own if s <= at < s + n))
    assert len(set(marks)) == 1


def test_sliding_least():
    values = np.array([5, 3, 8, 1, 9, 2, 7, 7, 0, 4], dtype=np.uint64)
    for width in range(1, 11):
        assert rolling.sliding_min(values, width).tolist() == [int(min(values[i : i + width])) for i in range(11 - width)]


def plain(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (key, _), text in zip(rows, texts):
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - length + 1):
            if count[text[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(text, np.uint8)[~gone])
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((key, len(text), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(docs, length, window):
    rows = suffix_dedup.remove_repeats(docs, length=length, window=window).collect()
    return sorted(
        (
            (r[0], r["n_bytes"], sum(r["ends"]) - sum(r["starts"]), len(r["starts"]), hashlib.sha256(r["kept"]).hexdigest())
            for r in rows
        ),
        key=str,
    )


@pytest.mark.parametrize("wide", [1000, 2])
def test_against_plain_loops(spark, monkeypatch, wide):
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    r = random.Random(9)
    texts = random_texts(6, 60, 60, 400)
    passage = "".join(r.choice("abcdefghij ") for _ in range(90))
    texts += [t[: len(t) // 2] + passage[r.randint(0, 50) :] + t[len(t) // 2 :] for t in texts[:30]]
    texts += ["ab" * 100, "x" * 500, "shti " * 60, passage, passage]
    rows = list(enumerate(texts))
    assert found(documents(spark, rows), 40, 16) == plain(rows, 40)


def near_copies(count, seed=3):
    """Texts around one passage, each with letters of its own in it: one crowded anchor after another."""
    r = random.Random(seed)
    passage = [r.choice("abcdefghij ") for _ in range(300)]
    texts = []
    for i in range(count):
        own = list(passage)
        for at in r.sample(range(300), 3):
            own[at] = r.choice("XYZ")
        texts.append("".join(own) + f" number {i}")
    return texts


@pytest.mark.parametrize("wide", [3, 20])
def test_crowded_anchors_against_plain_loops(spark, monkeypatch, wide):
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    rows = list(enumerate(near_copies(60) + ["ab" * 90, "ab" * 91 + "c", "tail " + near_copies(1)[0]]))
    assert found(documents(spark, rows), 100, 60) == plain(rows, 100)


def test_a_bundle_without_news():
    bundle = suffix_dedup._Bundle(8)
    bundle.add(1, b"a", 3, False, b"0123456789")
    assert len(bundle.verdicts()) == 0
    bundle.add(1, b"b", 3, True, b"x123456789")
    assert bundle.verdicts().values.tolist() == [[b"a", 1, 2]]


def test_rows_of_a_split_grow_with_the_carriers(spark):
    """Twice the near copies make twice the parts, not four times as many, and a few for each carrier."""
    shares = []
    for count in (50, 100, 200, 400):
        carriers = [(bytes([i % 256, i // 256]), False, t.encode()) for i, t in enumerate(near_copies(count))]
        df = spark.createDataFrame(carriers, "fold binary, known boolean, data binary")
        shares.append(suffix_dedup._split(df, 200, 30).count() / count)
    assert max(shares) < 1.1 * min(shares) and max(shares) < 2 * 110 / 30 + 5


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    rows = list(enumerate(random_texts(8, 40, 60, 60)))
    runs = [n for _, t in rows for _, _, ns in suffix_dedup.anchors(t.encode(), 40, 16) for n in ns]
    assert sum(runs) == sum(max(0, len(t.encode()) - 39) for _, t in rows)
    assert found(documents(spark, rows), 40, 16) == plain(rows, 40)


def test_awkward_rows_and_clashing_names(spark):
    rows = [r for r in AWKWARD if r[0] != 6] + [(6, "long " * 3000)]
    assert found(with_clashes(documents(spark, rows)), 40, 16) == plain(rows, 40)


def test_empty_table(spark):
    assert found(documents(spark, []), 40, 16) == []
