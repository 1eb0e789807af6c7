import random
import re

import pytest

from barvault.llm import decontaminate
from tests.llm.helpers import AWKWARD, collected, documents, random_texts, with_clashes


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(rows, items, span):
    windows = {}
    for item, text in items:
        own = words(text)
        size = min(span, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            windows.setdefault(tuple(own[i : i + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in rows:
        own, hit, met = words(text), set(), set()
        for size in sizes:
            for i in range(len(own) - size + 1):
                items_here = windows.get(tuple(own[i : i + size]))
                if items_here is not None:
                    hit |= set(range(i, i + size))
                    met |= {str(x) for x in items_here if x is not None}
        out.append((doc, len(own), len(hit), sorted(met)))
    return sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))


def found(spark, rows, items, span, gram, clash=False):
    docs = documents(spark, rows)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    if clash:
        docs, bench = with_clashes(docs), with_clashes(bench)
    return collected(decontaminate.contamination(docs, bench, span=span, gram=gram), "key", "n_words", "n_hit", "items")


@pytest.mark.parametrize(("span", "gram"), [(10, 5), (6, 6), (4, 1)])
def test_against_plain_loops(spark, span, gram):
    r = random.Random(span)
    texts = random_texts(7, 80, 60, 12)
    items = [(i % 18, t) for i, t in enumerate(random_texts(8, 20, 25, 12))] + [(100, "abc"), (101, "a b c"), (None, texts[3][:60])]
    items += [(200 + i, " ".join(texts[i].split()[3 : 3 + r.randint(1, 20)])) for i in range(15)] + [(300, ""), (301, None)]
    rows = list(enumerate(texts))
    assert found(spark, rows, items, span, gram) == plain(rows, items, span)


def test_awkward_rows_and_clashing_names(spark):
    items = [(1, "gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "w5x5 w6x6 w7x7 w8x8"), (3, "ärger istanbul")]
    items.append((4, "alpha, beta; GAMMA delta epsilon zeta eta theta iota kappa lambda"))
    assert found(spark, AWKWARD, items, 10, 5, clash=True) == plain(AWKWARD, items, 10)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b c")], 10, 5) == []
    assert found(spark, [(1, "a b")], [], 10, 5) == [(1, 2, 0, [])]


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "_BROADCAST_ROWS", 0)
    rows = list(enumerate(random_texts(9, 40, 40, 10)))
    items = list(enumerate(random_texts(10, 10, 30, 10)))
    assert found(spark, rows, items, 6, 3) == plain(rows, items, 6)
