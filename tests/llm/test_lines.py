import hashlib
from collections import defaultdict

import pytest

from barvault.llm import line_dedup
from tests.llm.helpers import AWKWARD, collected, documents, random_texts, with_clashes

WHITE = "".join(map(chr, [32, 9, 10, 11, 12, 13]))


def plain(rows, min_docs, keep_first):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))

    seen, first = defaultdict(set), {}
    for i, (doc, text) in enumerate(rows):
        for pos, line in enumerate((text or "").split("\n")):
            seen[key(line)].add(i)
            place = ((doc is not None, doc), pos)
            first[key(line)] = min(first.get(key(line), place), place)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        lost = [
            len(key(line)) > 0
            and len(seen[key(line)]) >= min_docs
            and not (keep_first and first[key(line)] == ((doc is not None, doc), pos))
            for pos, line in enumerate(lines)
        ]
        kept = "\n".join(line for line, gone in zip(lines, lost) if not gone)
        out.append((doc, len(lines), sum(lost), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))


def found(docs, **rules):
    rows = collected(line_dedup.dedup_lines(docs, **rules), "doc_id", "n_lines", "n_dropped", "kept")
    hashed = [(*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in rows]
    return sorted(hashed, key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("keep_first", [False, True])
def test_against_plain_loops(spark, keep_first):
    texts = [t.replace("é", "\n").replace("ab", "\r\n").replace("c", " C ") for t in random_texts(3, 120, 60, 25)]
    texts.append("\n".join(f"line {i % 300}" for i in range(3000)))
    rows = list(enumerate(texts))
    rules = {"min_docs": 4, "keep_first": keep_first}
    assert found(documents(spark, rows), **rules) == plain(rows, **rules)


def test_awkward_rows_and_clashing_names(spark):
    assert found(with_clashes(documents(spark, AWKWARD)), min_docs=2) == plain(AWKWARD, 2, False)


def test_empty_table(spark):
    assert found(documents(spark, [])) == []


def test_bitmaps_leave_out_words_without_lost_lines(spark):
    rows = [(i, "\n".join(["shared" if j == 200 else f"own {i} {j}" for j in range(300)])) for i in range(3)]
    bitmaps = line_dedup.drop_bitmaps(documents(spark, rows), min_docs=3).collect()
    assert [[tuple(w) for w in r["bitmap"]] for r in bitmaps] == [[(200 // 64, 1 << 200 % 64)]] * 3


def test_a_line_of_every_document_is_a_few_rows(spark):
    docs = documents(spark, [(i, "every document has this\nown") for i in range(500)])
    lines = line_dedup.line_hashes(docs, "doc_id", "text")
    verdicts = line_dedup.line_verdicts(lines).collect()
    assert sorted((r["docs"], tuple(r["first"])) for r in verdicts) == [(500, (0, 0)), (500, (0, 1))]
