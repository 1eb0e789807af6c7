"""Piece encoding and decoding against the library and against plain merging."""

import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from barvault.llm import piece_bpe, registered
from tests.llm.helpers import AWKWARD, SF_DIR, documents, needs_tables, random_texts, with_clashes

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("piece_bpe_32k.model")

ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b   c", "\n", "a\n\nb\r\n\tc", "▁", "▁▁a▁b", "<s> </s> <unk> <0x0A>", "\x00", "a\x00b",
    "ﬁ①Ａ", "日本語のテキスト、漢字。", "\U0001f600\U0001f468‍\U0001f469", "é", "﻿x", "　a b", "�",
    "x" * 700, " " * 1000, "ab" * 500, " a" * 500, "the" * 300, "1234567890" * 30, "=" * 333, "‮text", "ÄÖÜß straße",
]


@pytest.fixture(scope="module")
def table():
    return piece_bpe.PieceTable(piece_bpe.read_model(PATH))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def random_strings(seed, count):
    r = random.Random(seed)
    alphabets = ["ab ", "the in er▁ ", "aeiou\nst", " .,;-_=", "éèçß　語", "0123456789.", "qzx\U0001f600\x07"]
    for _ in range(count):
        letters = "".join(r.sample(alphabets, r.randint(1, 3)))
        yield "".join(r.choice(letters) for _ in range(r.randint(0, 60)))


def test_ids_are_the_librarys(table, library):
    texts = [*ODD, *random_texts(1, 100), *random_strings(2, 3000)]
    for text in texts:
        assert table.encode(text) == [*library.encode(text), library.eos_id()], text
        assert table.encode(text, end=False) == library.encode(text)


def test_every_piece_is_encoded_like_the_library_does(table, library):
    r = random.Random(3)
    pieces = [p.replace("▁", " ") for p in table.ids]
    for _ in range(5000):
        text = "".join(r.choices(pieces, k=r.randint(1, 5)))
        assert table.encode(text, end=False) == library.encode(text), text


def test_decoded_text_is_the_librarys(table, library):
    for text in [*ODD, *random_strings(4, 1000)]:
        ids = table.encode(text)
        assert table.decode(ids) == library.decode(ids)
    r = random.Random(5)
    for _ in range(3000):
        ids = [r.choice([r.randrange(3, 259), r.randrange(0, 32000)]) for _ in range(r.randint(0, 8))]
        assert table.decode(ids) == library.decode(ids), ids


def merged(scores, text):
    """Plain merging: the best-scored pair, the left one of equals, until there is none."""
    symbols = list(text)
    while True:
        pairs = [(-scores[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in scores]
        if not pairs:
            return symbols
        i = min(pairs)[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


@pytest.mark.parametrize("seed", range(6))
def test_prefix_table_on_invented_pieces(seed):
    """Pieces whose parts score worse than themselves, ties, pieces no merge makes, a character without a piece."""
    r = random.Random(seed)
    pieces = {"a", "b", "c"} | {"".join(r.choice("abcd") for _ in range(r.randint(2, 5))) for _ in range(40)}
    own = piece_bpe.PieceTable.__new__(piece_bpe.PieceTable)
    own.scores = {p: float(r.randint(-15, 0)) for p in pieces}
    own.alone, own.pairs = piece_bpe._Remembered(own._alone), 0
    own.automaton = piece_bpe.ahocorasick.Automaton()
    for p in set("abcd") | {p for p in pieces if own._alone(p) is not None}:
        own.automaton.add_word(p, piece_bpe._Piece(p, None))
    own.automaton.make_automaton()
    for _ in range(400):
        text = "".join(r.choice("abcd") for _ in range(r.randint(1, 30)))
        assert [p.text for p in own._pieces(text)] == merged(own.scores, text), text


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "KNOWN", 3)
    monkeypatch.setattr(piece_bpe, "PAIRS", 7)
    own = piece_bpe.PieceTable(piece_bpe.read_model(PATH))
    for text in [*ODD, *random_texts(6, 20), *random_strings(7, 100)]:
        assert own.encode(text, end=False) == library.encode(text)


def test_rows_keep_their_columns(spark, library):
    docs = with_clashes(documents(spark, AWKWARD))
    out = piece_bpe.with_pieces(docs, piece_bpe.read_model(PATH), ids="doc ids")
    assert out.columns == [*docs.columns, "doc ids", "decoded"]
    rows = out.select("text", "doc ids", "decoded").collect()
    assert len(rows) == len(AWKWARD)
    for text, ids, decoded in rows:
        assert ids == [*library.encode(text or ""), 2]
        assert decoded == (text or "")
    read = piece_bpe.decode_ids(out.select("text", F.col("doc ids").alias("ids")), piece_bpe.read_model(PATH))
    assert all(r.decoded == (r.text or "") for r in read.collect())


def test_empty_table(spark):
    assert piece_bpe.with_pieces(documents(spark, []), piece_bpe.read_model(PATH)).collect() == []


def test_texts_are_encoded_once(spark):
    coded = piece_bpe.with_pieces(documents(spark, AWKWARD), piece_bpe.read_model(PATH))
    used = coded.select(F.size("ids"), F.sha2(F.array_join("ids", " ").cast("binary"), 256), F.length("decoded"))
    plan = used._jdf.queryExecution().executedPlan().toString()
    evaluated = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert len(evaluated) == 1 and evaluated[0].count("both(") == 1


@needs_tables
def test_query(spark, library):
    own = {r.doc_id: r for r in registered.op11_sentencepiece(spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    assert len(own) == len(docs)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for doc_id, text in docs:
        ids = [*library.encode(text or ""), 2]
        expected = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
        assert (own[doc_id].n_tokens, own[doc_id].ids_sha256, own[doc_id].decoded_sha256) == expected
