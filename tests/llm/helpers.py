"""Small documents with everything that may come up, and plain loops to compare with."""

from __future__ import annotations

import os
import random

import pytest

SF_DIR = "/root/testdata/sf0.001"

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows):
    """A documents table from (doc_id, text) or (doc_id, text, source) rows."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


#: nulls everywhere, empty and white texts, ties, repeated rows, a long text
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
AWKWARD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"),
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"),
    (2, "Alpha  BETA gamma delta epsilon zeta eta theta iota kappa lambda"),
    (3, None),
    (4, ""),
    (5, " \t\n\x0b\x0c\r "),
    (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"),
    (None, None),
    (6, LONG),
    (7, "one"),
    (8, "Ärger İstanbul \U0001f600 ÄRGER ne pas couper"),
    (9, "a\n\nb\r\nA\n a \n\n"),
]

#: columns whose names the operators use themselves
CLASHING = (
    "_on row_id key size target taken fingerprint component_id group slot owner shard variant bucket fold score kept words "
    "h1 h2 pos nth copies rows spans ref tag data place mark held_out selected _text _key _id _target _toxic"
).split()


def with_clashes(df):
    for name in CLASHING:
        df = df.withColumn(name, df[df.columns[0]].cast("string"))
    return df


def random_texts(seed: int, count: int, words: int = 40, vocabulary: int = 30) -> list[str]:
    """Random texts with copies and near copies."""
    r = random.Random(seed)
    names = ["".join(r.choice("abcdefghé") for _ in range(r.randint(1, 7))) for _ in range(vocabulary)]
    texts: list[str] = []
    for _ in range(count):
        if texts and r.random() < 0.4:
            old = r.choice(texts).split(" ")
            for _ in range(r.randint(0, 2)):
                old[r.randrange(len(old))] = r.choice(names)
            texts.append(" ".join(old))
        else:
            texts.append(" ".join(r.choice(names) for _ in range(r.randint(0, words))))
    return texts


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))


needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")
