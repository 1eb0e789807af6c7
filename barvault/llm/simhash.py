"""Near-duplicate documents by SimHash fingerprints and meet-in-the-middle ball hashing."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barvault.llm.components import connected_components
from barvault.llm.rolling import pieces
from barvault.llm.support import row_key, small_batches
from barvault.operators.joins import join_unique
from barvault.session import materialise

SHINGLE = 3
DISTANCE = 2
BITS = 64
SEED = 42

# the bits of each byte value, lowest first
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a UTF-8 text: bit by bit, the majority over the hashes of its word shingles."""
    ones, total, carry = np.zeros((8, 256), np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    short: list[bytes] = []
    for piece in pieces(data or b""):
        words = carry + piece.lower().split()
        runs = zip(*(words[i:] for i in range(shingle)), strict=False)
        hashes = np.array([digest(b" ".join(run), SEED) for run in runs], dtype="<u8")
        if len(hashes):
            total += len(hashes)
            lanes = hashes.view(np.uint8).reshape(-1, 8)
            for lane in range(8):
                ones[lane] += np.bincount(lanes[:, lane], minlength=256)
        carry = words[-(shingle - 1) :] if shingle > 1 else []
        short = words
    if not total and short:
        total = 1
        for lane, byte in enumerate(digest(b" ".join(short), SEED).to_bytes(8, "little")):
            ones[lane, byte] = 1
    set_bits = (ones @ _BYTE_BITS).ravel() * 2 > total
    return int(np.packbits(set_bits, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of each text; one without words has fingerprint zero."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, shingle) for x in texts], dtype="int64")

    return docs.withColumn(out, of(F.col(text).cast("binary")))


def _flips(radius: int) -> list[int]:
    """All masks of at most ``radius`` bits, as signed numbers."""
    masks = (sum(1 << b for b in bits) for n in range(radius + 1) for bits in itertools.combinations(range(BITS), n))
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _ball(fingerprint: Column, radius: int) -> Column:
    masks = F.expr("array(" + ", ".join(f"{m}L" if m > -(1 << 63) else "shiftleft(1L, 63)" for m in _flips(radius)) + ")")
    return F.transform(masks, lambda m: fingerprint.bitwiseXOR(m))


def linking_pairs(fingerprints: DataFrame, distance: int = DISTANCE, column: str = "fingerprint") -> DataFrame:
    """Pairs (u, v) of distinct fingerprints at most ``distance`` bits apart that connect what all such pairs connect.

    Two fingerprints that close have a variant in common which is within half the distance of one and within the other
    half of the other. Every distinct fingerprint emits the variants of its ball; colliding ones are tied to the least
    fingerprint in the inner half, which is within the distance of all of them, and the pair is verified. Because
    fingerprints are distinct, a variant collects no more of them than a ball has points (65 for 2 bits), however
    large a group of copies is, and no bucket emits all its pairs. Null fingerprints link to nothing.
    """
    if not 0 <= distance <= 4:
        raise ValueError("the distance must be from 0 to 4 bits")
    inner, outer = distance // 2, distance - distance // 2
    own = fingerprints.select(F.col(column).alias("f")).where("f IS NOT NULL").distinct()
    # a stated number of partitions: by the few bytes of fingerprints Spark would emit all variants in a few tasks. By a
    # hash of f, as a repartition by f itself repeats that of distinct() and is left out
    own = own.repartition(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("f"))
    emitted = own.select("f", F.explode(_ball(F.col("f"), outer)).alias("variant"))
    near = F.bit_count(F.col("f").bitwiseXOR(F.col("variant"))) <= inner
    centre = F.min(F.when(near, F.col("f"))).over(Window.partitionBy("variant"))
    tied = emitted.withColumn("c", centre).where("c <> f")
    return tied.where(F.bit_count(F.col("f").bitwiseXOR(F.col("c"))) <= distance).select(
        F.greatest("f", "c").alias("u"), F.least("f", "c").alias("v")
    ).distinct()


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    identity: Sequence[str] = (),
) -> DataFrame:
    """(row_id, key, fingerprint, group, component_id) per row of ``docs``.

    A group holds all rows that links between near fingerprints connect; ``component_id`` is its least key. Texts
    without words, null ones included, have fingerprint zero and link like any other. A null key belongs to its
    group but never names it; a group of null keys only has a null component_id. Repeated rows come back as often as
    they are there; an empty table gives an empty result. ``row_id`` stands for the columns of ``identity``, or for key
    and text.
    """
    own = docs.select(
        row_key(*(identity or (key, text))).alias("row_id"), F.col(key).alias(key), F.col(text).alias("_text")
    )
    rows = materialise(with_fingerprint(own, "_text", shingle).drop("_text"))
    least = materialise(rows.groupBy("fingerprint").agg(F.min(key).alias("least")))
    roots = connected_components(linking_pairs(least, distance)).withColumnRenamed("node", "fingerprint")
    rooted = least.join(roots, "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("group")
    )
    named = rooted.groupBy("group").agg(F.min("least").alias("component_id"))
    groups = join_unique(rooted.drop("least"), named, ["group"])
    return join_unique(rows, groups, ["fingerprint"]).select(
        "row_id", key, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "group", "component_id"
    )
