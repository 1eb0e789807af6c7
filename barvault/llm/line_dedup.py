"""Removal of lines that many documents share, decided on line hashes and returned as bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barvault.llm.support import WHITE, ascii_lower, let, row_key
from barvault.operators.joins import join_unique

MIN_DOCS = 10
MIN_LENGTH = 1
SALTS = 32
WORD = 64


def lines_of(text: Column) -> Column:
    """The lines of a text; a null or empty one has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """What makes lines equal: white space at the ends and the case of A-Z do not count."""
    return F.trim(line, F.lit(WHITE))


def line_hashes(docs: DataFrame, key: str, text: str, min_length: int = MIN_LENGTH) -> DataFrame:
    """One row (row_id, key, h1, h2, pos, lead) for each line of at least ``min_length`` code points.

    The lines of a document are sorted by hash and position inside its row; ``lead`` marks the first of equal lines.
    128 bits stand for a line.
    """
    texts = F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), "\n")
    hashed = F.transform(
        texts,
        lambda line, i: let(
            line_key(line),
            lambda k: F.when(
                F.length(k) >= min_length,
                F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"), i.alias("pos")),
            ),
        ),
    )
    marked = let(
        F.array_sort(F.filter(hashed, lambda x: x.isNotNull())),
        lambda a: F.transform(
            a,
            lambda x, i: F.struct(
                x["h1"].alias("h1"),
                x["h2"].alias("h2"),
                x["pos"].alias("pos"),
                (
                    (i == 0)
                    | (F.get(a, i - 1)["h1"] != x["h1"])
                    | (F.get(a, i - 1)["h2"] != x["h2"])
                ).alias("lead"),
            ),
        ),
    )
    return docs.select(row_key(key, text).alias("row_id"), F.col(key).alias("key"), F.explode(marked).alias("line")).select(
        "row_id", "key", "line.h1", "line.h2", "line.pos", "line.lead"
    )


def line_verdicts(lines: DataFrame) -> DataFrame:
    """(h1, h2, first, docs) per distinct line: first occurrence by key and position, and how many rows have it.

    Counts are combined per task and salt before anything is sorted, so a line of every document is at most ``SALTS``
    rows. These are range-partitioned by hash, sorted by hash, document and position, and streamed.
    """
    salted = (
        lines.where("lead")
        .groupBy("h1", "h2", F.pmod(F.col("row_id.a"), F.lit(SALTS)).alias("salt"))
        .agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("key", "pos")).alias("first"))
    )
    ranged = salted.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "first")
    ordered = Window.partitionBy("h1", "h2").orderBy("first")
    return ranged.select(
        "h1",
        "h2",
        "first",
        F.row_number().over(ordered).alias("nth"),
        F.sum("docs").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("docs"),
    ).where("nth = 1").drop("nth")


def drop_bitmaps(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_docs: int = MIN_DOCS,
    min_length: int = MIN_LENGTH,
    keep_first: bool = False,
) -> DataFrame:
    """(row_id, bitmap) for documents that lose lines: the keep bitmap of each, compressed to the lines that go.

    A bitmap is a sorted list of (word, bits), 64 lines to a word; a set bit is a line that goes, and words without any
    are left out. Documents that keep all lines have no row.

    A line found in ``min_docs`` rows is lost everywhere, or, with ``keep_first``, all but its first occurrence by key
    and position. Every row is a document, also a repeated one. Empty lines stay while ``min_length`` is 1.
    """
    lines = line_hashes(docs, key, text, min_length)
    often = line_verdicts(lines).where(F.col("docs") >= min_docs).select("h1", "h2", "first")
    lost = join_unique(lines.drop("lead"), often, ["h1", "h2"], "inner")
    if keep_first:
        lost = lost.where(~F.col("first").eqNullSafe(F.struct("key", "pos")))
    words = lost.groupBy("row_id", F.floor(F.col("pos") / WORD).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, pos % {WORD})")).alias("bits")
    )
    return words.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("bitmap"))


def positions(bitmap: Column) -> Column:
    """The line numbers of a bitmap, ascending."""
    return F.flatten(
        F.transform(
            bitmap,
            lambda w: F.transform(
                F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit(w["bits"], b) == 1),
                lambda b: w["word"] * WORD + b,
            ),
        )
    )


def without(lines: Column, drops: Column) -> Column:
    """The lines whose numbers are not in the ascending ``drops``, taken as slices between them."""
    return let(
        F.concat(F.array(F.lit(-1)), drops, F.array(F.size(lines))),
        lambda cuts: F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.size(cuts) - 1),
                lambda i: F.slice(lines, F.get(cuts, i - 1) + 2, F.get(cuts, i) - F.get(cuts, i - 1) - 1),
            )
        ),
    )


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **rules) -> DataFrame:
    """(key, n_lines, n_dropped, kept) per row of ``docs``: its bitmap applied to its text.

    A null text counts as one empty line and comes back as an empty text. Null keys, repeated rows and other columns
    do no harm; an empty table gives an empty result.
    """
    bitmaps = drop_bitmaps(docs, key, text, **rules)
    rows = docs.select(row_key(key, text).alias("row_id"), F.col(key).alias(key), F.col(text).alias("_text"))
    joined = join_unique(rows, bitmaps, ["row_id"])
    drops = F.coalesce(positions(F.col("bitmap")), F.array().cast("array<int>"))
    kept = let(
        F.struct(lines_of(F.col("_text")).alias("lines"), drops.alias("drops")),
        lambda x: F.struct(
            F.size(x["lines"]).cast("bigint").alias("n_lines"),
            F.size(x["drops"]).cast("bigint").alias("n_dropped"),
            F.concat_ws("\n", without(x["lines"], x["drops"])).alias("kept"),
        ),
    )
    return joined.select(F.col(key), kept.alias("_x")).select(
        key, F.col("_x.n_lines").alias("n_lines"), F.col("_x.n_dropped").alias("n_dropped"), F.col("_x.kept").alias("kept")
    )
