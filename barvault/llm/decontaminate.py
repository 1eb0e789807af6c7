"""Words of documents that lie in a long span shared with a benchmark item, found by winnowing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barvault.llm.support import ascii_lower, indices, let, row_key
from barvault.operators.joins import join_unique
from barvault.session import materialise

SPAN = 10
GRAM = 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# a mark is one long: the upper bits of a gram's hash, then its word position; no string has 2**28 words
_PLACE = (1 << 28) - 1
# a set of so many hashes takes some 16 MB, which every executor can hold
_BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """The words of a text in lower case; none for a null text."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def winnowed(words: Column, gram: int, span: int) -> Column:
    """Marks of the grams that are least by hash in some window of ``span`` words, the leftmost on ties.

    The choice depends on the words of a window only, so equal windows anywhere choose the same gram: every shared
    span of ``span`` words shares at least one mark's hash at the same offset.
    """
    width = span - gram + 1
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    grams = let(
        hashes,
        lambda h: F.transform(
            indices(F.size(h) - (gram - 1)),
            lambda i: F.xxhash64(F.lit(gram), *[F.get(h, i + j) for j in range(gram)])
            .bitwiseAND(F.lit(~_PLACE))
            .bitwiseOR(i.cast("bigint")),
        ),
    )
    if width == 1:
        return grams
    least = let(
        grams,
        lambda g: F.transform(indices(F.size(g) - (width - 1)), lambda i: F.array_min(F.slice(g, i + 1, width))),
    )
    return F.array_distinct(least)


def _located(mark: Column) -> list[Column]:
    return [
        mark.bitwiseAND(F.lit(~_PLACE)).alias("hash"),
        mark.bitwiseAND(F.lit(_PLACE)).cast("int").alias("at"),
    ]


def _phrase(words: Column, start: Column, length: Column) -> Column:
    return F.concat_ws(" ", F.slice(words, start + 1, length))


def _length_classes(items: DataFrame, span: int, gram: int) -> list[tuple[int, int]]:
    """(window length, gram) to look for: ``span``, and every shorter length that some item has, at most span - 1 of
    them; an item shorter than ``span`` is one window, for which each run of its length counts."""
    short = items.where(F.col("n") < span).select("n").distinct().collect()
    return [(span, gram)] + sorted((r["n"], r["n"]) for r in short)


def span_hits(
    docs: DataFrame, items: DataFrame, span: int, gram: int, row_id: str = "row_id"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: documents with word counts (row_id, key, n_words), windows found (row_id, start, length, phrase),
    and the windows of the items (item_id, length, phrase).

    Documents' marks are met with the items' hashes, hits are extended to all windows of ``span`` words around them,
    and a window counts if the very words are some item's.
    """
    classes = _length_classes(items, span, gram)
    windows, marks = [], []
    for length, size in classes:
        sized = items.where(F.col("n") >= span if length == span else F.col("n") == length)
        starts = indices(F.col("n") - (length - 1))
        windows.append(
            sized.select("item_id", F.explode(starts).alias("start"), "words").select(
                "item_id", F.lit(length).alias("length"), _phrase(F.col("words"), F.col("start"), F.lit(length)).alias("phrase")
            )
        )
        marks.append(
            sized.select(F.explode(winnowed(F.col("words"), size, length)).alias("mark")).select(
                F.lit(length).alias("length"), *_located(F.col("mark"))
            )
        )
    phrases, known = windows[0], marks[0]
    for more, others in zip(windows[1:], marks[1:], strict=True):
        phrases, known = phrases.union(more), known.union(others)
    phrases = materialise(phrases.distinct())
    known = materialise(known.select("length", "hash").distinct())
    if known.count() <= _BROADCAST_ROWS:
        known = F.broadcast(known)

    found = None
    for length, size in classes:
        own = docs.select(row_id, F.explode(winnowed(words_of(F.col("text")), size, length)).alias("mark"))
        own = own.select(row_id, F.lit(length).alias("length"), F.lit(length - size).alias("back"), *_located(F.col("mark")))
        found = own if found is None else found.union(own)
    met = found.join(known, ["length", "hash"], "left_semi")
    places = met.groupBy(row_id).agg(F.collect_set(F.struct("length", "back", "at")).alias("places"))

    def spans(own: Column) -> Column:
        # a window as one number, since distinct numbers are found by hashing and distinct structs by comparing all
        around = F.transform(
            "places",
            lambda p: F.transform(
                F.sequence(F.greatest(p["at"] - p["back"], F.lit(0)), F.least(p["at"], F.size(own) - p["length"])),
                lambda start: start.cast("bigint") * 64 + p["length"],
            ),
        )
        return F.transform(
            F.array_distinct(F.flatten(around)),
            lambda w: F.struct(
                F.shiftright(w, 6).cast("int").alias("start"),
                (w % 64).cast("int").alias("length"),
                _phrase(own, F.shiftright(w, 6).cast("int"), (w % 64).cast("int")).alias("phrase"),
            ),
        )

    # the text goes through the shuffle, not its words, which take several times the room
    probe = let(words_of(F.col("text")), lambda own: F.struct(F.size(own).alias("n_words"), spans(own).alias("spans")))
    probed = join_unique(docs.select(row_id, "key", "text"), places, [row_id]).select(row_id, "key", probe.alias("x"))
    probed = probed.select(row_id, "key", "x.n_words", "x.spans")
    probed = materialise(probed)
    candidates = probed.select(row_id, F.explode("spans").alias("s")).select(row_id, "s.*")
    texts = phrases.select("phrase", "length").distinct()
    hits = materialise(join_unique(candidates, texts, ["phrase", "length"], "left_semi"))
    return probed.drop("spans"), hits, phrases


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
    identity: Sequence[str] = (),
) -> DataFrame:
    """(row_id, key, n_words, n_hit, items) per row of ``docs``; ``items`` are the ids, as strings, in code point order.

    A word is hit if it lies in a run of ``span`` words that some item has too, or in a whole item of fewer words.
    Items without words, and documents without any, hit nothing. A null text has no words; an item with a null id hits
    words but is not listed; repeated ids count once. Repeated rows come back as often as they are there; an empty
    benchmark hits nothing and an empty table gives an empty result. ``row_id`` stands for the columns of ``identity``,
    or for key and text. Spans are limited to 63 words.
    """
    if not 1 <= gram <= span <= 63:
        raise ValueError("1 <= gram <= span <= 63 is needed")
    rows = docs.select(
        row_key(*(identity or (key, text))).alias("row_id"), F.col(key).alias("key"), F.col(text).alias("text")
    )
    items = benchmark.select(F.col(item_key).cast("string").alias("item_id"), words_of(F.col(item_text)).alias("words"))
    items = items.withColumn("n", F.size("words")).where("n > 0")
    counted, hits, phrases = span_hits(rows, items, span, gram)
    covered = hits.groupBy("row_id").agg(F.collect_set(F.col("start").cast("bigint") * 64 + F.col("length")).alias("w"))
    runs = F.transform("w", lambda w: F.sequence(F.shiftright(w, 6), F.shiftright(w, 6) + w % 64 - 1))
    covered = covered.select("row_id", F.size(F.array_distinct(F.flatten(runs))).alias("n_hit"))
    owners = phrases.where("item_id IS NOT NULL")
    listed = (
        hits.select("row_id", "phrase", "length").distinct().join(owners, ["phrase", "length"])
        .groupBy("row_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    verdict = covered.join(listed, "row_id", "left")
    return join_unique(counted, verdict, ["row_id"]).select(
        "row_id",
        "key",
        F.col("n_words").cast("bigint").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
