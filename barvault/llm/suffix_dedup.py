"""Removal of every byte covered by a long string that also starts elsewhere, by deep-shallow suffix sorting.

Sorting all suffixes of a corpus would move each byte ``length`` times. The positions to sort are narrowed first, and
nothing that repeats is lost:

1. *Anchors.* The string of ``length`` bytes at a position is assigned to the least, by hash, of its first ``WINDOW``
   substrings of ``length - WINDOW + 1`` bytes. The choice depends on the string alone, so equal strings have equal
   anchors. Neighbouring positions mostly share one: there are about 2 / ``WINDOW`` anchors a byte.
2. Strings whose anchor occurs once do not repeat. For the rest, a *carrier* is the text of all positions of one anchor.
   Equal carriers are folded: what is in two of them repeats as a whole.
3. Different carriers with one anchor are brought together, and the suffixes at all their positions are sorted. Two
   that are next to each other and equal for ``length`` bytes are a repeat. An anchor with very many different
   carriers is split: its strings are sorted within tasks first, and one of each meets the others by its own hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barvault.llm import rolling
from barvault.llm.suffix_sort import sort_suffixes
from barvault.llm.support import small_batches
from barvault.operators.joins import join_unique
from barvault.session import materialise

LENGTH = 200
WINDOW = 120
WIDE = 1_000
CHUNK = 300_000  # suffixes sorted at once
PIECE = 1 << 22
SEEN = 100_000

# a place is one long: 15 bits of a second hash of the text, the first position, the number of positions
_TAG_BITS, _START_BITS, _COUNT_BITS = 15, 41, 7
# a span is one long: its start and its length
_SPAN = 1 << 16


def text_ref(data: Column) -> list[Column]:
    """What stands for a text in tables without it: 79 bits of hashes."""
    return [F.xxhash64(data).alias("ref"), F.pmod(F.xxhash64(F.lit(1), data), F.lit(1 << _TAG_BITS)).alias("tag")]


def anchors(data: bytes, length: int, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash of the anchor, first position, number of positions) for each run of positions with one anchor."""
    size = length - window + 1
    for at in range(0, len(data) - length + 1, PIECE):
        letters = np.frombuffer(data[at : at + PIECE + length - 1], np.uint8)
        hashes = rolling.window_hash(rolling.prefixes(letters), size)
        low = np.uint64((1 << 24) - 1)
        placed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        chosen = (rolling.sliding_min(placed, window) & low).astype(np.int64)
        starts = np.flatnonzero(np.diff(chosen, prepend=-1))
        counts = np.diff(np.append(starts, len(chosen)))
        yield hashes[chosen[starts]].view(np.int64), starts + at, counts


def anchor_rows(texts: DataFrame, length: int, window: int) -> DataFrame:
    """(mark, ref, place) for every anchor of (ref, tag, data)."""

    def find(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            marks, places, refs = [], [], []
            for ref, tag, data in zip(batch["ref"], batch["tag"], batch["data"], strict=True):
                for mark, start, count in anchors(data, length, window):
                    marks.append(mark)
                    places.append((tag << (_START_BITS + _COUNT_BITS)) | (start << _COUNT_BITS) | count)
                    refs.append(np.full(len(mark), ref, np.int64))
            if marks:
                yield pd.DataFrame(
                    {"mark": np.concatenate(marks), "ref": np.concatenate(refs), "place": np.concatenate(places)}
                )

    return texts.where(F.length("data") >= length).mapInPandas(find, "mark bigint, ref bigint, place bigint")


def carriers(texts: DataFrame, repeated: DataFrame, length: int) -> DataFrame:
    """(mark, fold, ref, tag, start, n, data) for every anchor in ``repeated``: the text of its positions.

    ``fold`` is a 128-bit hash of that text; a task hands on the text itself once, not for every copy it meets.
    """
    wanted = repeated.withColumn("tag", F.shiftright("place", _START_BITS + _COUNT_BITS))
    wanted = wanted.groupBy("ref", "tag").agg(F.collect_set(F.struct("mark", "place")).alias("found"))
    joined = join_unique(texts, wanted, ["ref", "tag"], "inner")
    joined = joined.select(
        "ref", "tag", "data", F.col("found.mark").alias("marks"), F.col("found.place").alias("places")
    )

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for ref, tag, data, marks, places in batch.itertuples(index=False):
                starts = (places >> _COUNT_BITS) & ((1 << _START_BITS) - 1)
                counts = places & ((1 << _COUNT_BITS) - 1)
                for mark, start, count in zip(marks.tolist(), starts.tolist(), counts.tolist(), strict=True):
                    text = data[start : start + count + length - 1]
                    fold = xxhash.xxh3_128_digest(text)
                    rows.append((mark, fold, ref, tag, start, count, None if fold in seen else text))
                    seen.add(fold)
                if len(seen) > SEEN:
                    seen.clear()
            yield pd.DataFrame(rows, columns=["mark", "fold", "ref", "tag", "start", "n", "data"])

    return joined.mapInPandas(
        cut, "mark bigint, fold binary, ref bigint, tag bigint, start bigint, n int, data binary"
    )


def _runs(owner: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first and last of the runs of successive offsets of one owner."""
    if not len(owner):
        return owner, offset, offset
    order = np.lexsort((offset, owner))
    owner, offset = owner[order], offset[order]
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)])
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], offset[first], offset[last]


class _Bundle:
    """Texts whose suffixes are sorted together: rows (bucket, fold, n, known, data)."""

    def __init__(self, length: int):
        self.length = length
        self.clear()

    def clear(self) -> None:
        self.met: set[bytes] = set()
        self.rows: list[tuple] = []
        self.suffixes = 0

    def add(self, bucket: int, fold: bytes, n: int, known: bool, data: bytes) -> None:
        if fold not in self.met:
            self.met.add(fold)
            self.rows.append((bucket, fold, n, known, data))
            self.suffixes += n

    def verdicts(self) -> pd.DataFrame:
        """(fold, first, last): runs of positions in a text that repeat and were not known to."""
        text = b"".join(row[4] for row in self.rows)
        sizes = np.array([len(row[4]) for row in self.rows])
        counts = np.array([row[2] for row in self.rows])
        known = np.array([row[3] for row in self.rows], dtype=bool)
        row = np.repeat(np.arange(len(counts)), counts)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        base = (np.cumsum(sizes) - sizes)[row]
        order, same = sort_suffixes(text, base + offset, self.length)
        again = same | np.append(same[1:], False)
        # back from sorted positions to rows: positions rise with row and offset
        rank = np.searchsorted(base + offset, order)
        wanted = again & ~known[row[rank]]
        owner, first, last = _runs(row[rank][wanted], offset[rank][wanted])
        return pd.DataFrame({"fold": [self.rows[i][1] for i in owner], "first": first, "last": last})


def _split(crowded: DataFrame, length: int, window: int) -> DataFrame:
    """(mark, part, fold, at, n, known, data) for every longer anchor of the carriers (fold, n, known, data).

    A part is the text of the positions of one anchor, as a carrier is of a text; ``at`` is where it starts in its carrier.
    A carrier of m positions has some 2 * m / ``window`` parts, however many carriers there are.
    """

    def split(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for fold, known, data in batch.itertuples(index=False):
                for marks, starts, counts in anchors(data, length, window):
                    for mark, start, count in zip(marks.tolist(), starts.tolist(), counts.tolist(), strict=True):
                        text = data[start : start + count + length - 1]
                        part = xxhash.xxh3_128_digest(text)
                        rows.append((mark, part, fold, start, count, known, None if part in seen else text))
                        seen.add(part)
                if len(seen) > SEEN:
                    seen.clear()
            yield pd.DataFrame(rows, columns=["mark", "part", "fold", "at", "n", "known", "data"])

    return crowded.select("fold", "known", "data").mapInPandas(
        split, "mark bigint, part binary, fold binary, at bigint, n int, known boolean, data binary"
    )


def _sorted_verdicts(rows: DataFrame, length: int) -> DataFrame:
    """(fold, first, last) for the rows (bucket, fold, n, known, data): equal strings have equal buckets.

    Buckets are dealt by hash and stream by in sorted order, some at a time, so memory does not depend on a task's share.
    """

    def judge(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle, last = _Bundle(length), None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row[0] != last and bundle.suffixes >= CHUNK:
                    yield bundle.verdicts()
                    bundle.clear()
                last = row[0]
                bundle.add(*row)
        if bundle.rows:
            yield bundle.verdicts()

    dealt = rows.select("bucket", "fold", "n", "known", "data").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInPandas(judge, "fold binary, first bigint, last bigint")


def _meeting(texts: DataFrame, kinds: DataFrame) -> DataFrame:
    """(mark, fold, n, known, kinds, data): the texts that must be compared with others of their anchor.

    ``kinds`` has a row (mark, fold, known) per different text. Which ones meet is found without the texts; these are
    attached at the end, in one shuffle.
    """
    crowds = kinds.groupBy("mark").agg(F.count(F.lit(1)).alias("kinds"), F.min("known").alias("_all_known"))
    crowds = crowds.where("kinds > 1 AND NOT _all_known").select("mark", "kinds")
    wanted = join_unique(kinds, crowds, ["mark"], "inner").select("fold", "known", "kinds")
    held = texts.where("data IS NOT NULL").select("mark", "fold", "n", "data")
    return materialise(join_unique(held, wanted, ["fold"], "inner"))


def _partial_repeats(held: DataFrame, length: int, window: int) -> DataFrame:
    """(fold, first, last): runs of positions that repeat in the texts of ``_meeting``, but for those known as a whole.

    The texts of an anchor are sorted together. Those of a crowded one are split by longer anchors first.
    """
    own = [F.col("mark").alias("bucket"), "fold", "n", "known", "data"]
    if window == 1:
        return _sorted_verdicts(held.select(*own), length)
    found = _sorted_verdicts(held.where(F.col("kinds") <= WIDE).select(*own), length)
    # a task hands on a text once, so several of them may have handed on the same one
    wide = held.where(F.col("kinds") > WIDE).dropDuplicates(["fold"])
    if wide.isEmpty():
        return found
    longer = max(1, window // 4)
    pieces = materialise(_split(wide, length, longer))
    parts = pieces.groupBy("mark", F.col("part").alias("fold"), "n").agg(
        F.count(F.lit(1)).alias("times"), F.max("known").alias("known")
    )
    parts = materialise(parts.withColumn("known", F.col("known") | (F.col("times") > 1)))
    texts = pieces.select("mark", F.col("part").alias("fold"), "n", "data")
    inner = _partial_repeats(_meeting(texts, parts.select("mark", "fold", "known")), length, longer)
    places = pieces.where("NOT known").select(F.col("part").alias("fold"), F.col("fold").alias("_carrier"), "at")
    runs = _with_runs(places, inner.union(_whole(parts)))
    return found.union(
        runs.select(
            F.col("_carrier").alias("fold"),
            (F.col("at") + F.col("run.first")).alias("first"),
            (F.col("at") + F.col("run.last")).alias("last"),
        )
    )


def _whole(kinds: DataFrame) -> DataFrame:
    """(fold, first, last) of the texts that are in more than one place."""
    zero = F.lit(0).cast("bigint")
    return kinds.where("times > 1").select("fold", zero.alias("first"), (F.col("n") - 1).cast("bigint").alias("last"))


def _with_runs(places: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``places`` of texts with each ``run`` (first, last) that repeats in their text."""
    grouped = verdicts.groupBy("fold").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    return join_unique(places, grouped, ["fold"], "inner").withColumn("run", F.explode("runs")).drop("runs")


def repeated_spans(texts: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """(ref, tag, spans) for the texts (ref, tag, data) that hold repeats; a span is start * 2**16 + length, spans
    overlap and together cover every byte that repeats."""
    marks = materialise(anchor_rows(texts, length, window))
    often = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("mark")
    members = materialise(carriers(texts, join_unique(marks, often, ["mark"], "inner"), length))

    folds = materialise(members.groupBy("fold", "mark", "n").agg(F.count(F.lit(1)).alias("times")))
    kinds = folds.select("mark", "fold", (F.col("times") > 1).alias("known"))
    found = _partial_repeats(_meeting(members, kinds), length, window)

    runs = _with_runs(members.select("fold", "ref", "tag", "start"), found.union(_whole(folds)))
    spans = runs.select(
        "ref", "tag", ((F.col("start") + F.col("run.first")) * _SPAN + F.col("run.last") - F.col("run.first") + length).alias("span")
    )
    return spans.groupBy("ref", "tag").agg(F.collect_set("span").alias("spans"))


def merged(spans: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that overlapping or touching spans cover."""
    if spans is None or not len(spans):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    spans = np.sort(spans)
    starts, ends = spans // _SPAN, np.maximum.accumulate(spans // _SPAN + spans % _SPAN)
    fresh = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]])
    return starts[fresh], ends[np.append(fresh[1:] - 1, len(ends) - 1)]


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, window: int = WINDOW
) -> DataFrame:
    """(key, n_bytes, starts, ends, kept) per row of ``docs``: the maximal removed runs and the bytes that are left.

    A byte goes if a string of ``length`` bytes that covers it also starts at another place, in this row or another one.
    Matches overlap freely, never cross rows, and are judged on the input. A null text has no bytes. Repeated rows
    are places of their own, so from ``length`` bytes on they lose everything. Null keys and other columns do no harm;
    an empty table gives an empty result.
    """
    if not 1 <= window < min(length, 1 << _COUNT_BITS) or length + window >= _SPAN:
        raise ValueError("the window must be shorter than the length and than 128, and both together below 65,536")
    small_batches(docs.sparkSession)
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(key).alias(key), data.alias("data")).select(key, "data", *text_ref(F.col("data")))
    spans = repeated_spans(rows.drop(key), length, window)
    # the key goes through Python under a name of its own
    joined = join_unique(rows.withColumnRenamed(key, "key"), spans, ["ref", "tag"]).select("key", "data", "spans")

    def strip(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for own, whole, found in batch.itertuples(index=False):
                starts, ends = merged(found)
                left, at = [], 0
                for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
                    left.append(whole[at:start])
                    at = end
                out.append((own, len(whole), starts, ends, b"".join([*left, whole[at:]])))
            yield pd.DataFrame(out, columns=["key", "n_bytes", "starts", "ends", "kept"])

    kind = joined.schema["key"].dataType.simpleString()
    done = joined.mapInPandas(
        strip, f"key {kind}, n_bytes bigint, starts array<bigint>, ends array<bigint>, kept binary"
    )
    return done.withColumnRenamed("key", key)
