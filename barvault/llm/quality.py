"""Selection of documents by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barvault.llm import rolling
from barvault.llm.support import numbered, row_key, small_batches, uniform
from barvault.session import materialise

BUCKETS = 1 << 14  # one half for words, one for pairs of words
TARGET_ROWS = 50_000
SEED = 29
LOW = 0.002
MARGIN = 2.0
PRIOR = 0.5
WORDS = 50


def features(data: bytes | None, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Bucket numbers of the words, runs of other signs, and pairs of neighbours in a UTF-8 text, piece by piece.

    A token followed by itself falls into a bucket of its own: which one is repeated does not matter.
    """
    half, last = np.uint64(buckets // 2), np.empty(0, np.uint64)
    for piece in rolling.pieces(data or b""):
        letters = np.frombuffer(piece, np.uint8)
        words = rolling.span_hash(rolling.prefixes(letters), *rolling.tokens(letters, marks=True))
        run = np.concatenate([last, words])
        last = run[-1:]
        pairs = rolling.mix(run[:-1] * np.uint64(rolling.BASE) + run[1:]) >> np.uint64(24)
        pairs = np.where(run[:-1] == run[1:], np.uint64(0), np.uint64(1) + pairs % (half - np.uint64(1)))
        yield np.concatenate([(words >> np.uint64(24)) % half, pairs + half]).astype(np.int64)


def count_features(docs: DataFrame, text: Column, is_target: Column, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target): how often each bucket occurs in all texts and in the target's, summed within tasks first."""

    find = functools.partial(features, buckets=buckets)

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for counts, texts in ((raw, batch["text"]), (target, batch["text"][batch["wanted"]])):
                for some in itertools.batched(itertools.chain.from_iterable(map(find, texts)), 64):
                    counts += np.bincount(np.concatenate(some), minlength=buckets)
        some = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": some, "raw": raw[some], "target": target[some]})

    small_batches(docs.sparkSession)
    texts = docs.select(text.cast("binary").alias("text"), F.coalesce(is_target, F.lit(False)).alias("wanted"))
    counts = texts.mapInPandas(count, "bucket bigint, raw bigint, target bigint")
    return counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def models(counts: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket's share of the raw text, and its count in the target.

    The table has at most ``buckets`` rows, whatever the input's size. A bucket starts with one raw count.
    """
    raw, target = np.ones(buckets), np.zeros(buckets)
    for row in counts.collect():
        raw[row["bucket"]] += row["raw"]
        target[row["bucket"]] += row["target"]
    return raw / raw.sum(), target


def log_ratios(raw: np.ndarray, target: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log target share - log raw share of each bucket.

    The target model gets ``prior`` times its own counts on top, dealt out like the raw ones, so that what it has not
    seen is not impossible, and raw text outweighs a small target as little as a large one. Without a target all ratios
    are 0.
    """
    if target.sum() <= 0:
        return np.zeros(len(raw))
    return np.log((target / target.sum() + prior * raw) / (1 + prior)) - np.log(raw)


def _dampened(n: int, words: int) -> float:
    """A longer text weighs like ``words`` words of its kind, or length would decide over kind."""
    return min(1.0, 2 * words / max(n, 1))


def importance(text: Column, ratios: np.ndarray, words: int = WORDS) -> Column:
    """Log importance weight of a text: how much likelier the target model makes it than the raw one."""
    buckets = len(ratios)

    def weight(data: bytes | None) -> float:
        total, n = 0.0, 0
        for found in features(data, buckets):
            total, n = total + float(ratios[found].sum()), n + len(found)
        return total * _dampened(n, words)

    @F.pandas_udf("double")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([weight(data) for data in batch], dtype="float64")

    return weigh(text.cast("binary"))


def left_out(text: Column, raw: np.ndarray, target: np.ndarray, prior: float = PRIOR, words: int = WORDS) -> Column:
    """Log importance weight of a target text by the model of the other target texts."""
    buckets = len(raw)

    def weight(data: bytes | None) -> float:
        own = np.zeros(buckets)
        for found in features(data, buckets):
            own += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(own)
        ratios = log_ratios(raw, target - own, prior)
        return float(own[met] @ ratios[met]) * _dampened(int(own.sum()), words)

    @F.pandas_udf("double")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([weight(data) for data in batch], dtype="float64")

    return weigh(text.cast("binary"))


def least_weight(targets: DataFrame, raw: np.ndarray, target: np.ndarray, prior: float, low: float) -> float | None:
    """The weight that a share ``low`` of the target keys stay below, each weighed by a model that has not seen it.

    ``targets`` has (_target, _text); a key with several texts counts with its least weight, so the percentile is
    that of at most as many values as there are target keys. Null without a target.
    """
    weighed = targets.select("_target", left_out(F.col("_text"), raw, target, prior).alias("weight"))
    return weighed.groupBy("_target").agg(F.min("weight").alias("weight")).agg(F.percentile("weight", low)).first()[0]


def target_rows(labels: DataFrame, key: str, label: str, seed: int, most: int) -> DataFrame:
    """Keys labelled 1 in every one of their rows, at most ``most`` of them, chosen by a seeded hash."""
    good = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_target")).agg(F.min(label).alias("least"))
    return good.where("least = 1").orderBy(F.xxhash64(F.lit(seed), "_target"), "_target").limit(most).select("_target")


def resample(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    buckets: int = BUCKETS,
    most_targets: int = TARGET_ROWS,
    seed: int = SEED,
    margin: float = MARGIN,
    prior: float = PRIOR,
    low: float = LOW,
    identity: Sequence[str] = (),
) -> DataFrame:
    """(row_id, key, log_weight, perturbed, selected) per row of ``docs``.

    The target model counts the documents labelled 1, at most ``most_targets`` of them; the raw model counts all
    documents. Gumbel noise from a seeded hash of key and text is added to the log weight, and the k largest sums
    are selected: sampling without replacement in proportion to the weights. k is the number of documents that weigh at
    least what target documents do that the model has not seen: each target document is weighed by the model of the
    others, and all but a share ``low`` of these weights, less ``margin``, reach the cut. So the cut follows what the
    labels can tell: with few of them all weights come closer, those of the target too.

    Ranks come from a distributed sort; ties go by key. ``row_id`` stands for the columns of ``identity``, or for key
    and text. Null and empty texts weigh as 1 does (0 in logs). Repeated rows share weight and noise. Without labels
    all weights are equal and all rows are selected; with one target document, which leaves no other to weigh it, the
    cut is ``margin`` below 0; an empty table gives an empty result.
    """
    ids = target_rows(labels, key, label, seed, most_targets)
    # at most most_targets keys of eight bytes
    flagged = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(
        F.broadcast(ids), F.col("_key") == F.col("_target"), "left"
    )
    raw, target = models(count_features(flagged, F.col("_text"), F.col("_target").isNotNull(), buckets), buckets)
    ratios = log_ratios(raw, target, prior)
    small_batches(docs.sparkSession)
    least = least_weight(flagged.where("_target IS NOT NULL"), raw, target, prior, low) or 0.0
    noise = -F.log(-F.log(uniform(seed, key, text)))
    scored = materialise(
        docs.select(
            row_key(*(identity or (key, text))).alias("row_id"),
            F.col(key).alias("key"),
            importance(F.col(text), ratios).alias("log_weight"),
            noise.alias("noise"),
        )
    ).select("row_id", "key", "log_weight", (F.col("log_weight") + F.col("noise")).alias("perturbed"))
    k = scored.where(F.col("log_weight") >= least - margin).count()
    ranked = numbered(scored, [F.desc("perturbed"), F.asc_nulls_last("key"), "row_id"], "nth")
    return ranked.withColumn("selected", F.col("nth") < k).drop("nth")
