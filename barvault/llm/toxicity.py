"""Toxicity scores from a classifier that is penalised for changing its mind when identity terms are swapped."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barvault.llm import rolling
from barvault.llm.support import row_key, small_batches
from barvault.session import materialise

TRAIN_ROWS = 20_000
CANDIDATES = 50_000
FEATURES = 2_000
LEAST_POSITIVES = 3
LEAST_Z = 2.5
STEMS = (5, 6, 7, 8)
RIDGE = 0.02
COUNTERFACTUAL = 10.0
SEED = 11
THRESHOLD = 0.7

# Groups of identity terms; a swap replaces a term by the next one of its group.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("woman", "man"),
    ("women", "men"),
    ("female", "male"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly"),
    ("femme", "homme"),
    ("femmes", "hommes"),
    ("chrétien", "musulman", "juif"),
    ("frau", "mann"),
    ("frauen", "männer"),
    ("christ", "moslem", "jude"),
    ("mujer", "hombre"),
    ("mujeres", "hombres"),
    ("cristiano", "musulmán", "judío"),
)

_LUT_BITS = 20


def _hashes(words: Iterable[str]) -> np.ndarray:
    found = []
    for word in words:
        letters = np.frombuffer(word.encode(), np.uint8)
        ends = [len(letters)] + [n for n in STEMS if n < len(letters)]
        whole = rolling.span_hash(rolling.prefixes(letters), np.zeros(len(ends), int), np.array(ends))
        found.append(whole + np.array([0] + ends[1:], dtype=np.uint64))
    return np.concatenate(found) if found else np.empty(0, np.uint64)


#: hash of a term -> all features of the one that takes its place
_SWAPS = {
    int(_hashes([term])[0]): _hashes([group[(i + 1) % len(group)]])
    for group in IDENTITY_TERMS
    for i, term in enumerate(group)
}
_TERMS = np.sort(np.array(list(_SWAPS), dtype=np.uint64))


def _features(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words between ``start`` and ``end``, and of their stems."""
    found = [rolling.span_hash(sums, start, end)]
    for size in STEMS:
        long = end - start > size
        found.append(rolling.span_hash(sums, start[long], start[long] + size) + np.uint64(size))
    return np.concatenate(found)


def word_features(data: bytes | None) -> Iterator[np.ndarray]:
    """Hashes of the lower-cased words of a UTF-8 text and of their stems of 5 to 8 bytes, piece by piece."""
    for piece in rolling.pieces(data or b""):
        letters = rolling.lowered(np.frombuffer(piece, np.uint8))
        yield _features(rolling.prefixes(letters), *rolling.tokens(letters, marks=False))


def swapped(data: bytes | None) -> np.ndarray | None:
    """The distinct features after every identity term was replaced; None for a text without such terms.

    A stem that a term shares with another word of the text stays. The words around a term do not matter to features
    of single words, so a swapped sentence differs from its original in the features of the terms only.
    """
    found, any_term = [], False
    for piece in rolling.pieces(data or b""):
        letters = rolling.lowered(np.frombuffer(piece, np.uint8))
        sums, (start, end) = rolling.prefixes(letters), rolling.tokens(letters, marks=False)
        words = rolling.span_hash(sums, start, end)
        term = np.isin(words, _TERMS)
        found.append(_features(sums, start[~term], end[~term]))
        found.extend(_SWAPS[int(t)] for t in np.unique(words[term]))
        any_term |= bool(term.any())
    return np.unique(np.concatenate(found)) if any_term else None


class Chosen:
    """A sorted set of feature hashes that finds its members among many hashes fast."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.astype(np.uint64))
        self.maybe = np.zeros(1 << _LUT_BITS, bool)
        self.maybe[self._slot(self.hashes)] = True

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - _LUT_BITS)).astype(np.int64)

    def members(self, features: np.ndarray) -> np.ndarray:
        """Numbers of the members that occur, ascending."""
        near = np.unique(features[self.maybe[self._slot(features)]])
        if not len(self.hashes) or not len(near):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, near), len(self.hashes) - 1)
        return at[self.hashes[at] == near]


def _distinct(data: bytes | None) -> np.ndarray:
    found = list(word_features(data))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def _candidates(train: DataFrame, limit: int) -> np.ndarray:
    """Hashes found in at least ``LEAST_POSITIVES`` toxic training texts, the most frequent ``limit``."""

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            each = [_distinct(data) for data, toxic in zip(batch["text"], batch["toxic"], strict=True) if toxic]
            if each:
                found, times = np.unique(np.concatenate(each), return_counts=True)
                yield pd.DataFrame({"hash": _signed(found), "n": times})

    counts = train.mapInPandas(count, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= LEAST_POSITIVES).orderBy(F.desc("n"), "hash").limit(limit).collect()
    return np.array([r["hash"] for r in rows], dtype=np.int64).view(np.uint64)


def _telling(train: DataFrame, candidates: np.ndarray, limit: int) -> np.ndarray:
    """The candidates that stand in toxic texts more often than in others beyond doubt, the most telling ``limit``."""
    chosen = Chosen(candidates)

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, len(candidates)), np.int64)
        rows = [0, 0]
        for batch in batches:
            for data, toxic in zip(batch["text"], batch["toxic"], strict=True):
                counts[int(toxic), chosen.members(_distinct(data))] += 1
                rows[int(toxic)] += 1
        # feature -1 counts the rows
        good, bad = (np.append(rows[toxic], counts[toxic]) for toxic in (0, 1))
        yield pd.DataFrame({"feature": np.arange(-1, len(candidates)), "bad": bad, "good": good})

    found = train.mapInPandas(count, "feature int, bad bigint, good bigint").groupBy("feature").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")
    )
    both = np.zeros((len(candidates) + 1, 2))
    for row in found.collect():
        both[row["feature"] + 1] = row["bad"], row["good"]
    (bad_rows, good_rows), (bad, good) = both[0], both[1:].T + 0.5
    # by the lower end of the log odds ratio: a frequent word that differs a little counts less than a telling one
    odds = np.log(bad / (bad_rows + 1)) - np.log(good / (good_rows + 1))
    surely = odds - LEAST_Z * np.sqrt(1 / bad + 1 / good)
    best = np.argsort(-surely, kind="stable")[:limit]
    return chosen.hashes[best[surely[best] > 0]]


def _training_rows(train: DataFrame, chosen: Chosen) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Labels, chosen features of each text, and those that its swapped version gains or loses (signed, from 1)."""

    def code(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own, changed = [], []
            for data in batch["text"]:
                features = _distinct(data)
                here = chosen.members(features)
                other = swapped(data)
                there = here if other is None else chosen.members(other)
                own.append(here.astype("<i4").tobytes())
                gone, come = np.setdiff1d(here, there), np.setdiff1d(there, here)
                changed.append(np.concatenate([come + 1, -gone - 1]).astype("<i4").tobytes())
            yield pd.DataFrame({"toxic": batch["toxic"], "own": own, "changed": changed})

    rows = train.mapInPandas(code, "toxic int, own binary, changed binary").collect()
    listed = sorted((r["toxic"], bytes(r["own"]), bytes(r["changed"])) for r in rows)
    labels = np.array([r[0] for r in listed], dtype=float)
    return labels, [np.frombuffer(r[1], "<i4") for r in listed], [np.frombuffer(r[2], "<i4") for r in listed]


class _Rows:
    """Sparse rows of a matrix: products with a vector from either side."""

    def __init__(self, rows: list[np.ndarray], width: int, signs: bool = False):
        self.count, self.width = len(rows), width
        flat = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.value = np.sign(flat).astype(float) if signs else np.ones(len(flat))
        self.column = np.abs(flat) - 1 if signs else flat

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.column], self.count)

    def back(self, errors: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * errors[self.row], self.width)


def fit(
    labels: np.ndarray, own: list[np.ndarray], changed: list[np.ndarray], width: int, ridge: float, counterfactual: float
) -> np.ndarray:
    """Weights and, last, the intercept of a logistic regression.

    Its loss is the log loss + ridge / 2 |w|^2 + counterfactual / 2 * the sum of squared changes of the score between
    a text and its swapped version. Minimised by Newton steps whose equations are solved by conjugate gradients.
    """
    rows, swaps = _Rows(own, width), _Rows([c for c in changed if len(c)], width, signs=True)

    def loss(w: np.ndarray) -> float:
        margin = rows.times(w[:-1]) + w[-1]
        fit_loss = np.logaddexp(0, margin).sum() - labels @ margin
        return fit_loss + ridge / 2 * (w[:-1] @ w[:-1]) + counterfactual / 2 * np.square(swaps.times(w[:-1])).sum()

    share = np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3)
    w = np.zeros(width + 1)
    w[-1] = np.log(share / (1 - share))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows.times(w[:-1]) + w[-1], -35, 35)))
        gradient = np.append(
            rows.back(p - labels) + ridge * w[:-1] + counterfactual * swaps.back(swaps.times(w[:-1])), (p - labels).sum()
        )
        if np.abs(gradient).max(initial=0) < 1e-6 * max(1, len(labels)):
            break
        curve = p * (1 - p) + 1e-9

        def bend(v: np.ndarray, curve: np.ndarray = curve) -> np.ndarray:
            inner = curve * (rows.times(v[:-1]) + v[-1])
            tied = ridge * v[:-1] + counterfactual * swaps.back(swaps.times(v[:-1]))
            return np.append(rows.back(inner) + tied, inner.sum())

        step, rest = np.zeros_like(w), -gradient
        way, size = rest.copy(), rest @ rest
        for _ in range(100):
            bent = bend(way)
            length = size / max(way @ bent, 1e-300)
            step, rest = step + length * way, rest - length * bent
            smaller = rest @ rest
            if smaller < 1e-8 * (gradient @ gradient):
                break
            way, size = rest + smaller / size * way, smaller
        scale, before = 1.0, loss(w)
        while loss(w + scale * step) > before and scale > 1e-4:
            scale /= 2
        w = w + scale * step
    return w


@dataclass(frozen=True)
class Model:
    """Chosen features and their weights; ``bias`` is the score's logit without any of them."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, text: Column) -> Column:
        """Likelihood, from 0 to 1, that a text is toxic; null and empty texts get that of a text without features."""
        return self._of(text, lambda chosen, data: self._likelihood(_met(chosen, data)))

    def gap(self, text: Column) -> Column:
        """How far the score moves when the identity terms of a text are swapped; 0 for a text without any."""

        def moved(chosen: Chosen, data: bytes | None) -> float:
            other = swapped(data)
            if other is None:
                return 0.0
            return abs(self._likelihood(chosen.members(other)) - self._likelihood(_met(chosen, data)))

        return self._of(text, moved)

    def _likelihood(self, members: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[members].sum(), -35, 35))))

    def _of(self, text: Column, value: Callable[[Chosen, bytes | None], float]) -> Column:
        hashes = self.hashes

        @F.pandas_udf("double")
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            chosen = Chosen(hashes)
            for batch in batches:
                yield pd.Series([value(chosen, data) for data in batch], dtype="float64")

        return of(text.cast("binary"))


def _met(chosen: Chosen, data: bytes | None) -> np.ndarray:
    """Numbers of the chosen features that occur in a text, ascending."""
    met = [chosen.members(found) for found in word_features(data)]
    return np.unique(np.concatenate(met)) if met else np.empty(0, np.int64)


def _drawn(joined: DataFrame, rows: int, seed: int) -> DataFrame:
    """(_row): at most ``rows`` of the different (_id, _row), one of each _id before a second one of any."""
    order = F.struct(F.xxhash64(F.lit(seed), "_row").alias("hash"), "_row")
    different = materialise(joined.distinct())
    # at most as many as sampled keys
    first = different.groupBy("_id").agg(F.min(order)["_row"].alias("_row")).select("_row", F.lit(0).alias("later"))
    ranked = different.join(F.broadcast(first), "_row", "left")
    return ranked.orderBy(F.coalesce("later", F.lit(1)), F.xxhash64(F.lit(seed), "_row"), "_row").limit(rows).select("_row")


def train_model(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    rows: int = TRAIN_ROWS,
    candidates: int = CANDIDATES,
    features: int = FEATURES,
    ridge: float = RIDGE,
    counterfactual: float = COUNTERFACTUAL,
    seed: int = SEED,
) -> Model:
    """A model learnt from the labelled texts, at most ``rows`` of them, chosen by a seeded hash.

    A key labelled twice takes the larger label; null keys and labels teach nothing. Equal rows teach once; a key with
    several texts teaches one of them, and more only where not every key is needed for the ``rows``. The sample is the
    only data that is bounded, and it is a parameter: its keys are broadcast, candidate words and their counts are gathered by
    tasks, and the fit sees the numbers of the at most ``features`` telling words of each sampled text; larger
    ``candidates`` and ``features`` admit rarer and less telling words. Texts are read whole, however long. Ties go by
    hash. Without labels, or with one kind only, the model has no words and scores by the share of label 1.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(key).alias("_id")).agg(F.max(label).cast("int").alias("_toxic"))
    sample = known.orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(rows)
    texts = docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("text"))
    joined = texts.join(F.broadcast(sample), F.col("_key") == F.col("_id"))
    drawn = _drawn(joined.select("_id", row_key("_id", "text").alias("_row")), rows, seed)
    # distinct on whole rows: repeated ones are folded within tasks, before they are shuffled
    some = joined.withColumn("_row", row_key("_id", "text")).join(F.broadcast(drawn), "_row", "left_semi")
    train = materialise(some.select("_id", "text", F.col("_toxic").alias("toxic")).distinct().drop("_id"))
    found = _candidates(train, candidates)
    hashes = _telling(train, found, features) if len(found) else found
    chosen = Chosen(hashes)
    toxic, own, changed = _training_rows(train, chosen)
    weights = fit(toxic, own, changed, len(chosen.hashes), ridge, counterfactual)
    return Model(chosen.hashes, weights[:-1], float(weights[-1]))


def held_out(key: str) -> Column:
    """Whether a key's labels are kept from training: crc32 of its text modulo 3 is 1. False for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **training
) -> DataFrame:
    """(key, held_out, score, predicted) per row of ``docs``, learnt from the labels that are not held out.

    Only the text makes the score. Null and empty texts score as a text without telling words; long ones are read whole.
    A score equal to ``threshold`` is predicted 1. Repeated rows are scored alike; an empty table gives an empty result.
    """
    model = train_model(docs, labels.where(~held_out(key)), key, text, **training)
    small_batches(docs.sparkSession)
    scored = docs.select(F.col(key).alias(key), held_out(key).alias("held_out"), model.score(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
