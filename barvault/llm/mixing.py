"""Mixing sources to target weights by whole documents, with a subset-sum fit of each source's budget."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barvault.llm.support import numbered, row_key, ship_package, uniform
from barvault.operators.joins import join_unique
from barvault.session import materialise

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
SEED = 17
SPAN = 65_536
SLICES = 1024
WORDS = r"[^\x20\x09-\x0D]+"


def text_size(text: Column) -> Column:
    """Number of words of a text, 0 for a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Add ``target`` to a table (source, source_size) with one row per source.

    Sources in code point order, null last, take the weights in turn and share the total size by them. A target stops
    at ``most`` times the source's size; what it leaves is shared by the rest, until none is above. That fixed point
    is the least of cap and rate x weight, and the rate only rises from round to round, so each round is one
    aggregate; sources are numbered by a distributed sort.
    """
    ranked = numbered(sources, [F.asc_nulls_last("source")], "nth")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    ranked = materialise(ranked.withColumn("weight", turn).withColumn("cap", F.col("source_size") * F.lit(float(most))))
    rate, capped = 0.0, -1
    while True:
        stopped = F.col("cap") <= F.lit(rate) * F.col("weight")
        found = ranked.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(stopped, F.col("cap")).otherwise(0.0)).alias("held"),
            F.sum(F.when(stopped, 0.0).otherwise(F.col("weight"))).alias("weight"),
            F.count_if(stopped).alias("n"),
        ).first()
        if found["n"] == capped or not found["weight"]:
            break
        capped, rate = found["n"], max(rate, (found["total"] - found["held"]) / found["weight"])
    return ranked.select(
        "source", "source_size", F.least(F.col("cap"), F.lit(rate) * F.col("weight")).cast("double").alias("target")
    )


def fit_budget(lengths: Sequence[int], counts: Sequence[int], budget: int, span: int = SPAN) -> list[int]:
    """How many documents of each length to take so that their sizes add up to ``budget`` or as near below as found.

    First an equal share of every length, then the longest that fit, until at most ``span`` words are left; these are
    filled by a bounded knapsack over the documents still there. Its table has one entry for each word left, so
    memory is bounded by ``span``, and a fit within it is the best one. Lengths are positive and distinct.
    """
    sizes, have = np.asarray(lengths, dtype=object), np.asarray(counts, dtype=object)
    whole = sum(s * c for s, c in zip(sizes, have, strict=True))
    if budget >= whole:
        return [int(c) for c in have]
    taken = np.array([c * budget // whole for c in have], dtype=object)
    left = int(budget - sum(s * t for s, t in zip(sizes, taken, strict=True)))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    for i in order:
        if left <= span:
            break
        more = min(have[i] - taken[i], left // sizes[i], -(-(left - span) // sizes[i]))
        taken[i] += more
        left -= int(more * sizes[i])
    left = min(left, span)
    # reached[s]: the length whose document completed the sum s, -1 while s is not reached
    reached = np.full(left + 1, -1, dtype=np.int64)
    reached[0] = len(sizes)
    for i in order:
        size, spare = int(sizes[i]), int(have[i] - taken[i])
        if size > left or reached[left] >= 0:
            continue
        # an unreached sum may add up to ``spare`` documents of this size to a sum that was reached without it
        steps = np.where(reached >= 0, 0, spare + 1)
        rows = -(-(left + 1) // size)
        grid = np.full(rows * size, spare + 1, dtype=np.int64)
        grid[: left + 1] = steps
        grid = grid.reshape(rows, size)
        above = np.arange(rows)[:, None]
        nearest = np.maximum.accumulate(np.where(grid == 0, above, -(spare + rows + 2)), axis=0)
        within = (above - nearest <= spare).ravel()[: left + 1]
        reached[within & (reached < 0)] = i
    at = int(np.flatnonzero(reached >= 0)[-1])
    while at:
        i = int(reached[at])
        taken[i] += 1
        at -= int(sizes[i])
    return [int(t) for t in taken]


def _fit_source(rows: pd.DataFrame, span: int) -> pd.DataFrame:
    rows = rows.sort_values("size")
    size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    copies = int(target // size) if size else 0
    fill = fit_budget(rows["size"].to_list(), rows["docs"].to_list(), round(target - copies * size), span)
    return rows.assign(copies=copies, more=fill)[["source", "size", "copies", "more"]]


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    most: int = MOST,
    seed: int = SEED,
    span: int = SPAN,
    identity: Sequence[str] = (),
) -> DataFrame:
    """(row_id, key, size, source, source_size, target, taken): how many words the mix takes of each row of ``docs``.

    Every document of a source is taken as often as its target holds the whole source; what remains is fitted by
    ``fit_budget`` on the counts of documents by exact length, one small table per source, since n distinct lengths
    need at least n * n / 2 words. Which documents of a length are taken once more is decided by a seeded hash of key
    and text: all rows are numbered by a distributed sort that also splits equal rows, so that a length, or one row
    repeated, with a third of all rows is not one task's. Equal rows are interchangeable: reruns agree. A null source
    is a source; null and empty texts have size 0 and give 0 words. An empty table gives an empty result. ``row_id``
    stands for the columns of ``identity``, or for key and text.
    """
    ship_package(docs.sparkSession)
    rows = materialise(
        docs.select(
            row_key(*(identity or (key, text))).alias("row_id"),
            F.col(key).alias("key"),
            F.col(source).cast("string").alias("source"),
            text_size(F.col(text)).alias("size"),
            uniform(seed, key, text).alias("chance"),
            F.monotonically_increasing_id().alias("place"),
        )
    )
    order = [F.asc_nulls_last("source"), "size", "chance", "key", "row_id", "place"]
    placed = materialise(numbered(rows, order, "nth").drop("place"))
    lengths = materialise(
        placed.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs"), F.min("nth").alias("start"))
    )
    sizes = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    targets = materialise(source_targets(sizes, weights, most))
    counted = join_unique(lengths.where("size > 0"), targets, ["source"])
    kinds = "source string, size bigint, copies bigint, more bigint"
    fits = counted.groupBy("source").applyInPandas(lambda rows: _fit_source(rows, span), kinds)
    plan = join_unique(lengths.drop("docs"), fits, ["source", "size"])
    plan = materialise(join_unique(plan, targets, ["source"]))
    chosen = join_unique(placed, plan, ["source", "size"])
    extra = (F.col("nth") - F.col("start") < F.col("more")).cast("bigint")
    taken = F.coalesce(F.col("size") * (F.col("copies") + extra), F.lit(0).cast("bigint"))
    return chosen.select("row_id", "key", "size", "source", "source_size", "target", taken.alias("taken"))
