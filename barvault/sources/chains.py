"""Pages of one series put together again: a page begins, newest first, with the oldest candle of the page before it.

The pages of a series form chains: a page follows the one whose oldest candle it begins with. A chain without a hole
holds all pages of a download; where a page is missing, the chain ends and another one begins further back.
Only one row per page is looked at, some five thousandth of the candles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barvault.functions.clock import FULL_PAGE
from barvault.operators.joins import join_unique
from barvault.session import materialise

_SERIES = ("asset_class", "time_interval", "series_key")
_VALUES = ("open", "close", "high", "low", "volume")


def _micros(name: str) -> Column:
    """A time as a number that can be negated; only its order matters."""
    return F.unix_micros(F.col(name).cast("timestamp"))


def linked_pages(pages: DataFrame) -> DataFrame:
    """The pages of ``checked.page_table`` with ``head``, the first page of their chain, and ``place``, counted from 0 there.

    A page follows the page that ends, going back, where it begins; of several such pages the one that reaches furthest
    towards the present, then the least name. Pointers to the page before are doubled until all point to a head: a
    chain of n pages takes log2(n) joins, each written out, so nothing is collected and lineage stays short.
    """
    pages = materialise(pages)
    # a page of one candle ends where it begins, so nothing can follow it but what follows the page before it
    ends = (
        pages.where("newest > oldest")
        .groupBy(*_SERIES, F.col("oldest").alias("_start"))
        .agg(F.min(F.struct((-_micros("newest")).alias("late"), "page")).alias("_before"))
        .select(*_SERIES, F.col("_start").alias("newest"), F.col("_before.page").alias("_before"))
    )
    steps = join_unique(pages, ends, [*_SERIES, "newest"]).select(
        *_SERIES, "page", F.coalesce("_before", "page").alias("head"), F.col("_before").isNotNull().cast("bigint").alias("place")
    )
    while True:
        steps = materialise(steps)
        onward = steps.where("head <> page").select(
            *_SERIES, F.col("page").alias("head"), F.col("head").alias("_next"), F.col("place").alias("_more")
        )
        if steps.join(onward, [*_SERIES, "head"], "left_semi").isEmpty():
            return join_unique(pages, steps, [*_SERIES, "page"])
        steps = join_unique(steps, onward, [*_SERIES, "head"]).select(
            *_SERIES,
            "page",
            F.coalesce("_next", "head").alias("head"),
            (F.col("place") + F.coalesce("_more", F.lit(0))).alias("place"),
        )


def stitched(candles: DataFrame) -> DataFrame:
    """Each candle of a series once, out of candles that carry the ``page`` they come from with its ``newest`` and ``oldest``.

    Of several copies that of the newest page is kept: the page with the latest candle, then the one that reaches
    furthest back, then the least name; of copies in one page the least values. The choice depends on the rows alone, never
    on their order.
    """
    first = F.struct((-_micros("newest")).alias("newest"), _micros("oldest").alias("oldest"), "page", *_VALUES)
    best = candles.groupBy(*_SERIES, "datetime").agg(F.min(first).alias("_best"))
    return best.select(*_SERIES, "datetime", *[F.col(f"_best.{c}").alias(c) for c in _VALUES])


def chain_report(pages: DataFrame, earliest: DataFrame | None = None, full_page: int = FULL_PAGE) -> DataFrame:
    """(series, newest, oldest, pages, candles, status, gap_from, gap_to) per chain of the pages of ``checked.page_table``.

    ``candles`` counts those shared by neighbours once. ``status`` is ``gap`` if an older chain of the series begins before
    all chains so far reach back to: the candles between ``gap_from`` and ``gap_to`` were never landed; ``overlap`` if it
    begins within them; for the last chain ``unfinished`` if its last page is a full one, so that more was to come, unless
    it reaches the first point of the series in ``earliest`` (series, datetime); else ``complete``.
    """
    chains = (
        linked_pages(pages)
        .groupBy(*_SERIES, "head")
        .agg(
            F.max("newest").alias("newest"),
            F.min("oldest").alias("oldest"),
            F.count(F.lit(1)).alias("pages"),
            (F.sum("candles") - F.count_if(F.col("place") > 0)).alias("candles"),
            F.max_by("candles", "place").alias("_last"),
        )
    )
    # one row per chain is windowed: the holes in the pages of a series, not its candles
    back = Window.partitionBy(*_SERIES).orderBy(F.desc("newest"), F.desc("oldest"), "head")
    chains = chains.withColumns({"_next": F.lead("newest").over(back), "_reach": F.min("oldest").over(back)})
    if earliest is None:
        finished = F.lit(False)
    else:
        points = earliest.groupBy(*_SERIES).agg(F.min("datetime").alias("_point"))
        chains = join_unique(chains, points, _SERIES)
        finished = F.coalesce(F.col("_reach") <= F.col("_point"), F.lit(False))
    gap = F.col("_next") < F.col("_reach")
    return chains.select(
        *_SERIES,
        "newest",
        "oldest",
        "pages",
        "candles",
        F.when(gap, "gap")
        .when(F.col("_next").isNotNull(), "overlap")
        .when((F.col("_last") >= full_page) & ~finished, "unfinished")
        .otherwise("complete")
        .alias("status"),
        F.when(gap, F.col("_reach")).alias("gap_from"),
        F.when(gap, F.col("_next")).alias("gap_to"),
    )
