"""Connected components of a graph of pairs, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barvault.operators.joins import join_unique
from barvault.session import materialise


def _towards_least(pairs: DataFrame) -> DataFrame:
    """One pass over pairs (u, v) with u > v: first every node's larger neighbours, then its smaller ones, are tied to
    the least node next to it. The number of pairs never grows, and the components stay as they are."""
    both = pairs.select(F.col("u").alias("x"), F.col("v").alias("y")).union(pairs.select("v", "u"))
    least = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
    large = (
        join_unique(both, least, ["x"], "inner").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    )
    large = materialise(large.distinct())
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = join_unique(large, least, ["u"], "inner").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return materialise(small.union(least).distinct())


def _is_star(pairs: DataFrame) -> bool:
    """Whether every node points to one node, which points to none."""
    targets = pairs.select(F.col("v").alias("u")).distinct()
    seen = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    return seen.where("n > 1").isEmpty() and targets.join(seen, "u", "left_semi").isEmpty()


def connected_components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of the pairs (u, v) that is not the least of its component.

    Each pass is written to the shared folder, so its lineage is one pass long and nothing is collected; minima are
    combined before the shuffle, and joins split hot nodes. The number of passes grows with the logarithm of the
    longest path. Self-pairs and repeated pairs do no harm; no pairs give no rows.
    """
    ends = pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = materialise(ends.distinct())
    while not _is_star(stars):
        stars = _towards_least(stars)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
