"""Natural-key lookups, existence tests and the uniqueness guard behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barvault.operators.joins import join_unique


def ambiguous_keys(dimension: DataFrame, key: str) -> DataFrame:
    """Natural keys that more than one row of the dimension carries."""
    return (
        dimension.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .where("rows > 1")
    )


def find_id(rows: DataFrame, natural: Column, dimension: DataFrame, key: str, out: str) -> DataFrame:
    """Add ``out``, the ID whose ``key`` equals ``natural``; no match gives NULL.

    Using a key that the dimension holds more than once makes the query fail, like a scalar subquery would.
    """
    ids = (
        dimension.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.min("ID").alias("_id"), F.count(F.lit(1)).alias("_hits"))
    )
    found = F.when(
        F.col("_hits") > 1,
        F.raise_error(F.concat(F.lit(f"more than one row for {key} = "), F.col("_key"))).cast("int"),
    ).otherwise(F.col("_id"))
    return join_unique(rows.withColumn("_key", natural), ids, ["_key"]).withColumn(out, found).drop("_key", "_id", "_hits")


def flag_known(worklist: DataFrame, column: str, catalogue: DataFrame, key: str, out: str) -> DataFrame:
    """Add a boolean: does ``key`` of the catalogue hold this value?"""
    known = catalogue.select(F.col(key).alias(column)).where(F.col(column).isNotNull()).distinct()
    hits = join_unique(worklist, known.withColumn("_hit", F.lit(True)), [column])
    return hits.withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_hit")


def only_known(worklist: DataFrame, column: str, catalogue: DataFrame, key: str) -> DataFrame:
    """Rows whose value the catalogue holds (semi join)."""
    return worklist.join(catalogue.select(F.col(key).alias("_known")), F.col(column) == F.col("_known"), "left_semi")
