"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barvault.session import materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WHITE = " \t\n\x0b\x0c\r"

# monotonically_increasing_id() keeps the partition number above this bit.
_PARTITION_SHIFT = 33


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` does just that on texts without other letters, and much faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body (or a lambda in it) refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def indices(count: Column) -> Column:
    """The array 0 … count-1, empty where the count is not positive."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def row_key(*columns: str | Column) -> Column:
    """128 bits that stand for the values of a row: equal rows, and only these, share it.

    Columns are names, with dots in them or not, or expressions; ``values_of`` gives those of all columns of a table.
    """
    values = [F.col(quoted(c)) if isinstance(c, str) else c for c in columns]
    flags = [value.isNull() for value in values]
    return F.struct(
        F.xxhash64(*flags, *values).alias("a"), F.xxhash64(F.lit(1), *flags, *reversed(values)).alias("b")
    )


def quoted(name: str) -> str:
    """A column name that is taken as it is, dots included."""
    return "`" + name.replace("`", "``") + "`"


def values_of(df: DataFrame) -> list[Column]:
    """All columns in a form that can be hashed: maps, also inside of others, as JSON text."""
    return [
        F.to_json(F.struct(F.col(quoted(name)).alias("v"))) if "map<" in kind else F.col(quoted(name))
        for name, kind in df.dtypes
    ]


def uniform(seed: int, *columns: str) -> Column:
    """A number in (0, 1) that depends on the seed and the values only."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def numbered(df: DataFrame, order: Sequence[str | Column], out: str) -> DataFrame:
    """Number all rows 0, 1, 2, … in the given order, without a one-partition window.

    The sort is a range shuffle, so the rows stay spread; only one count per sorted partition is windowed. The sorted
    rows are written out first because a repeated range shuffle may cut the range elsewhere.
    """
    placed = materialise(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", _PARTITION_SHIFT)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    local = F.col("_place").bitwiseAND(F.lit((1 << _PARTITION_SHIFT) - 1))
    # offsets has one row per sorted partition, never more than the number of shuffle partitions: safe to broadcast
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .select(*df.columns, (F.col("_offset") + local).alias(out))
    )


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


@cache
def _package_archive(root: str) -> str:
    """A zip file of this package; Spark copies it from the driver to every executor."""
    return shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="barvault-"), "barvault"), "zip", root, "barvault")


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package where the driver found it by ``sys.path`` alone.

    Workers look into their working folder and PYTHONPATH only. A job submitted with the package needs nothing more.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    searched = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if not os.path.isdir(root) or root in map(os.path.abspath, searched):
        return
    if not any(name.endswith("barvault.zip") for name in spark.sparkContext.listFiles):
        spark.sparkContext.addPyFile(_package_archive(root))


def small_batches(spark: SparkSession, rows: int = 256, size: str = "8m") -> None:
    """Hand texts to Python in small batches, so that a worker's memory does not depend on their length."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
