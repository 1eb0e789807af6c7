"""One key may hold a third of all rows: it must be spread, and nothing may be lost."""

import pytest
from pyspark.sql import functions as F

from barvault.operators.joins import join_unique
from barvault.operators.lookups import flag_known
from barvault.operators.segments import with_position

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture()
def no_broadcast(spark):
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def skewed(spark, size=60_000):
    """A third of the rows share key 0."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000).cast("bigint")
    return spark.range(size).select(F.col("id").alias("no"), key.alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_hot_key_is_split_when_joined_with_a_grouped_table(no_broadcast):
    rows = skewed(no_broadcast)
    sizes = rows.where("key < 2500").groupBy("key").agg(F.count("*").alias("size"))
    joined = join_unique(rows, sizes, ["key"])
    assert "skew=true" in final_plan(joined)
    got = joined.agg(F.count("*"), F.countDistinct("no"), F.sum((F.col("size").isNull()).cast("int"))).first()
    expected = rows.where("key >= 2500").count()
    assert tuple(got) == (60_000, 60_000, expected)


def test_hot_symbol_is_split_in_an_existence_test(no_broadcast):
    catalogue = no_broadcast.range(0, 5000, 2).select(F.col("id").alias("symbol"))
    flagged = flag_known(skewed(no_broadcast), "key", catalogue.unionByName(catalogue), "symbol", "known")
    assert "skew=true" in final_plan(flagged)
    assert flagged.where("known <> (key % 2 = 0)").count() == 0
    assert flagged.count() == 60_000


def test_positions_of_a_hot_key_come_from_many_segments(spark):
    rows = skewed(spark)
    placed = with_position(rows, ["key"], ["no"], F.floor(F.col("no") / 1000))
    hot = [r.position for r in placed.where("key = 0").orderBy("no").collect()]
    assert hot == list(range(len(hot)))
    plan = placed._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [row_number()" in line]
    assert windows and all("_segment" in line.split("specifiedwindowframe")[1] for line in windows)
