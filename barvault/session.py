"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "barvault", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; ``conf`` wins over the defaults.

    The number of shuffle partitions is left to the caller (cores in local mode, a multiple of the executor cores
    on a cluster): adaptive execution merges small ones and splits skewed ones.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        # no Python call site is recorded for every column expression, which halves the time to build a plan
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    } | conf
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="barvault-"))
    return spark.conf.get("spark.checkpoint.dir")


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new, not yet existing folder name below the shared folder."""
    return os.path.join(shared_folder(spark), f"{purpose}-{uuid.uuid4().hex}")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: write it as a table in the shared folder and go on from there.

    What follows always sees the same rows, also after executors are lost. Unlike ``checkpoint()``, which runs its
    plan twice, the plan runs once, and the table keeps column pruning and a known size for join planning.
    """
    path = fresh_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
