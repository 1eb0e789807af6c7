"""Commits of tables that are written in batches: a numbered manifest that decides which rows count.

Every row carries the name of the batch it was written in. A batch counts from the moment its record is put into the
manifest under the next free number, in one step that fails if another writer was first. So a writer that is lost leaves
nothing that a reader sees, and of two writers that start from one version only one gets the next number.

Records also delete: a tombstone names a candle or a series and hides the rows of earlier batches. A record that
replaces partitions hides what earlier batches hold there.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence
from functools import cached_property
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Commit(NamedTuple):
    """One record of the manifest; ``facts`` is what the writer put into it."""

    version: int
    batch: str
    facts: dict


class Manifest:
    """The commits below one folder, on any file system of the cluster.

    A record is written under a name of its own and then renamed to its number without overwriting. That step is atomic
    where the file system's rename is, as on HDFS.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path().getFileSystem(self._conf)
        self._read: dict[int, Commit] = {}

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path(os.path.join(self.folder, *parts))

    @staticmethod
    def _name(version: int) -> str:
        return f"{version:012d}.json"

    def versions(self) -> list[int]:
        """Committed numbers in order: a listing of names, no record is read."""
        if not self._fs.exists(self._path()):
            return []
        names = (status.getPath().getName() for status in self._fs.listStatus(self._path()))
        return sorted(int(name.removesuffix(".json")) for name in names if name[0].isdigit())

    def commits(self) -> list[Commit]:
        """All commits, oldest first. A record never changes, so each is read once."""
        versions = self.versions()
        for version in versions:
            if version not in self._read:
                stream = self._fs.open(self._path(self._name(version)))
                try:
                    text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
                record = json.loads(text)
                self._read[version] = Commit(version, record.pop("batch"), record)
        return [self._read[v] for v in versions]

    def commit(self, version: int, batch: str, **facts) -> bool:
        """Make a batch count as ``version``; false if that number is taken already."""
        self._fs.mkdirs(self._path())
        draft, target = self._path(f"_{batch}-{uuid.uuid4().hex}.draft"), self._path(self._name(version))
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps({"batch": batch, **facts}).encode()))
        finally:
            stream.close()
        draft, target = self._fs.makeQualified(draft), self._fs.makeQualified(target)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf)
        no_overwrite = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, target, no_overwrite)
        except Py4JJavaError as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True


class Snapshot:
    """What the first ``version`` commits say: which batches count, and what they have deleted or replaced since."""

    def __init__(self, spark: SparkSession, commits: Sequence[Commit], keys: Sequence[str], partition: Sequence[str]):
        self.spark, self.keys, self.partition = spark, list(keys), list(partition)
        self.commits = list(commits)
        self.version = self.commits[-1].version if self.commits else 0
        self.batches = {c.batch: c.version for c in self.commits}
        folded = max((c.facts.get("folded", 0) for c in self.commits), default=0)
        listed = lambda name: [(*row, c.version) for c in self.commits if c.version > folded for row in c.facts.get(name, [])]
        self.deleted, self.dropped = listed("deleted"), listed("dropped")
        self.replaced = {tuple(row): c.version for c in self.commits for row in c.facts.get("replaced", [])}
        #: the last commit that dropped a series hides its log and registration too, folded or not
        self.ever_dropped = [(*row, c.version) for c in self.commits for row in c.facts.get("dropped", [])]

    def since(self, version: int) -> list[str]:
        return [batch for batch, v in self.batches.items() if v >= version]

    @cached_property
    def _versions(self) -> DataFrame:
        """(batch, _version): one row per commit, safe to broadcast."""
        rows = list(self.batches.items()) or [("", 0)]
        return F.broadcast(self.spark.createDataFrame(rows, "batch string, _version bigint"))

    def _tombstones(self, rows: list[tuple], id_: str | None = None) -> DataFrame:
        columns = [f"{k} string" for k in self.keys] + ([f"{id_} bigint"] if id_ else []) + ["_since bigint"]
        last = self.spark.createDataFrame(rows, ", ".join(columns))
        return last.groupBy(*self.keys, *([id_] if id_ else [])).agg(F.max("_since").alias("_since"))

    def with_version(self, rows: DataFrame) -> DataFrame:
        """Rows of batches that count, with the number of their commit."""
        return rows.where(F.col("batch").isin(list(self.batches))).join(self._versions, "batch")

    @staticmethod
    def _met(rows: DataFrame, tombstones: DataFrame, on: Sequence[str], how: str) -> DataFrame:
        """``rows`` with or without those that a later tombstone names."""
        tomb = tombstones.select(*[F.col(k).alias(f"_t_{k}") for k in on], "_since")
        same = [F.col(k) == F.col(f"_t_{k}") for k in on]
        return rows.join(tomb, [*same, F.col("_version") < F.col("_since")], how)

    def named(self, rows: DataFrame) -> DataFrame:
        """Rows about series (registrations, log) that count: of committed batches, and not dropped since."""
        alive = self.with_version(rows)
        return self._met(alive, self._tombstones(self.ever_dropped), self.keys, "left_anti") if self.ever_dropped else alive

    def _current(self, rows: DataFrame) -> DataFrame:
        """Rows of a partitioned table in committed batches that nothing has replaced; decided by partition columns."""
        alive = rows.where(F.col("batch").isin(list(self.batches)))
        for place, version in self.replaced.items():
            here = F.lit(True)
            for column, value in zip(self.partition, place, strict=True):
                here = here & (F.col(column).cast("string") == value)
            alive = alive.where(~here | F.col("batch").isin(self.since(version)))
        return alive

    def visible(self, rows: DataFrame, id_: str = "ID") -> DataFrame:
        """The rows of a partitioned table that count.

        Without tombstones nothing is joined. The number of these is that of the deletes since the last folding.
        """
        alive = self._current(rows)
        if not self.deleted and not self.dropped:
            return alive
        alive = alive.join(self._versions, "batch")
        if self.dropped:
            alive = self._met(alive, self._tombstones(self.dropped), self.keys, "left_anti")
        if self.deleted:
            alive = self._met(alive, self._tombstones(self.deleted, id_), [*self.keys, id_], "left_anti")
        return alive.drop("_version")

    def hidden(self, rows: DataFrame, id_: str = "ID") -> DataFrame:
        """The rows that only tombstones keep from counting."""
        alive = self._current(rows).join(self._versions, "batch")
        none = alive.where("false")
        by_series = self._met(alive, self._tombstones(self.dropped), self.keys, "left_semi") if self.dropped else none
        by_id = self._met(alive, self._tombstones(self.deleted, id_), [*self.keys, id_], "left_semi") if self.deleted else none
        return by_series.union(by_id).drop("_version")

    def condition(self, id_: str = "ID") -> str:
        """``visible`` as an SQL condition."""
        quoted = lambda v: "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
        within = lambda batches: f"batch IN ({', '.join(map(quoted, batches))})" if batches else "false"
        same = lambda names, values: " AND ".join(f"CAST({n} AS STRING) = {quoted(v)}" for n, v in zip(names, values, strict=True))
        before = lambda version: [b for b, v in self.batches.items() if v < version]
        parts = [within(list(self.batches))]
        for place, version in self.replaced.items():
            parts.append(f"NOT ({same(self.partition, place)} AND NOT {within(self.since(version))})")
        for *series, version in self.dropped:
            parts.append(f"NOT ({same(self.keys, series)} AND {within(before(version))})")
        for *row, version in self.deleted:
            parts.append(f"NOT ({same([*self.keys, id_], row)} AND {within(before(version))})")
        return " AND ".join(parts)
