"""The candle archive: one partitioned table for all series, its registry, its log, and the manifest that rules them.

``candles`` is partitioned by batch, asset class, interval and month (``period``), and range-sorted by series and time: a
date predicate prunes partitions and a series predicate skips row groups. ``series_log`` gains one small row per series
and append; it tells the last ID and latest time of a series without reading the candles. Next to the tables, folders
hold one summary row per series and month (``months``), candles that were set aside, and rejected values.

Every write is a batch, and a batch counts once its commit is in the manifest (see ``commits``): a lost writer leaves
nothing to be seen, readers see whole appends, and of two writers at once the second one starts again from what the first
one stored, so no ID is given twice. Deletes are tombstones in the manifest; ``compact`` folds them into the files.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barvault import schemas
from barvault.errors import ConcurrentWrite, SeriesNotFound
from barvault.functions import clock
from barvault.operators import segments
from barvault.operators.joins import join_unique
from barvault.operators.series import check_interval
from barvault.session import materialise
from barvault.sources import catalog
from barvault.sources.commits import Manifest, Snapshot

SERIES = ("asset_class", "time_interval", "series_key")
COLUMNS = (*SERIES, "ID", "datetime", "open", "close", "high", "low", "volume")
PARTITION = ("asset_class", "time_interval", "period")
ATTEMPTS = 20  # starts of a write that always finds another writer ahead
LATE, UNREGISTERED = "late", "unregistered"

_LAST = ("open", "close", "high", "low", "volume")  # kept of the last candle of a month
_VALUES = tuple(c for c in COLUMNS if c != "ID")
_SET_ASIDE = f"{schemas.CANDLES.replace('ID bigint, ', '')}, reason string"
_REJECTS = "source_file string, page string, value_pos int, time_interval string, series_key string, field string, value string, problem string"
_MONTHS = (
    f"{schemas.REGISTRY}, period date, rows bigint, first_id bigint, last_id bigint, earliest timestamp_ntz, "
    f"latest timestamp_ntz, high {schemas.PRICE}, low {schemas.PRICE}, volume bigint, last_open {schemas.PRICE}, "
    f"last_close {schemas.PRICE}, last_high {schemas.PRICE}, last_low {schemas.PRICE}, last_volume bigint, whole boolean"
)


def period_of(time):
    return clock.month_of(time).cast("date")


class CandleArchive:
    """Reads and writes of the archive tables of one database (see ``catalog.build_warehouse``)."""

    def __init__(self, spark: SparkSession, database: str):
        self.spark = spark
        self.database = database
        self._manifest: Manifest | None = None

    @property
    def folder(self) -> str:
        return self.spark.catalog.getDatabase(self.database).locationUri

    @property
    def manifest(self) -> Manifest:
        folder = os.path.join(self.folder, "_commits")
        if self._manifest is None or self._manifest.folder != folder:
            self._manifest = Manifest(self.spark, folder)
        return self._manifest

    def _table(self, name: str) -> str:
        return f"{self.database}.{name}"

    def _stored(self, name: str) -> DataFrame:
        # another session, such as the one a stream runs in, may have written since this one last looked
        self.spark.catalog.refreshTable(self._table(name))
        return self.spark.table(self._table(name))

    def _side(self, name: str, columns: str, base: Snapshot, fact: str) -> DataFrame:
        """Rows of a folder beside the tables, one subfolder per batch; only committed ones are opened."""
        root = os.path.join(self.folder, f"_{name}")
        paths = [os.path.join(root, f"batch={c.batch}") for c in base.commits if c.facts.get(fact)]
        schema = f"{columns}, batch string"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", root).parquet(*paths)

    def _put_aside(self, name: str, rows: DataFrame, batch: str) -> None:
        rows.write.mode("overwrite").parquet(os.path.join(self.folder, f"_{name}", f"batch={batch}"))

    # --- reading ---------------------------------------------------------------------------------------------
    def snapshot(self, version: int | None = None) -> Snapshot:
        """What is stored now, or what was stored as of a version."""
        commits = [c for c in self.manifest.commits() if version is None or c.version <= version]
        return Snapshot(self.spark, commits, SERIES, PARTITION)

    def _candles(self, base: Snapshot | None = None) -> DataFrame:
        return (base or self.snapshot()).visible(self._stored("candles"))

    def candles(self, version: int | None = None) -> DataFrame:
        return self._candles(self.snapshot(version)).select(*COLUMNS)

    def registry(self, base: Snapshot | None = None) -> DataFrame:
        return (base or self.snapshot()).named(self._stored("series_registry")).select(*SERIES)

    def scan(
        self,
        asset_class: str,
        time_interval: str,
        series_key: str | None = None,
        start: datetime | None = None,
        end: datetime | None = None,
        version: int | None = None,
    ) -> DataFrame:
        """Candles of one class and interval; dates also become partition filters."""
        rows = self._stored("candles").where(
            (F.col("asset_class") == asset_class) & (F.col("time_interval") == check_interval(time_interval))
        )
        moment = lambda d: F.lit(d).cast("timestamp_ntz")
        if series_key is not None:
            rows = rows.where(F.col("series_key") == series_key)
        if start is not None:
            rows = rows.where((F.col("datetime") >= moment(start)) & (F.col("period") >= period_of(moment(start))))
        if end is not None:
            rows = rows.where((F.col("datetime") <= moment(end)) & (F.col("period") <= period_of(moment(end))))
        return self.snapshot(version).visible(rows).select(*COLUMNS)

    def series(self, asset_class: str, time_interval: str, series_key: str, **dates) -> DataFrame:
        """One registered series, or an error."""
        if not self.exists(asset_class, time_interval, series_key):
            raise SeriesNotFound(f"{asset_class} {time_interval} {series_key}")
        return self.scan(asset_class, time_interval, series_key, **dates)

    def exists(self, asset_class: str, time_interval: str, series_key: str) -> bool:
        return not self.registry().where(self._is(asset_class, time_interval, series_key)).isEmpty()

    def by_id(self, asset_class: str, time_interval: str, series_key: str, first: int, last: int | None = None) -> DataFrame:
        """Candles of one series with IDs from ``first`` to ``last`` (or that one): only their months are read."""
        last = first if last is None else last
        base = self.snapshot()
        held = self.months(base).where(self._is(asset_class, time_interval, series_key))
        met = held.where((F.col("first_id") <= last) & (F.col("last_id") >= first)).agg(F.min("period"), F.max("period")).first()
        rows = self._candles(base).where(self._is(asset_class, time_interval, series_key))
        if met[0] is None:
            return rows.where("false").select(*COLUMNS)
        # IDs rise with time, so the months of a range of IDs follow one another
        rows = rows.where(F.col("period").between(F.lit(met[0]), F.lit(met[1])))
        return rows.where(F.col("ID").between(first, last)).select(*COLUMNS)

    def months(self, base: Snapshot | None = None) -> DataFrame:
        """One summary row per series and month that holds candles, without reading these."""
        base = base or self.snapshot()
        rows = base.named(self._side("months", _MONTHS, base, "months"))
        place = [*SERIES, "period"]
        # a row that was counted anew after a delete takes the place of all earlier ones
        anew = rows.groupBy(*place).agg(F.max(F.when(F.col("whole"), F.col("_version"))).alias("_anew"))
        rows = join_unique(rows, anew, place).where(F.col("_anew").isNull() | (F.col("_version") >= F.col("_anew")))
        return self._merged(rows, place).where("rows > 0")

    @staticmethod
    def _merged(rows: DataFrame, keys) -> DataFrame:
        at_last = lambda name: F.max_by(name, "last_id").alias(name)
        return rows.groupBy(*keys).agg(
            F.sum("rows").alias("rows"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"),
            F.min("earliest").alias("earliest"), at_last("latest"), F.max("high").alias("high"),
            F.min("low").alias("low"), F.max("volume").alias("volume"), *[at_last(f"last_{c}") for c in _LAST],
        )

    def totals(self) -> DataFrame:
        """One row per series that holds candles, from the summaries of its months: rows, first and last ID, earliest and
        latest time, extremes, values of the last candle. ``summaries.kept_*`` turn them into the summaries of series."""
        return self._merged(self.months(), SERIES)

    def progress(self, base: Snapshot | None = None) -> DataFrame:
        """Last ID and latest time of every series that has candles."""
        base = base or self.snapshot()
        log = self._whole_log(base)
        newest = lambda name: F.max_by(name, "_version").alias(name)
        # a row counts as an update of the whole series, also one that says that nothing is left
        rows = log.withColumn("_last", F.struct("last_id", "latest")).groupBy(*SERIES).agg(newest("_last"))
        return rows.select(*SERIES, "_last.last_id", "_last.latest").where("last_id IS NOT NULL")

    def _whole_log(self, base: Snapshot) -> DataFrame:
        """The log with the number of each row's commit; rows of a batch that were lost are made again from its candles."""
        log = base.named(self._stored("series_log"))
        logged = {c.batch: c.facts["series"] for c in base.commits if c.facts.get("series") and c.facts["kind"] == "append"}
        if not logged:
            return log
        written = self._stored("series_log").where(F.col("batch").isin(list(logged))).groupBy("batch").count()
        held = {r["batch"]: r["count"] for r in written.collect()}  # one row per commit
        lost = [batch for batch, count in logged.items() if held.get(batch, 0) != count]
        if not lost:
            return log
        again = self._log_of(self._stored("candles").where(F.col("batch").isin(lost)), "batch")
        return log.where(~F.col("batch").isin(lost)).unionByName(base.named(again))

    @staticmethod
    def _log_of(candles: DataFrame, *more: str) -> DataFrame:
        return candles.groupBy(*SERIES, *more).agg(F.max("ID").alias("last_id"), F.max_by("datetime", "ID").alias("latest"))

    def set_aside(self, base: Snapshot | None = None) -> DataFrame:
        """Landed candles that could not be stored, with the reason and how often each was landed: ``late`` ones are new
        but not after the last candle of their series, whose IDs have gone past them; the others are of series that are not
        registered."""
        base = base or self.snapshot()
        rows = self._side("set_aside", _SET_ASIDE, base, "set_aside")
        return rows.groupBy(*_VALUES, "reason").agg(F.count(F.lit(1)).alias("times"))

    def rejects(self, base: Snapshot | None = None) -> DataFrame:
        """Rejected values of all loads, each place of a page once, however often the page was loaded."""
        base = base or self.snapshot()
        return self._side("rejects", _REJECTS, base, "rejects").drop("batch").distinct()

    @staticmethod
    def _is(asset_class: str, time_interval: str, series_key: str) -> Column:
        return (
            (F.col("asset_class") == asset_class)
            & (F.col("time_interval") == time_interval)
            & (F.col("series_key") == series_key)
        )

    # --- writing ---------------------------------------------------------------------------------------------
    def _commit(self, base: Snapshot, batch: str, kind: str, **facts) -> bool:
        if not self.manifest.commit(base.version + 1, batch, kind=kind, **{k: v for k, v in facts.items() if v}):
            return False
        catalog.refresh_candle_view(self.spark, self.database, self.snapshot().condition())
        return True

    def _insert(self, name: str, rows: DataFrame, batch: str, by: Sequence[str] = ()) -> None:
        """Write the rows of a batch into its own folder of a table, so that writers at the same time do not meet.

        Its partitions are made known before the commit; until then they are there but do not count.
        """
        path = os.path.join(self.folder, name, f"batch={batch}")
        columns = [c for c in self._stored(name).columns if c not in (*by, "batch")]
        writer = rows.select(*by, *columns).write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        places = rows.select(*[F.col(c).cast("string") for c in by]).distinct().collect() if by else [()]  # one row per partition
        specs = [
            ", ".join([f"batch = '{batch}'", *[f"{c} = '{v}'" for c, v in zip(by, place, strict=True)]]) for place in places
        ]
        parts = " ".join(f"PARTITION ({spec})" for spec in specs)
        self.spark.sql(f"ALTER TABLE {self._table(name)} ADD IF NOT EXISTS {parts}")

    @staticmethod
    def _tried(write) -> None:
        """Start a write until it is committed: one that finds another writer ahead looks anew at what is stored."""
        for _ in range(ATTEMPTS):
            if write(uuid.uuid4().hex):
                return
        raise ConcurrentWrite(f"{ATTEMPTS} other writers were first")

    def register(self, series: DataFrame) -> None:
        """Add series that are not registered yet; repeating it changes nothing. A new series may stay empty."""
        asked = materialise(series.select(*SERIES).distinct())

        def write(batch: str) -> bool:
            base = self.snapshot()
            new = asked.join(self.registry(base), list(SERIES), "left_anti")
            if new.isEmpty():
                return True
            self._insert("series_registry", new, batch)
            return self._commit(base, batch, "register")

        self._tried(write)

    def unseen(self, incoming: DataFrame, base: Snapshot | None = None) -> DataFrame:
        """Incoming candles whose (series, time) is not stored yet, each once, of several copies that of least values.

        Only the partitions that the batch itself touches are read: a join with the list of these, one row per class,
        interval and month, prunes the others when the query runs.
        """
        key = [*SERIES, "datetime"]
        others = [c for c in incoming.columns if c not in key]
        least = incoming.groupBy(*key).agg(F.min(F.struct(*others)).alias("_least")) if others else incoming.distinct()
        once = materialise(least.select(*key, "_least.*").select(*incoming.columns) if others else least)
        touched = materialise(once.select("asset_class", "time_interval", period_of(F.col("datetime")).alias("period")).distinct())
        first = touched.agg(F.min("period")).first()[0]
        if first is None:
            return once
        asked = F.broadcast(touched.where(F.col("period") >= F.lit(first)))
        stored = self._candles(base).join(asked, list(PARTITION), "left_semi")
        return once.join(stored.select(*key), key, "left_anti")

    def append(
        self,
        incoming: DataFrame,
        rejects: DataFrame | None = None,
        registered_only: bool = False,
        source: str | None = None,
    ) -> None:
        """Store new candles of any number of series, oldest first, with IDs going on from the last one.

        ``incoming`` has the archive columns without ``ID``. Candles already stored are left out, so an append that
        is repeated after a failure stores nothing twice. What cannot be stored is not lost: candles before the last
        one of their series, and with ``registered_only`` those of unknown series, come into ``set_aside``. ``rejects`` are
        stored along. A ``source`` that was committed before is not taken again.
        """
        rows = materialise(incoming.select(*_VALUES))
        refused = None if rejects is None else materialise(rejects)
        held_back = 0 if refused is None else refused.count()

        def write(batch: str) -> bool:
            base = self.snapshot()
            if source is not None and any(c.facts.get("source") == source for c in base.commits):
                return True
            known = self.progress(base)
            fresh = join_unique(self.unseen(rows, base), known, SERIES)
            reason = F.when(F.col("datetime") <= F.col("latest"), LATE)
            if registered_only:
                named = self.registry(base).withColumn("_named", F.lit(True))
                fresh = join_unique(fresh, named, SERIES)
                reason = F.when(F.col("_named").isNull(), UNREGISTERED).otherwise(reason)
            fresh = materialise(fresh.select(*_VALUES, "last_id", reason.alias("reason")))
            new, aside = fresh.agg(F.count_if(F.col("reason").isNull()), F.count("reason")).first()
            if not new and not aside and not held_back and source is None:
                return True
            logged = 0
            if new:
                first = F.coalesce("last_id", F.lit(-1)) + 1
                numbered = segments.with_position(
                    fresh.where("reason IS NULL"), SERIES, ["datetime"], F.col("datetime").cast("date"), "ID", first=first
                )
                logged = self._write(materialise(numbered.select(*COLUMNS)), batch)
            if aside:
                self._put_aside("set_aside", fresh.where("reason IS NOT NULL").select(*_VALUES, "reason"), batch)
            if held_back:
                columns = [c.split()[0] for c in _REJECTS.split(", ")]
                self._put_aside("rejects", refused.select(*columns), batch)
            return self._commit(
                base, batch, "append", rows=new, series=logged, months=bool(new), set_aside=aside, rejects=held_back, source=source
            )

        self._tried(write)

    def _write(self, numbered: DataFrame, batch: str) -> int:
        """Candles of a batch, their log and the summaries of their months; returns the number of series."""
        self._write_candles(numbered, batch)
        log = materialise(self._log_of(numbered))
        self._insert("series_log", log, batch)
        self._put_aside("months", self._months_of(numbered, F.lit(False)), batch)
        return log.count()

    def _write_candles(self, candles: DataFrame, batch: str) -> None:
        layout = [*PARTITION, "series_key", "datetime"]
        rows = candles.withColumn("period", period_of(F.col("datetime")))
        # a range shuffle keeps a busy month or series spread over tasks and gives each file a narrow key range
        self._insert("candles", rows.repartitionByRange(*layout).sortWithinPartitions(*layout), batch, PARTITION)

    @staticmethod
    def _months_of(candles: DataFrame, whole: Column) -> DataFrame:
        rows = candles.withColumn("period", period_of(F.col("datetime")))
        return rows.groupBy(*SERIES, "period").agg(
            F.count(F.lit(1)).alias("rows"), F.min("ID").alias("first_id"), F.max("ID").alias("last_id"),
            F.min("datetime").alias("earliest"), F.max_by("datetime", "ID").alias("latest"), F.max("high").alias("high"),
            F.min("low").alias("low"), F.max("volume").alias("volume"), *[F.max_by(c, "ID").alias(f"last_{c}") for c in _LAST],
        ).withColumn("whole", whole)

    def drop_series(self, asset_class: str, time_interval: str, series_key: str) -> None:
        """Forget a series: its candles, its registration and its log, by one tombstone. Unknown series are ignored."""
        is_it = self._is(asset_class, time_interval, series_key)

        def write(batch: str) -> bool:
            base = self.snapshot()
            if self.registry(base).where(is_it).isEmpty() and self.progress(base).where(is_it).isEmpty():
                return True
            return self._commit(base, batch, "drop", dropped=[[asset_class, time_interval, series_key]])

        self._tried(write)

    def delete_row(self, asset_class: str, time_interval: str, series_key: str, id_: int) -> None:
        """Delete one candle by ID, by one tombstone; the log follows, so a deleted last ID is given again. The summary of
        its month is counted anew; no candle is rewritten."""
        is_it = self._is(asset_class, time_interval, series_key)

        def write(batch: str) -> bool:
            base = self.snapshot()
            months = self.months(base).where(is_it & (F.col("first_id") <= id_) & (F.col("last_id") >= id_))
            month = months.select("period").first()
            if month is None:
                return True
            held = materialise(self._candles(base).where(is_it & (F.col("period") == F.lit(month.period))).select(*COLUMNS))
            if held.where(F.col("ID") == id_).isEmpty():
                return True
            left = held.where(F.col("ID") != id_)
            summary = self._months_of(left, F.lit(True))
            if left.isEmpty():
                place = [F.lit(v).alias(n) for n, v in zip(SERIES, (asset_class, time_interval, series_key), strict=True)]
                empty = self.spark.range(1).select(*place, F.lit(month.period).alias("period"), F.lit(0).cast("bigint").alias("rows"))
                summary = empty.unionByName(summary, allowMissingColumns=True).withColumn("whole", F.lit(True))
            self._put_aside("months", summary, batch)
            if self.progress(base).where(is_it).first().last_id == id_:
                self._insert("series_log", self._log_before(base, is_it, id_), batch)
            return self._commit(
                base, batch, "delete", months=True, deleted=[[asset_class, time_interval, series_key, id_]]
            )

        self._tried(write)

    def _log_before(self, base: Snapshot, is_it: Column, id_: int) -> DataFrame:
        """The log row of a series that loses its last candle; an empty series gets a row without an ID. Of the month
        before only its last candles are read."""
        logged = self.progress(base).where(is_it).select(*SERIES)
        last = self.months(base).where(is_it & (F.col("first_id") < id_)).agg(F.max("period")).first()[0]
        held = self._candles(base).where(is_it & (F.col("ID") < id_))
        held = held.where(F.col("period") >= F.lit(last)) if last is not None else held.where("false")
        now = self._log_of(held)
        return logged.join(now, list(SERIES), "left").select(*SERIES, "last_id", "latest")

    def compact(self) -> None:
        """Fold all tombstones into the files: the partitions that hold deleted candles are written anew, as a batch that
        takes their place with its commit. Readers of earlier versions keep their files."""

        def write(batch: str) -> bool:
            base = self.snapshot()
            if not base.deleted and not base.dropped:
                return True
            touched = base.hidden(self._stored("candles")).select(*PARTITION).distinct().collect()  # one row per partition
            if touched:
                here = self.spark.createDataFrame([tuple(r) for r in touched], "asset_class string, time_interval string, period date")
                held = self._candles(base).join(F.broadcast(here), list(PARTITION), "left_semi")
                self._write_candles(materialise(held.select(*COLUMNS)), batch)
            places = [[r.asset_class, r.time_interval, str(r.period)] for r in touched]
            return self._commit(base, batch, "compact", replaced=places, folded=base.version)

        self._tried(write)
