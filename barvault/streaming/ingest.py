"""Forward updates as a stream: newly landed pages are appended to the archive as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barvault import schemas
from barvault.session import materialise
from barvault.sources import checked, landing
from barvault.sources.archive import CandleArchive


def page_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Landed pages as an unbounded table; a trigger takes at most ``max_files`` of them."""
    return (
        spark.readStream.schema(f"{schemas.PAGE}, {schemas.CORRUPT} string")
        .option("columnNameOfCorruptRecord", schemas.CORRUPT)
        .option("maxFilesPerTrigger", max_files)
        .json(path)
        .withColumn("source_file", F.col("_metadata.file_path"))
    )


def ingest_pages(
    archive: CandleArchive, pages: DataFrame, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append new candles of registered series, each once; what cannot be appended is kept beside the archive.

    Each series goes on from its own last candle, however far the series are apart: there is no common watermark and no
    state in the stream, the archive tells what it holds. A candle that is not after the last one of its series and not
    stored comes into ``archive.set_aside()`` as late, one of an unknown series as unregistered, a bad value into
    ``archive.rejects()``. A batch that is run again after a failure is known by its number and stored once.
    """

    def store(batch: DataFrame, epoch: int) -> None:
        # the batch is read several times below
        judged = materialise(checked.judged_pages(batch))
        target = CandleArchive(batch.sparkSession, archive.database)
        target.append(
            landing.stitch(checked.good(judged)),
            rejects=checked.rejected(judged),
            registered_only=True,
            source=f"{checkpoint}#{epoch}",
        )

    return (
        pages.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
