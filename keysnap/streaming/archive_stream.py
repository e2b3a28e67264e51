"""The log archive as a periodic job."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from keysnap.plans.archive import archive_once


def archive_stream(
    spark: SparkSession,
    sources: Sequence[str],
    archive: str,
    checkpoint: str,
    stats: str | None = None,
    days: int = 0,
    every: str = "10 minutes",
    retries: int | None = 3,
    once: bool = False,
    parallelism: int | None = None,
    fallback_roots: Sequence[str] = (),
) -> StreamingQuery:
    """Runs :func:`archive_once` every ``every``, counted from start to start.

    The stream only gives the beat. A file stream would not do, as it never gives a file again
    that has grown. A run cut short by an error of a job or of the file system is repeated at
    once, up to ``retries`` times (None: for ever). RUN_STATS rows are kept below ``stats``, one directory per run, so that a repeated
    batch replaces its row. ``fallback_roots`` are where logs that are gone are looked for. With ``once`` a single run is made.
    """

    def tick(_: DataFrame, batch: int) -> None:
        for tried in count():
            try:
                row = archive_once(
                    spark, sources, archive, days=days, run=batch, fallback_roots=fallback_roots,
                    parallelism=parallelism,
                )
                break
            except (OSError, Py4JJavaError, CapturedException):
                if tried == retries:
                    raise
        if stats:
            row.coalesce(1).write.mode("overwrite").parquet(f"{stats}/batch_{batch:09d}")

    beat = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    writer = beat.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": every}
    return writer.trigger(**trigger).start()


def read_stats(spark: SparkSession, stats: str) -> DataFrame:
    """RUN_STATS rows of all runs so far."""
    return spark.read.parquet(f"{stats}/batch_*")
