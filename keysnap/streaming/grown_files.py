"""A stream of files that are new or have another length than before."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keysnap.session import cut, local_frame
from keysnap.sources.files import delete_paths
from keysnap.sources.listing import list_files
from keysnap.sources.storage import exists

LISTED = "root string, path string, rel_path string, name string, length bigint, modified timestamp"


def listing_of(state: str, batch: int) -> str:
    return f"{state.rstrip('/')}/listings/{batch:012d}"


def _sealed(spark: SparkSession, path: str) -> bool:
    """Spark's writer leaves this mark once all parts are in place."""
    return exists(spark, f"{path}/_SUCCESS")


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """The files of ``now`` that ``before`` lacks or has with another length, and ``previous_length``
    (null: not there). Both have ``path`` and ``length``; files that are gone give no row."""
    old = before.select("path", F.col("length").alias("previous_length"))
    differs = F.col("previous_length").isNull() | (F.col("length") != F.col("previous_length"))
    return now.join(old, "path", "left").where(differs).select(*now.columns, "previous_length")


def grown_files_stream(
    spark: SparkSession,
    roots: Sequence[str],
    state: str,
    each: Callable[[DataFrame, int], None],
    every: str = "1 minute",
    once: bool = False,
    on_missing: str = "fail",
    parallelism: int | None = None,
) -> StreamingQuery:
    """Gives ``each`` the files below ``roots`` that are new or have another length, batch by batch.

    A file stream of Spark's own never gives a file again. Here the stream's offset is the number of a
    batch, which stands for a listing: each batch lists all directories in tasks, keeps (path, length)
    of every file as a table below ``state``, and joins it with the batch before. So the set of files
    is never held by the driver, and may be of any size.

    A batch is given again, with the same rows and the same number, if its run was cut short: its listing is
    sealed before anything is given, and a sealed listing is never taken again. With an ``each`` that does
    the same number only once, or may repeat it, nothing is lost or repeated. A file that goes and
    comes back is new; one that changes and keeps its length is not seen; what changes twice between two
    batches is given once. ``each`` is called for batches without files, too. The listings of the last two
    batches are kept. With ``once`` a single batch is run.
    """
    base = state.rstrip("/")

    def tick(_: DataFrame, batch: int) -> None:
        place, last = listing_of(base, batch), listing_of(base, batch - 1)
        if batch and not _sealed(spark, last):
            raise RuntimeError(f"the listing of batch {batch - 1} is gone from {base}")
        if not _sealed(spark, place):
            listed = list_files(spark, list(roots), recursive=True, on_missing=on_missing, parallelism=parallelism)
            files = listed.where(~F.col("is_dir")).select("root", "path", "rel_path", "name", "length", "modified")
            files.write.mode("overwrite").parquet(place)
        read = lambda path: spark.read.schema(LISTED).parquet(path)
        before = read(last) if batch else local_frame(spark, [], LISTED)
        each(changed_files(read(place), before), batch)
        if batch > 1:
            cut(delete_paths(local_frame(spark, [(listing_of(base, batch - 2),)], "path string"), 1))

    beat = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    writer = beat.writeStream.foreachBatch(tick).option("checkpointLocation", f"{base}/beat")
    trigger = {"availableNow": True} if once else {"processingTime": every}
    return writer.trigger(**trigger).start()
