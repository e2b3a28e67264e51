"""Metadata stored with a snapshot. Directory names start with neither a dot nor an underscore,
as Spark's file sources skip such names. The seal is the last thing written, as an entry of a commit
log, and makes the snapshot valid. Rounds are claimed in a log of their own, so that two runs never
copy into the same round."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysnap.schema import DESCRIPTOR, FILE_ENTRY, ISSUE, OUTCOME, SLICE_COLS, SNAPSHOT
from keysnap.session import local_frame
from keysnap.sources.commits import CommitLog
from keysnap.sources.storage import exists


@dataclass(frozen=True)
class Snapshot:
    """Paths and stored tables of one snapshot."""

    spark: SparkSession
    path: str

    @property
    def data(self) -> str:
        return f"{self.path}/data"

    def work_path(self, attempt: int) -> str:
        return f"{self.path}/work/attempt_{attempt:04d}"

    def claim_round(self) -> int | None:
        """The number of the next round, now this run's; None if another run took it meanwhile."""
        log = CommitLog(self.spark, f"{self.path}/rounds")
        number = log.next_number()
        return number if log.commit(number, {"round": number}) else None

    def work(self) -> DataFrame | None:
        """The slices of all rounds that were begun; None before the first."""
        rounds = CommitLog(self.spark, f"{self.path}/rounds").numbers()
        paths = [self.work_path(n) for n in rounds if exists(self.spark, f"{self.work_path(n)}/_SUCCESS")]
        return self.spark.read.parquet(*paths) if paths else None

    @property
    def outcomes_path(self) -> str:
        return f"{self.path}/outcomes"

    def new_outcomes_path(self) -> str:
        """Where one writer puts outcomes: jobs that run at once never write to the same directory."""
        return f"{self.outcomes_path}/{uuid.uuid4().hex}"

    def has_outcomes(self) -> bool:
        return exists(self.spark, self.outcomes_path)

    def outcomes(self) -> DataFrame:
        """Every attempt at every slice."""
        reader = self.spark.read.schema(OUTCOME).option("recursiveFileLookup", "true")
        return reader.parquet(self.outcomes_path)

    def manifest(self) -> DataFrame:
        """The slices that the snapshot holds, with row counts and checksums."""
        return self.outcomes().where("status = 'copied'")

    def copied(self) -> DataFrame:
        return self.manifest().select(*SLICE_COLS)

    @property
    def files_path(self) -> str:
        return f"{self.path}/files"

    def files(self) -> DataFrame:
        """Every file of the slices that the snapshot holds; only where files were copied."""
        listed = self.spark.read.schema(FILE_ENTRY).parquet(self.files_path)
        held = self.manifest().select("table_name", "slice_id", "attempt")
        return listed.join(held, ["table_name", "slice_id", "attempt"], "left_semi")

    def descriptors(self) -> DataFrame:
        return self.spark.read.schema(DESCRIPTOR).parquet(f"{self.path}/descriptors")

    def issues(self) -> DataFrame:
        return self.spark.read.schema(ISSUE).parquet(f"{self.path}/issues")

    @property
    def _seals(self) -> CommitLog:
        return CommitLog(self.spark, f"{self.path}/seal")

    def put_seal(self, name: str, started: datetime, ended: datetime, tables: list[str], verified: bool) -> bool:
        """Seals the snapshot; False if another run has done so."""
        times = {"started": started.isoformat(), "ended": ended.isoformat()}
        return self._seals.commit(1, {"name": name, "tables": tables, "verified": verified, **times})

    def seal(self) -> DataFrame:
        found = self._seals.latest()
        if found is None:
            raise FileNotFoundError(f"{self.path} is not sealed")
        times = [datetime.fromisoformat(found[c]) for c in ("started", "ended")]
        return local_frame(self.spark, [(found["name"], *times, found["tables"], found["verified"])], SNAPSHOT)

    def is_sealed(self) -> bool:
        return self._seals.latest() is not None

    def is_prepared(self) -> bool:
        return exists(self.spark, f"{self.path}/descriptors/_SUCCESS")

    def table_stats(self) -> DataFrame:
        """Rows and checksum of each table, summed up from its slices."""
        return self.manifest().groupBy("table_name").agg(
            F.sum("rows").alias("rows"), F.sum("checksum").cast("decimal(38,0)").alias("checksum")
        )
