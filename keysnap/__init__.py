"""keysnap: key-range snapshots, verified restore and incremental log archives on Spark."""

from keysnap.plans.archive import archive_once
from keysnap.plans.restore import read_restored, restore_tables
from keysnap.plans.snapshot import resume_snapshot, take_snapshot
from keysnap.sources.rows import KeyedTable
from keysnap.streaming.archive_stream import archive_stream
from keysnap.streaming.grown_files import grown_files_stream

__all__ = [
    "KeyedTable", "archive_once", "archive_stream", "grown_files_stream", "read_restored", "restore_tables",
    "resume_snapshot", "take_snapshot",
]
