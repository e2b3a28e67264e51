"""A log of numbered entries that publishes without renaming anything.

An entry is a small file ``<number>.json``, created only where there is none: of several writers that
want the same number one gets it. What an entry names is written before it, so whoever reads the
newest entry finds all of it; whoever is killed earlier leaves the previous entry the newest. An entry
carries a checksum of itself: one that was cut off by a crash keeps its number but is not read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import SparkSession

from keysnap.sources.storage import create_if_absent, names_in, read_bytes


@dataclass(frozen=True)
class CommitLog:
    spark: SparkSession
    path: str

    def _file(self, number: int) -> str:
        return f"{self.path}/{number:020d}.json"

    def numbers(self) -> list[int]:
        """Numbers that are taken, also by entries that were cut off."""
        names = names_in(self.spark, self.path)
        return [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]

    def next_number(self) -> int:
        return max(self.numbers(), default=0) + 1

    def read(self, number: int) -> dict | None:
        """The entry; None if it was cut off."""
        try:
            whole = json.loads(read_bytes(self.spark, self._file(number)))
            body = json.dumps(whole["entry"], sort_keys=True)
            return whole["entry"] if zlib.crc32(body.encode()) == whole["crc32"] else None
        except (ValueError, KeyError, TypeError):
            return None

    def latest(self) -> dict | None:
        """The newest complete entry."""
        for number in sorted(self.numbers(), reverse=True):
            entry = self.read(number)
            if entry is not None:
                return {**entry, "number": number}
        return None

    def entries(self) -> list[dict]:
        found = ((n, self.read(n)) for n in sorted(self.numbers()))
        return [{**e, "number": n} for n, e in found if e is not None]

    def commit(self, number: int, entry: dict) -> bool:
        """Takes the number for this entry; False if another writer has it."""
        entry = {**entry, "id": uuid.uuid4().hex}
        body = json.dumps(entry, sort_keys=True)
        whole = json.dumps({"crc32": zlib.crc32(body.encode()), "entry": entry})
        return create_if_absent(self.spark, self._file(number), whole.encode())
