"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` is the directory of tables, ``BENCH_CPUS`` the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from keysnap.queries import queries  # noqa: E402
from keysnap.session import build_session  # noqa: E402

HEADLINE = [
    "snapshot_roundtrip",
    "snapshot_retry_roundtrip",
    "restore_roundtrip",
    "restore_roundtrip_text_keys",
    "remaining_slices",
    "contained_slices_many",
    "coverage_issues_many",
    "work_units_many",
    "resolve_source",
    "restore_manifest_check",
    "log_list",
    "logs_new",
    "logs_new_many",
    "archive_plan_many",
    "archive_run_sequence",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    settings["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="keysnap-bench-")
    spark = build_session(f"local[{cpus}]", "bench", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    every = queries()
    # Not timed: starting the JVM and compiling what all queries share.
    every["snapshot_roundtrip"](spark, sf).count()
    times: dict[str, float] = {}
    for name in HEADLINE:
        began = time.perf_counter()
        every[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
