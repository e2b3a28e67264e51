"""Several tables' jobs at once, from driver threads."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

R = TypeVar("R")
# Jobs of so many tables run at once; more wait. A thread does nothing but submit jobs.
LIMIT = 8


def run_together(
    spark: SparkSession, label: str, work: Mapping[str, Callable[[], R]], limit: int = LIMIT
) -> dict[str, R | Exception]:
    """Runs each function, ``limit`` at a time, and returns its result or the error it raised.

    Each has a job group ``<label>: <name>`` (to be cancelled alone) and a scheduler pool of its own:
    with ``spark.scheduler.mode=FAIR`` a small table is not kept waiting by the tasks of a large one.
    """
    context = spark.sparkContext

    def one(name: str, function: Callable[[], R]) -> R | Exception:
        context.setJobGroup(f"{label}: {name}", f"{label} {name}", True)
        context.setLocalProperty("spark.scheduler.pool", f"{label}-{name}")
        try:
            return function()
        except Exception as e:  # kept to its table
            return e
        finally:
            for key in ("spark.jobGroup.id", "spark.job.description", "spark.scheduler.pool"):
                context.setLocalProperty(key, None)

    with ThreadPoolExecutor(max_workers=max(1, min(limit, len(work) or 1))) as pool:
        threads = {name: pool.submit(inheritable_thread_target(spark)(one), name, f) for name, f in work.items()}
        return {name: t.result() for name, t in threads.items()}
