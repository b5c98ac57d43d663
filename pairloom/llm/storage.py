"""Tables that cut lineage, kept in the folder that the cluster shares."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from ..sources.shared import fresh, keep, shared_dir

__all__ = ["freed_shuffles", "fresh", "keep", "rows_a_batch", "shared_dir"]

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _meanwhile(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def rows_a_batch(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Bound the Arrow batches of the jobs that run meanwhile; the session's setting is put back after them."""
    with _meanwhile(spark, BATCH, str(rows)):
        yield


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Free the shuffle files of each query that runs meanwhile at its end.

    Else they stay until the driver happens to collect its garbage, so that a
    chain of queries has the files of all of them on disk.
    """
    with _meanwhile(spark, FREED, "true"):
        yield
