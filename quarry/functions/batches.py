"""Bounds on what a Python worker holds at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows of an Arrow batch: texts and pages are long, and an executor's workers share its memory.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows, unless the session sets a number itself. Changes no result."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_ROWS))
