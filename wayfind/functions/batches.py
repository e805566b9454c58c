"""How many rows go to a Python worker at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

BATCH_ROWS = 1000  # of texts, vectors or lists of terms in an Arrow batch


def bound_batches(spark: SparkSession | None, rows: int = BATCH_ROWS) -> None:
    """Lower the session's rows a batch to `rows`; a setting that is lower already stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark and not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
