"""Bounds on what goes to Python at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
MOST_ROWS = 1_000


def bound_batches(spark: SparkSession) -> None:
    """Send whole texts to Python at most MOST_ROWS at a time.

    Sets the session's option, if it is larger.  A batch lies in the JVM, in the Python worker and on the way, several
    times over, for each task of an executor.
    """
    set_to = int(spark.conf.get(_ROWS))
    if set_to <= 0 or set_to > MOST_ROWS:
        spark.conf.set(_ROWS, str(MOST_ROWS))
