"""Arrow batches of bounded size for everything that runs Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch that goes to a Python worker.
ROWS, BYTES = 1000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a run of long texts can't fill a Python worker."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)):
        try:
            now = int(str(spark.conf.get(key)).rstrip("b"))
        except Exception:  # the setting is unknown to this version, or has a unit
            now = 0
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def bounded_reads(spark: SparkSession) -> None:
    """Keep the batches of the Parquet reader small, where a row is a whole document."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(key)) > ROWS // 4:
        spark.conf.set(key, str(ROWS // 4))
