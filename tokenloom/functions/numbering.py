"""Rows numbered in order over a whole table, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def numbered(df: DataFrame, order: tuple[str, ...], folder: str) -> tuple[DataFrame, int]:
    """df with place (from 0, in order), and how many rows there are. Rows are sorted by ranges and written to folder, which all executors share;
    what comes before a range is known from how many rows each has."""
    part, within = F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__within")
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(part, within, *df.columns).write.parquet(folder)
    rows = df.sparkSession.read.schema("__part int, __within long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)).parquet(folder)
    before, total = [], 0
    for p, n in sorted(map(tuple, rows.groupBy("__part").agg(F.count(F.lit(1))).collect())):
        before.append((p, total))
        total += n
    own = rows.join(F.broadcast(df.sparkSession.createDataFrame(before, "__part int, __before long")), "__part")
    return own.select(*df.columns, (F.col("__before") + F.col("__within")).alias("place")), total
