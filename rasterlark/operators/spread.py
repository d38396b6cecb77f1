"""Even distribution of rows that stand for much more work than their size."""

from __future__ import annotations

from pyspark.sql import DataFrame


# What a task makes of its rows.
TASK_BYTES = 64 * 1024 * 1024


def spread(rows: DataFrame, *keys: str, growth: int) -> DataFrame:
    """Exchanges small rows, each about to grow `growth`-fold, over tasks of
    about TASK_BYTES, at least one per core.

    The partition count is explicit: AQE sizes partitions by their bytes and
    would fold these few bytes, and with them all the work, into one task. It
    comes from the estimated size of these rows, not of the point data, and
    spark.sql.shuffle.partitions bounds it.
    """
    spark = rows.sparkSession
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(max(min(size * growth // TASK_BYTES, most), cores), *keys)
