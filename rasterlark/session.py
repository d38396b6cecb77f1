"""A session with the settings the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


MEBIBYTE = 1024 * 1024


def sizing(input_bytes: int) -> dict[str, str]:
    """Split and shuffle settings for that much point data.

    Splits grow from 128 MiB to 1 GiB, so that 100 TB are about 100,000 map
    tasks and not a million. A shuffle partition stands for 256 MiB of input,
    of which about a third, the key and the maximum, is exchanged. The number
    is capped where the blocks, map tasks times partitions, would become too
    many; beyond that partitions grow and the hash aggregate spills.
    """
    split = min(max(input_bytes // 100_000, 128 * MEBIBYTE), 1024 * MEBIBYTE)
    partitions = min(max(-(-input_bytes // (256 * MEBIBYTE)), 1), 50_000)
    return {
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.shuffle.partitions": str(partitions),
    }


def build_session(
    app_name: str = "rasterlark", master: str | None = None, **settings: str
) -> SparkSession:
    """On a cluster give no master and let spark-submit decide, and pass
    `**sizing(input_bytes)`. AQE merges shuffle partitions that turn out small."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if not (master or "").startswith("local"):
        # The cells of open windows may exceed an executor's heap.
        defaults["spark.sql.streaming.stateStore.providerClass"] = (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        )
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
