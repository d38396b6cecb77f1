from __future__ import annotations

import shutil

import pytest
from compare import difference
from pyspark.sql import functions as F

from rasterlark import points_to_bev
from rasterlark.plans import catalog, oracle
from rasterlark.streaming import read_windows, stream_bev, write_windows

SCHEMA = "frame_id STRING, x FLOAT, y FLOAT, intensity FLOAT, at TIMESTAMP"


def drain(spark, source, out, checkpoint):
    points = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        stream_bev(points, "at", "100 seconds", "50 seconds")
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def test_closed_windows_equal_the_batch_raster_and_restarts_add_nothing(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def batch(low, high):
        return spark.range(low, high).selectExpr(
            "concat('f', id % 2) AS frame_id", "CAST(id % 13 AS FLOAT) AS x",
            "CAST(id % 5 AS FLOAT) AS y", "CAST(id % 17 / 16D AS FLOAT) AS intensity",
            "timestamp_seconds(id) AS at",
        )

    for part in range(4):
        batch(part * 250, part * 250 + 250).coalesce(1).write.mode("append").parquet(source)
    drain(spark, source, out, checkpoint)
    drain(spark, source, out, checkpoint)
    got = spark.read.parquet(out)
    # Newest point at 999 s, watermark at 949 s: nine windows are closed.
    closed = batch(0, 900).withColumn(
        "frame_id", F.concat_ws("/", "frame_id", F.expr("unix_seconds(at) div 100"))
    )
    expected = {tuple(r) for r in points_to_bev(closed).collect()}
    rows = got.select(
        F.concat_ws("/", "frame_id", F.expr("unix_seconds(window_start) div 100")),
        "cell_row", "cell_col", "gray",
    ).collect()
    assert len(rows) == len(set(rows)) and {tuple(r) for r in rows} == expected

    # A later file closes the tenth window; a point behind the watermark is dropped.
    batch(1200, 1201).union(batch(3, 4)).coalesce(1).write.mode("append").parquet(source)
    drain(spark, source, out, checkpoint)
    starts = spark.read.parquet(out).select(F.unix_seconds("window_start")).distinct()
    assert {r[0] for r in starts.collect()} == set(range(0, 1000, 100))
    assert spark.read.parquet(out).filter("unix_seconds(window_start) = 0").count() == got.filter(
        "unix_seconds(window_start) = 0"
    ).count()


def test_all_windows_whatever_the_batches(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    table = spark.range(1000).selectExpr(
        "concat('f', id % 2) AS frame_id", "CAST(id % 13 AS FLOAT) AS x", "CAST(id % 5 AS FLOAT) AS y",
        "CAST(id % 17 / 16D AS FLOAT) AS intensity", "timestamp_seconds(id * 7919 % 1000) AS at",
    )
    # Every file holds points of all times.
    table.repartition(5).write.parquet(source)
    for _ in range(2):
        points = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        write_windows(points, "at", "100 seconds", out, checkpoint).awaitTermination()
    keyed = table.withColumn("frame_id", F.concat_ws("/", "frame_id", F.expr("unix_seconds(at) div 100")))
    expected = {tuple(r) for r in points_to_bev(keyed).collect()}
    name = F.concat_ws("/", "frame_id", F.expr("unix_seconds(window_start) div 100"))
    got = read_windows(spark, out).select(name, "cell_row", "cell_col", "gray").collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected
    assert spark.read.parquet(out).select("batch").distinct().count() == 5


@pytest.mark.parametrize("files", [1, 4])
def test_a_table_of_several_files(spark, tmp_path, files):
    """The registered query over a folder, one file to a batch."""
    given = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{given}/lineitem.parquet")
    table.repartition(files).write.parquet(str(tmp_path / "lineitem.parquet"))
    sql = oracle.all_oracles()["bev_stream"].replace(
        "FROM lineitem", f"FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')"
    )
    for name in ("supplier", "orders"):
        shutil.copy(f"{given}/{name}.parquet", tmp_path)

    def query(session, _):
        return catalog.bev_stream(session, str(tmp_path))

    assert difference(spark, given, query, sql) is None
