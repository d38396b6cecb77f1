"""Object documents as an object table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlark.spec import DOCUMENT_SCHEMA

LINE_SCHEMA = T.StructType(
    [
        *DOCUMENT_SCHEMA.fields,
        T.StructField("first", T.LongType()),
        T.StructField("total", T.LongType()),
    ]
)


def read_objects(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(frame_id, draw_ord, id, class_name, x, y, z, length, width, yaw).

    `multi_line` reads a document per file, otherwise the lines of
    `write_object_lines`, which Spark can split. draw_ord is the place in the
    frame's list. The schema is given, and a document that does not fit fails,
    as does a frame of whose lines one is missing or there twice.
    """
    documents = (
        spark.read.schema(DOCUMENT_SCHEMA if multi_line else LINE_SCHEMA)
        .option("multiLine", multi_line)
        .option("mode", "FAILFAST")
        .option("pathGlobFilter", "*.json" if multi_line else "*")
        .json(path)
    )
    if multi_line:
        documents = documents.withColumn("first", F.lit(0))
    else:
        # Lines of a frame, not objects: a few rows in each window.
        frame = Window.partitionBy("frame_id")
        place = frame.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
        size = F.size("objects")
        sound = (
            (F.sum(size).over(frame) == F.col("total"))
            & (F.coalesce(F.sum(size).over(place), F.lit(0)) == F.col("first"))
        )
        documents = documents.withColumn(
            "first",
            F.when(sound, F.col("first")).otherwise(
                F.raise_error(F.concat(F.lit("lines are missing or double in frame "), "frame_id"))
            ),
        )
    return documents.select(
        "frame_id", "first", F.posexplode("objects").alias("at", "o")
    ).select("frame_id", (F.col("first") + F.col("at")).cast("bigint").alias("draw_ord"), "o.*")
