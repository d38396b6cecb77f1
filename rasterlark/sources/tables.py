"""Point tables from Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_points(
    spark: SparkSession, path: str, frame_type: T.DataType | None = None
) -> DataFrame:
    """A table written by `write_points`. The region filter of the raster
    operators reaches this scan, as do frame predicates.

    Frame ids that are directory names (layout by_frame) come back as Spark
    infers them, so "000001" as a number, unless `frame_type` is given.
    """
    if frame_type is None:
        return spark.read.parquet(path)
    inferred = spark.read.parquet(path).schema
    fields = [
        T.StructField(f.name, frame_type if f.name == "frame_id" else f.dataType)
        for f in inferred.fields
    ]
    return spark.read.schema(T.StructType(fields)).parquet(path)
