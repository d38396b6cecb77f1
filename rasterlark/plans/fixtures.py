"""Point, object and frame tables derived from the given tables.

The given tables hold no geometry. Integer congruences make one up that is the
same in every engine and grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# name -> (table, {column: Spark SQL expression})
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    # Seven frames, one per line number: every frame is large.
    "points_v": (
        "lineitem",
        {
            "frame_id": "l_linenumber",
            # No point of the last frame is in the region.
            "x": "CAST(((l_orderkey*7919 + l_linenumber*104729) % 50000)/1000D "
            "+ CASE WHEN l_linenumber = 7 THEN 100D ELSE 0D END AS FLOAT)",
            # The largest FLOAT below the upper edge, whose cell number rounds up.
            "y": "CAST(CASE WHEN l_partkey % 101 = 0 THEN 19.9999981D "
            "ELSE ((l_partkey*6151 + l_suppkey*389) % 50000)/1000D - 25D END AS FLOAT)",
            "intensity": "CAST(CASE WHEN l_orderkey % 97 = 1 THEN NULL "
            "WHEN l_orderkey % 89 = 1 THEN CAST('NaN' AS DOUBLE) "
            "WHEN l_orderkey % 7 = 1 THEN -0.5D - l_quantity/50D "
            "WHEN l_orderkey % 83 = 1 THEN 1D + l_quantity/50D "
            "ELSE l_quantity/50D END AS FLOAT)",
            # The zone-less time taken as UTC, whatever the session's zone.
            "scanned_at": "timestamp_seconds(unix_date(CAST(l_shipdate AS DATE)) * 86400L "
            "+ hour(l_shipdate) * 3600 + minute(l_shipdate) * 60 + second(l_shipdate))",
        },
    ),
    # A frame per thousand orders, points numbered within the frame.
    "scans_v": (
        "orders",
        {
            "frame_id": "o_orderkey div 1000",
            "point_id": "o_orderkey % 1000",
            "x": "CAST(((o_orderkey*7919) % 44000)/1000D - 2D AS FLOAT)",
            "y": "CAST(((o_custkey*6151 + o_orderkey*31) % 44000)/1000D - 22D AS FLOAT)",
            "z": "CAST(((o_orderkey*389) % 1900)/1000D - 1.6D AS FLOAT)",
            "intensity": "CAST((o_custkey % 997)/996D AS FLOAT)",
        },
    ),
    "objects_v": (
        "supplier",
        {
            "frame_id": "CAST(s_suppkey % 7 + 1 AS INT)",
            "draw_ord": "s_suppkey",
            "id": "s_suppkey",
            "class_name": "CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE CASE s_suppkey % 4 "
            "WHEN 0 THEN 'car' WHEN 1 THEN 'pedestrian' WHEN 2 THEN 'cone' "
            "ELSE 'bus/coach (#2)' END END",
            "x": "((s_suppkey*7919) % 48000)/1000D - 4D",
            "y": "((s_suppkey*6151) % 48000)/1000D - 24D",
            "z": "(s_suppkey % 9)/10D",
            "length": "s_suppkey % 5 + 0.5D",
            "width": "s_suppkey % 3 + 0.5D",
            "yaw": "(s_suppkey % 63)/10D - 3.1D",
        },
    ),
    # Groups of eight boxes close together, groups 20 m apart; a third of all
    # boxes in frame 0.
    "detections_v": (
        "orders",
        {
            "frame_id": "CASE WHEN o_custkey % 3 = 0 THEN 0L ELSE o_orderkey div 800 + 1 END",
            "id": "o_orderkey",
            "class_name": "CASE WHEN o_custkey % 2 = 0 THEN 'car' ELSE 'bus' END",
            "x": "(o_orderkey div 8) % 1000 * 20D + (o_custkey % 7) * 0.7D",
            "y": "(o_orderkey div 8) div 1000 * 20D + (o_custkey % 5) * 0.5D",
            "length": "3.5D + (o_custkey % 4) * 0.25D",
            "width": "1.6D + (o_orderkey % 3) * 0.2D",
            "yaw": "(o_custkey % 63)/10D - 3.1D",
            "score": "(o_custkey % 97)/96D",
        },
    ),
    # A third of all observations in track 0; frames with gaps.
    "tracks_v": (
        "orders",
        {
            "track_id": "CASE WHEN o_custkey % 3 = 0 THEN 0L ELSE o_custkey END",
            "frame_id": "o_orderkey",
            "x": "o_orderkey * 0.05D + ((o_custkey*31 + o_orderkey*17) % 100)/100D",
            "y": "((o_orderkey*7919 + o_custkey*13) % 1000)/250D",
        },
    ),
    # Scenes of 100 frames with five objects far apart, a quarter not seen.
    "sightings_v": (
        "orders",
        {
            "scene_id": "o_orderkey div 500",
            "frame_id": "o_orderkey % 500 div 5",
            "id": "IF(o_custkey % 4 = 0, NULL, o_orderkey)",
            "x": "o_orderkey % 5 * 50D + (o_orderkey % 500 div 5) * 0.5D + (o_custkey % 7) * 0.05D",
            "y": "o_orderkey % 5 * 10D - (o_orderkey % 500 div 5) * 0.2D + (o_custkey % 5) * 0.05D",
        },
    ),
    "frames_v": (
        "supplier",
        {"frame_id": "s_suppkey", "seed": "s_suppkey + 7"},
    ),
}


def derive(table: DataFrame, name: str) -> DataFrame:
    """The view's columns over its table, given as a batch or a stream."""
    return table.selectExpr(
        *(f"{expression} AS {column}" for column, expression in VIEWS[name][1].items())
    )


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return derive(spark.read.parquet(f"{sf_dir}/{VIEWS[name][0]}.parquet"), name)


def stream_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream, be it one file or a folder of files."""
    path = f"{sf_dir}/{VIEWS[name][0]}.parquet"
    schema = spark.read.parquet(path).schema
    # As a pattern the path may name a file.
    table = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return derive(table, name)
