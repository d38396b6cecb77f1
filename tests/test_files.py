from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from rasterlark import GridSpec, make_objects, points_to_bev, save_sample, visualize
from rasterlark.operators.generate import _draw_stream
from rasterlark.operators.raster import frames_of
from rasterlark.sinks import (
    decode_png,
    scratch_directory,
    write_npz,
    write_object_files,
    write_object_lines,
    write_png,
    write_points,
)
from rasterlark.sinks.documents import _writer as document_writer
from rasterlark.sinks.files import file_name, parse_file_name, whole_file
from rasterlark.sinks.npz import _writer as npz_writer
from rasterlark.sinks.png import _writer as png_writer
from rasterlark.sources import npz_frames, read_npz, read_objects, read_points
from rasterlark.sources.npz import _decoder


@pytest.fixture(scope="module")
def scans(spark):
    """A hot frame of 700 points and ten of 30."""
    return spark.range(1000).selectExpr(
        "CASE WHEN id < 700 THEN 'hot' ELSE concat('0', id % 10) END AS frame_id",
        "CASE WHEN id < 700 THEN id ELSE (id - 700) div 10 END AS point_id",
        "CAST(id % 40 AS FLOAT) AS x", "CAST(id % 37 - 18 AS FLOAT) AS y",
        "CAST(id % 3 AS FLOAT) AS z", "CAST(id / 1000 AS FLOAT) AS intensity",
    )


def bag(frame):
    return sorted(map(tuple, frame.collect()))


def test_npz_round_trip_replaces_older_archives(spark, scans, tmp_path):
    folder = tmp_path / "new" / "npz"
    assert write_npz(scans, str(folder)) == (11, 1000)
    names = {p.name for p in folder.iterdir()}
    assert names == {f"frame_0{i}.npz" for i in range(10)} | {"frame_hot.npz"}
    assert bag(read_npz(spark, str(folder))) == bag(scans)
    # A smaller frame leaves nothing of the larger one.
    fewer = scans.where("frame_id = 'hot' AND point_id < 100")
    assert write_npz(fewer, f"file://{folder}") == (1, 100)
    assert bag(read_npz(spark, str(folder))) == bag(scans.where("frame_id <> 'hot'").union(fewer))
    assert {p.name for p in folder.iterdir()} == names


def test_a_frame_is_one_archive_however_it_arrives(spark, scans, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        assert write_npz(scans, str(tmp_path)) == (11, 1000)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert bag(read_npz(spark, str(tmp_path))) == bag(scans)


@pytest.mark.parametrize(
    "points",
    [
        "SELECT 'a' AS frame_id, 1L AS point_id",
        "SELECT 'a' AS frame_id, x AS point_id FROM VALUES (0L), (0L) AS t(x)",
        "SELECT 'a' AS frame_id, x AS point_id FROM VALUES (0L), (2L) AS t(x)",
        "SELECT 'a' AS frame_id, CAST(NULL AS BIGINT) AS point_id",
        "SELECT CAST(NULL AS STRING) AS frame_id, 0L AS point_id",
    ],
)
def test_point_ids_that_do_not_number_the_points_fail(spark, tmp_path, points):
    table = spark.sql(points).selectExpr("*", *(f"1F AS {c}" for c in ("x", "y", "z", "intensity")))
    with pytest.raises(Exception, match="point_id"):
        write_npz(table, str(tmp_path))
    assert not [p for p in tmp_path.iterdir() if p.suffix == ".npz"]


@pytest.mark.parametrize("kind, row", [(np.float64, 183), (np.float32, 184)])
def test_archives_are_binned_at_their_own_width(spark, tmp_path, kind, row):
    np.savez_compressed(tmp_path / "frame_a.npz", points=np.array([[18.4, 0, 0, 1]], kind))
    points = read_npz(spark, str(tmp_path))
    assert points_to_bev(points).first().cell_row == row
    write_npz(points, str(tmp_path / "again"))
    assert np.load(tmp_path / "again" / "frame_a.npz")["points"].dtype == kind
    narrowed = read_npz(spark, str(tmp_path / "frame_a.npz"), width="float")
    assert points_to_bev(narrowed).first().cell_row == 184
    with pytest.raises(ValueError):
        read_npz(spark, str(tmp_path), width="half")


def test_npz_is_a_plain_numpy_archive(spark, scans, tmp_path):
    write_npz(scans, str(tmp_path))
    array = np.load(tmp_path / "frame_hot.npz", allow_pickle=False)["points"]
    assert array.shape == (700, 4) and array.dtype == np.float32
    assert list(array[5]) == [5.0, -13.0, 2.0, np.float32(0.005)]


def test_frame_ids_with_special_characters(spark, scans, tmp_path):
    odd = scans.withColumn("frame_id", F.concat(F.lit("ä/b %2F"), "frame_id"))
    write_npz(odd, str(tmp_path))
    assert bag(read_npz(spark, str(tmp_path))) == bag(odd)
    assert bag(npz_frames(spark, str(tmp_path))) == bag(frames_of(odd))


def test_npz_from_elsewhere(spark, tmp_path):
    rows = np.arange(40.0).reshape(10, 4)
    np.savez_compressed(tmp_path / "frame_wide.npz", points=np.hstack([rows, rows]))
    np.savez(tmp_path / "frame_columns.npz", points=np.asfortranarray(rows))
    got = read_npz(spark, str(tmp_path)).orderBy("frame_id", "point_id").collect()
    for name in ("columns", "wide"):
        assert [r[2:] for r in got if r.frame_id == name] == [tuple(r) for r in rows]
    np.savez(tmp_path / "frame_bad.npz", points=np.array([[{}]], dtype=object))
    with pytest.raises(Exception, match="four columns"):
        read_npz(spark, str(tmp_path / "frame_bad.npz")).count()


def test_object_files(spark, tmp_path):
    frames = spark.createDataFrame([("000001",), ("ä/b",)], "frame_id STRING")
    objects = make_objects(frames).withColumn(
        "class_name", F.when(F.col("id") == 4, "Kegel ä").otherwise(F.col("class_name"))
    )
    assert write_object_files(objects, str(tmp_path)) == 2
    text = (tmp_path / "objects_000001.json").read_text(encoding="utf-8")
    document = json.loads(text)
    assert "Kegel ä" in text and text == json.dumps(document, ensure_ascii=False, indent=2)
    assert list(document) == ["frame_id", "objects"]
    assert document["objects"][0] == {
        "id": 1, "class_name": "car", "x": 12.0, "y": 3.0, "z": 0.0,
        "length": 4.5, "width": 1.9, "yaw": 0.15,
    }
    got = read_objects(spark, str(tmp_path))
    assert bag(got) == bag(objects.select(*got.columns))


def many_objects(spark, count=95):
    return spark.range(count).selectExpr(
        "'hot' AS frame_id", "id * 3 AS draw_ord", "id", "'car' AS class_name", "0D AS x", "0D AS y",
        "0D AS z", "1D AS length", "1D AS width", "0D AS yaw",
    )


def test_documents_of_many_objects(spark, tmp_path):
    objects = many_objects(spark)
    ranked = objects.withColumn("draw_ord", F.expr("draw_ord div 3"))
    assert write_object_files(objects, str(tmp_path / "files")) == 1
    got = read_objects(spark, str(tmp_path / "files"))
    assert bag(got) == bag(ranked.select(*got.columns))
    # Fewer objects leave nothing of the earlier document.
    write_object_files(objects.limit(5), str(tmp_path / "files"))
    assert read_objects(spark, str(tmp_path / "files")).count() == 5
    lines = str(tmp_path / "lines")
    write_object_lines(objects, lines, objects_per_line=10)
    assert spark.read.text(lines).count() == 10
    assert bag(read_objects(spark, lines, multi_line=False)) == bag(ranked.select(*got.columns))


def test_lines_of_a_frame_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    """Nearly all objects in one frame: no task makes more than its share of lines."""
    objects = many_objects(spark, 4000).unionByName(
        many_objects(spark, 5).withColumn("frame_id", F.lit("small"))
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_object_lines(objects, str(tmp_path / "lines"), objects_per_line=50)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = spark.read.text(str(tmp_path / "lines")).groupBy(F.input_file_name()).count().collect()
    assert len(files) == 4 and max(r["count"] for r in files) < 45
    got = read_objects(spark, str(tmp_path / "lines"), multi_line=False)
    ranked = objects.withColumn("draw_ord", F.expr("draw_ord div 3"))
    assert bag(got) == bag(ranked.select(*got.columns))


def test_missing_and_double_lines_fail(spark, tmp_path):
    write_object_lines(many_objects(spark), str(tmp_path / "all"), objects_per_line=10)
    lines = [r.value for r in spark.read.text(str(tmp_path / "all")).collect()]
    for name, kept in (("missing", lines[1:]), ("double", [*lines, lines[3]])):
        path = tmp_path / name
        path.mkdir()
        (path / "part.txt").write_text("\n".join(kept))
        with pytest.raises(Exception, match="missing or double"):
            read_objects(spark, str(path), multi_line=False).collect()


@pytest.mark.parametrize("draw_ord", ["1L", "CAST(NULL AS BIGINT)"])
def test_draw_ord_must_be_unique(spark, tmp_path, draw_ord):
    objects = many_objects(spark, 2).withColumn("draw_ord", F.expr(draw_ord))
    with pytest.raises(Exception, match="draw_ord"):
        write_object_files(objects, str(tmp_path / "files"))
    with pytest.raises(Exception, match="draw_ord"):
        write_object_lines(objects, str(tmp_path / "lines"))


def test_frames_without_objects_have_documents(spark, tmp_path):
    frames = spark.createDataFrame([("hot",), ("empty",)], "frame_id STRING")
    assert write_object_files(many_objects(spark, 2), str(tmp_path), frames) == 2
    text = (tmp_path / "objects_empty.json").read_text()
    assert text == json.dumps({"frame_id": "empty", "objects": []}, indent=2)
    assert read_objects(spark, str(tmp_path)).count() == 2


def test_malformed_document_fails(spark, tmp_path):
    (tmp_path / "objects_x.json").write_text('{"frame_id": "x", "objects": [{"id": "no"}]}')
    with pytest.raises(Exception):
        read_objects(spark, str(tmp_path)).collect()


def test_png_has_the_pixels_and_the_empty_frames(spark, tmp_path):
    spec = GridSpec.of((0.0, 20.0), (-5.0, 5.0), 0.1)
    rng = np.random.default_rng(3)
    pixels = {}
    for frame, count in (("a", 900), ("b", 3)):
        at = rng.choice(100 * 200, count, replace=False)
        pixels[frame] = [(int(p // 200), int(p % 200), *map(int, rng.integers(0, 256, 3))) for p in at]
    rows = [(f, *p) for f, ps in pixels.items() for p in ps]
    image = spark.createDataFrame(rows, "frame_id STRING, out_row INT, out_col INT, b INT, g INT, r INT")
    frames = spark.createDataFrame([("a",), ("b",), ("empty",)], "frame_id STRING")
    assert write_png(image, str(tmp_path), spec, frames) == 3
    for frame in ("a", "b", "empty"):
        expected = np.zeros((100, 200, 3), np.uint8)
        for row, col, b, g, r in pixels.get(frame, []):
            expected[row, col] = (r, g, b)
        picture = decode_png((tmp_path / f"bev_frame_{frame}.png").read_bytes())
        assert (picture == expected).all()
    assert not [p for p in tmp_path.iterdir() if p.suffix == ".tmp"]


@pytest.mark.parametrize("pixel", ["'a', 50, 0", "'a', 0, 60", "'a', -1, 0", "NULL, 0, 0"])
def test_pixels_of_another_grid_fail(spark, tmp_path, pixel):
    spec = GridSpec.of((0.0, 6.0), (-2.0, 2.0), 0.1)
    image = spark.sql(f"SELECT {pixel}, 1, 1, 1").toDF("frame_id", "out_row", "out_col", "b", "g", "r")
    with pytest.raises(Exception, match="outside the picture"):
        write_png(image, str(tmp_path), spec)
    assert not list(tmp_path.glob("*.png"))


def test_failed_task_leaves_no_file(tmp_path):
    with pytest.raises(RuntimeError), whole_file(str(tmp_path), "frame_x.npz") as stream:
        stream.write(b"half")
        raise RuntimeError
    assert not list(tmp_path.iterdir())


@pytest.mark.parametrize("frame_id", ["000001", "a_b", "a/b", "ä b", "x-from", "x-from-5", "100%"])
def test_file_names(frame_id):
    assert parse_file_name(f"file:/d/{file_name('frame', frame_id, 'npz')}") == frame_id


@pytest.mark.parametrize("layout", ["as_is", "clustered", "by_frame"])
def test_parquet_layouts(spark, scans, tmp_path, layout):
    path = str(tmp_path / layout)
    write_points(scans, path, layout)
    kept = read_points(spark, path, scans.schema["frame_id"].dataType)
    assert bag(kept.select(*scans.columns)) == bag(scans)
    with pytest.raises(ValueError):
        write_points(scans, path, "other")


def test_a_narrow_region_reads_few_row_groups(spark, tmp_path):
    scans = spark.range(40_000).selectExpr(
        "id % 2 AS frame_id", "id div 2 AS point_id", "CAST(id * 7919 % 40000 / 1000D AS FLOAT) AS x",
        "CAST(id * 6151 % 40000 / 1000D - 20D AS FLOAT) AS y", "0.5F AS intensity",
    )
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", "16384")
    try:
        write_points(scans, str(tmp_path / "points"), "clustered")
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    kept = total = 0
    for file in (tmp_path / "points").glob("*.parquet"):
        groups = pq.ParquetFile(file).metadata
        at = groups.schema.to_arrow_schema().get_field_index("x")
        for i in range(groups.num_row_groups):
            bounds = groups.row_group(i).column(at).statistics
            total += 1
            kept += bounds.min < 10.5 and bounds.max >= 10.0
    assert total >= 40 and kept <= total / 8


def test_scratch_is_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    first, second = (scratch_directory(spark, "x") for _ in range(2))
    assert first != second and Path(first).parents[1] == Path(shared)
    assert not Path(first).exists() and Path(first).parent.exists()


def test_sample_to_picture(spark, tmp_path):
    assert save_sample(spark, str(tmp_path / "sample")) == 1
    assert {p.name for p in (tmp_path / "sample").iterdir()} == {
        "frame_000001.npz", "objects_000001.json"
    }
    assert visualize(spark, str(tmp_path / "sample"), str(tmp_path / "figures")) == 1
    picture = decode_png((tmp_path / "figures" / "bev_frame_000001.png").read_bytes())
    assert picture.shape == (400, 400, 3)
    points = read_npz(spark, str(tmp_path / "sample"))
    bev = {(r.cell_row, r.cell_col): r.gray for r in points_to_bev(points).collect()}
    assert frames_of(points).count() == 1
    gray = (picture[:, :, 0] == picture[:, :, 1]) & (picture[:, :, 1] == picture[:, :, 2])
    for out_row, out_col in zip(*np.nonzero(gray)):
        assert picture[out_row, out_col, 0] == bev.get((out_col, 399 - out_row), 0)
    # Second object's first corner: column 153, row 265; red, green, blue of a car.
    assert list(picture[399 - 153, 265]) == [0, 220, 0]


def test_tasks_run_where_the_package_is_not_installed(tmp_path):
    for task in (_decoder("float"), npz_writer("d", False), document_writer("d"), png_writer("d", 4, 4), _draw_stream):
        file = tmp_path / "task.pkl"
        file.write_bytes(cloudpickle.dumps(task))
        code = f"import pickle, sys; pickle.load(open({str(file)!r}, 'rb')); assert 'rasterlark' not in sys.modules"
        environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=environment, check=True)


def test_commands_with_their_default_folders(tmp_path):
    """Twice, in an empty folder: relative paths, printed lines, overwriting."""
    environment = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    run = [sys.executable, "-m", "rasterlark", "--master", "local[2]"]
    for _ in range(2):
        for command, line in (("generate", "saved sample data to data/sample"),
                              ("render", "saved 1 pictures to outputs/figures")):
            done = subprocess.run(
                [*run, command], cwd=tmp_path, env=environment, capture_output=True, text=True
            )
            assert done.returncode == 0, done.stderr[-2000:]
            assert done.stdout.splitlines()[-1] == line
        files = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.*") if p.is_file())
        files = [f for f in files if not f.split("/")[-1].startswith(".")]
        assert files == ["data/sample/frame_000001.npz", "data/sample/objects_000001.json",
                         "outputs/figures/bev_frame_000001.png"]
