from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from rasterlark.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.ui.enabled": "false",
            "spark.sql.maxMetadataStringLength": "2000",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def points(spark):
    """Builds a point table from (x, y, intensity[, frame]) tuples."""

    def build(rows, width="FLOAT"):
        full = [(str(r[3]) if len(r) > 3 else "a", *r[:3]) for r in rows]
        schema = f"frame_id STRING, x {width}, y {width}, intensity FLOAT"
        return spark.createDataFrame(full, schema)

    return build


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()
