"""Every registered query against its SQL, at the smallest scale."""

from __future__ import annotations

import pytest
from compare import difference, duck

import __spark_entry__ as entry
from rasterlark.plans import catalog, oracle

SF_DIR = "/root/testdata/sf0.001"
# Those of the optional subpackage have tests of their own.
QUERIES, ORACLES = catalog.all_queries(), oracle.all_oracles()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, name):
    assert difference(spark, SF_DIR, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize(
    "name", ["bev_gray", "bev_dense", "frame_union", "box_pixels", "annotated_image"]
)
def test_generated_methods_can_be_compiled(spark, name):
    """The JVM only interprets methods of more than 8000 bytes."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        execution = QUERIES[name](spark, SF_DIR)._jdf.queryExecution()
        stages = execution.debug().codegenToSeq()
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(sizes) < 8000


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["frame_id", "cell_row", "cell_col", "gray"]
    expected = duck(SF_DIR).sql(ORACLES["bev_gray"]).df()
    assert result.count() == len(expected) > 3000
