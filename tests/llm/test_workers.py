"""Every query with workers that lack the package."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

# The driver finds the package through sys.path, its workers have another folder.
PROGRAM = """
import os, sys
sys.path.insert(0, {root!r})
from rasterlark.session import build_session
spark = build_session("workers", "local[4]", **{{
    "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
    "spark.driver.memory": "4g", "spark.checkpoint.dir": {shared!r}}})
def found(batches):
    import importlib.util
    import pyarrow as pa
    for batch in batches:
        yield pa.RecordBatch.from_pydict({{"n": [int(importlib.util.find_spec("rasterlark") is not None)]}})
assert spark.range(1).mapInArrow(found, "n long").first().n == 0
from rasterlark.llm import queries
for name, query in queries.all_queries().items():
    query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print("done", name, flush=True)
"""


def test_all_queries(tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    program = tmp_path / "program.py"
    program.write_text(PROGRAM.format(root=str(ROOT), shared=str(tmp_path / "shared")))
    done = subprocess.run(
        [sys.executable, str(program)], cwd=tmp_path, env=environment, capture_output=True, text=True
    )
    assert done.stdout.count("done") == 13, done.stderr[-3000:]
