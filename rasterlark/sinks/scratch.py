"""Where intermediate tables and round trips are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_directory(spark: SparkSession, purpose: str) -> str:
    """A new path under the shared folder named by spark.checkpoint.dir, which
    is removed when the driver ends.

    Only a local session without that setting gets a temporary folder; on a
    cluster such a folder would not be seen by the other machines.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="rasterlark-")
    directory = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    system = path.getFileSystem(conf)
    system.mkdirs(path)
    system.deleteOnExit(path)
    return f"{directory}/data"
