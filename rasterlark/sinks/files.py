"""Files written from inside tasks, one per frame, on any shared file system.

A file is written under a temporary name and then renamed, so a task that dies
or runs twice leaves either nothing or the whole file.
"""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager
from typing import BinaryIO
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyarrow import fs as pafs
from pyspark.sql import SparkSession


def absolute(spark: SparkSession, directory: str) -> str:
    """The directory as a URI that means the same in every task. Without a
    scheme it belongs to Spark's default file system, relative to the driver's
    working directory there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return path.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()


def open_directory(directory: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a directory given as a path or URI."""
    uri = re.sub(r"^file:/(?!/)", "file:///", directory)
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def whole_file(directory: str, name: str) -> Iterator[BinaryIO]:
    """A stream whose content appears under `name` only once it is complete."""
    file_system, path = open_directory(directory)
    temporary = f"{path}/.{name}.{uuid.uuid4().hex}.tmp"
    target = f"{path}/{name}"
    try:
        with file_system.open_output_stream(temporary) as stream:
            yield stream
    except BaseException:
        if file_system.get_file_info(temporary).type == pafs.FileType.File:
            file_system.delete_file(temporary)
        raise
    file_system.move(temporary, target)


def create_directory(directory: str) -> None:
    """Parents included; an existing directory is left as it is."""
    file_system, path = open_directory(directory)
    file_system.create_dir(path, recursive=True)


def file_name(prefix: str, frame_id: str, suffix: str) -> str:
    return f"{prefix}_{quote(str(frame_id), safe='')}.{suffix}"


def parse_file_name(path: str) -> str:
    """The frame_id of a name made by `file_name`."""
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return unquote(stem.split("_", 1)[-1])
