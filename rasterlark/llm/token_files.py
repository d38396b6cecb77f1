"""Flat files of token ids with 64-bit document offsets.

A folder holds shards in ascending document order and `index.json`. A shard is
`tokens-<n>.bin`, the ids of its documents end to end as little-endian unsigned
integers of the stated width, and `tokens-<n>.idx`: the number of documents and
of null ids among them (unsigned 64-bit), the documents' ids (signed 64-bit) and
one more offset than documents (unsigned 64-bit), counted in ids from the
shard's start. `index.json` gives each shard's first document and first id,
prefix sums of what tasks wrote, so that a position in the whole corpus is base
plus offset.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlark.llm.common import tidy
from rasterlark.llm.encoding import encoder_for
from rasterlark.sinks.files import create_directory, open_directory, whole_file

ROWS_AT_ONCE = 2000


def write_tokens(
    documents: DataFrame,
    directory: str,
    tokenizer_file: str,
    end_id: int,
    width: int = 2,
    keeps_space: bool = True,
) -> None:
    """Encodes (doc_id, text) and writes the folder. A null text is empty.

    Documents are dealt by ranges of doc_id; rows of one doc_id stay together in
    the order of their texts, null ids come first. A shard is written under
    another name and renamed, so a repeated task replaces it as a whole. The
    driver gets one row for each shard.
    """
    create_directory(directory)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer_file, keeps_space)
        end = np.array([end_id], "<u4").tobytes()
        name = f"tokens-{TaskContext.get().partitionId():06d}"
        sizes: list[int] = []
        ids: list[np.ndarray] = []
        nulls = 0
        first = next(batches, None)
        if first is None or not (first.num_rows or (first := next(batches, None))):
            return
        with whole_file(directory, f"{name}.bin") as stream:
            while first is not None:
                for low in range(0, first.num_rows, ROWS_AT_ONCE):
                    part = first.slice(low, ROWS_AT_ONCE)
                    nulls += part.column(0).null_count
                    ids.append(part.column(0).fill_null(0).to_numpy(zero_copy_only=False))
                    whole = [x + end for x in encoder.encode(part.column(1).cast(pa.binary()).to_pylist())]
                    sizes += [len(x) // 4 for x in whole]
                    flat = np.frombuffer(b"".join(whole), "<u4")
                    if len(flat) and int(flat.max()) >> (8 * width):
                        raise ValueError(f"an id does not fit {width} bytes")
                    stream.write(flat.astype(f"<u{width}").tobytes())
                first = next(batches, None)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
        with whole_file(directory, f"{name}.idx") as stream:
            stream.write(np.array([len(sizes), nulls], "<u8").tobytes())
            stream.write(np.concatenate(ids).astype("<i8").tobytes())
            stream.write(offsets.tobytes())
        yield pa.RecordBatch.from_pydict(
            {"shard": [name], "docs": [len(sizes)], "tokens": [int(offsets[-1])]}
        )

    spark = documents.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    written = (
        rows.repartitionByRange(shards, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(tidy(write, drop_shelf=False), "shard string, docs long, tokens long")
        .collect()
    )
    parts, doc, token = [], 0, 0
    for row in sorted(written):
        parts.append({"shard": row.shard, "docs": row.docs, "tokens": row.tokens,
                      "first_doc": doc, "first_token": token})
        doc, token = doc + row.docs, token + row.tokens
    with whole_file(directory, "index.json") as stream:
        stream.write(json.dumps({"width": width, "end_id": end_id, "shards": parts}).encode())


def map_file(directory: str, name: str) -> pa.Buffer:
    """The file's bytes; mapped into memory where the file system is local."""
    system, path = open_directory(directory)
    if isinstance(system, pafs.LocalFileSystem):
        with pa.memory_map(f"{path}/{name}") as mapped:
            return mapped.read_buffer()
    with system.open_input_file(f"{path}/{name}") as stream:
        return stream.read_buffer()


def read_index(directory: str) -> dict:
    return json.loads(map_file(directory, "index.json").to_pybytes())


def read_shard(
    directory: str, shard: str, width: int
) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, offsets and token ids of a shard. Fails on a cut file."""
    index = np.frombuffer(map_file(directory, f"{shard}.idx"), "<u8")
    docs, nulls = int(index[0]), int(index[1])
    if len(index) != 2 + docs + docs + 1:
        raise ValueError(f"{shard}.idx has a wrong size")
    ids: list[int | None] = index[2 : 2 + docs].view("<i8").tolist()
    ids[:nulls] = [None] * nulls
    offsets = index[2 + docs :].astype(np.int64)
    tokens = np.frombuffer(map_file(directory, f"{shard}.bin"), f"<u{width}")
    if len(tokens) != offsets[-1]:
        raise ValueError(f"{shard}.bin has a wrong size")
    return ids, offsets, tokens


def read_tokens(spark: SparkSession, directory: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, a task for
    each shard. ids_crc32 is over the ids as little-endian 32-bit integers."""
    index = read_index(directory)
    width = index["width"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, offsets, tokens = read_shard(directory, shard, width)
                for low in range(0, len(ids), ROWS_AT_ONCE):
                    high = min(low + ROWS_AT_ONCE, len(ids))
                    wide = tokens[offsets[low] : offsets[high]].astype("<u4")
                    at = offsets[low : high + 1] - offsets[low]
                    cut = [wide[a:b] for a, b in zip(at[:-1], at[1:])]
                    columns = {
                        "doc_id": pa.array(ids[low:high], pa.int64()),
                        "start": pa.array(offsets[low:high] + base, pa.int64()),
                        "n_tokens": pa.array(np.diff(at), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x) for x in cut], pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.array(cut, pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    shards = [(s["shard"], s["first_token"]) for s in index["shards"]]
    frame = spark.createDataFrame(shards, "shard string, first_token long")
    return frame.repartition(max(1, len(shards)), "shard").mapInArrow(
        read, schema + (", ids array<long>" if with_ids else "")
    )
