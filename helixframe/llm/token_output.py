"""Token ids of whole documents in files of range-coded blocks, and back.

``write`` range-partitions the documents by id and writes one file per partition. A file
is a run of segments (whole documents, some AT_ONCE blocks each) and a footer with the
directory of segments; a segment is its documents' ids and lengths, the static frequency
table that its blocks share, counted over all its ids, and the blocks. ``read`` decodes
segments in parallel. Only a file's name and totals reach the driver.

A null text is an empty one; null ids come first; rows with equal ids are ordered by
their texts' hashes; an empty table writes no file and reads as an empty result; other
columns are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.llm import files, rans
from helixframe.llm.pieces import pieces, small_batches
from helixframe.session import materialise, shared_dir

MAGIC = b"RANSIDS1"
FOOT = "<Q8s"  # length of the directory, magic
SEGMENT = rans.BLOCK * rans.AT_ONCE
READ_TASKS = 10_000  # tasks that decode segments, at most; a task reads several beyond
NO_ID = -(1 << 63)


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Write the files; returns part, path, n_ids, n_docs of each, in order of part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(tokenizer)
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:8]}.rans"
        out, segments, held, ids, lengths, position = None, [], [], [], [], 0

        def flush() -> None:
            nonlocal position, held, ids, lengths
            values = np.concatenate(held)
            table = rans.Table.fit(np.bincount(values, minlength=p.size))
            head, packed = zlib.compress(np.array(ids, "<i8").tobytes() + np.array(lengths, "<i8").tobytes(), 1), table.pack()
            body = b"".join([struct.pack("<III", len(ids), len(head), len(packed)), head, packed, *rans.encode(table, values)])
            out.write(body)
            segments.append({"offset": position, "bytes": len(body), "n_ids": len(values), "n_docs": len(ids)})
            position += len(body)
            held, ids, lengths = [], [], []

        waiting = 0
        for batch in batches:
            texts, keys = batch["text"].to_pylist(), batch["id"].to_pylist()
            for s in small_batches(texts):
                numbers, per_text = p.numbers(texts[s])
                held.append(p.expand(numbers))
                waiting += len(held[-1])
                ids += [NO_ID if k is None else k for k in keys[s]]
                lengths += p.lengths_by_text(numbers, per_text).tolist()
                if out is None:
                    out = files.create(path)
                    out.write(MAGIC)
                    position = len(MAGIC)
                if waiting >= SEGMENT:
                    flush()
                    waiting = 0
        if out is not None:
            if ids:
                flush()
            foot = zlib.compress(json.dumps(segments).encode())
            out.write(foot + struct.pack(FOOT, len(foot), MAGIC))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([path]), pa.array([sum(s["n_ids"] for s in segments)], pa.int64()),
                                              pa.array([sum(s["n_docs"] for s in segments)], pa.int64())], ["part", "path", "n_ids", "n_docs"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text")).select("id", "text")
    return materialise(rows.mapInArrow(run, "part long, path string, n_ids long, n_docs long"), "token-files").orderBy("part")


def directory(path: str) -> list[dict]:
    tail, size = files.read_tail(path, 64)
    length, magic = struct.unpack(FOOT, tail[-struct.calcsize(FOOT):])
    if magic != MAGIC:
        raise ValueError(f"{path} is not a file of token ids")
    return json.loads(zlib.decompress(files.read_range(path, size - struct.calcsize(FOOT) - length, length)))


def segment(path: str, offset: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, their numbers of token ids, and all token ids of one segment."""
    data = files.read_range(path, offset, length)
    n, head, packed = struct.unpack_from("<III", data)
    both = np.frombuffer(zlib.decompress(data[12:12 + head]), "<i8")
    table = rans.Table.unpack(data[12 + head:12 + head + packed])
    return both[:n], both[n:], rans.decode(table, data[12 + head + packed:])


def read(spark: SparkSession, written: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    starts, at = [], 0
    for r in written.select("path", "n_ids").collect():  # one row per file
        starts.append((r["path"], at))
        at += r["n_ids"]

    def list_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
                rows = directory(path)
                ends = np.cumsum([start] + [s["n_ids"] for s in rows])
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([s["offset"] for s in rows], pa.int64()),
                                                  pa.array([s["bytes"] for s in rows], pa.int64()), pa.array(ends[:-1], pa.int64())],
                                                 ["path", "offset", "bytes", "start"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset, length, start in zip(*[batch[c].to_pylist() for c in ("path", "offset", "bytes", "start")]):
                keys, lengths, ids = segment(path, offset, length)
                ends = np.cumsum(lengths)
                view = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([None if k == NO_ID else k for k in keys.tolist()], pa.int64()), pa.array(start + ends - lengths, pa.int64()),
                                                  pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not starts:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(starts, "path string, start long").repartition(min(len(starts), 256))
    segments = materialise(listed.mapInArrow(list_segments, "path string, offset long, bytes long, start long"), "token-segments")
    tasks = max(1, min(segments.count(), READ_TASKS))
    return segments.repartitionByRange(tasks, "start").mapInArrow(decode, schema)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    folder = folder or shared_dir(docs.sparkSession, "token-ids")
    return read(docs.sparkSession, write(docs, folder, id_col, text_col, tokenizer))
