"""Texts packed into chunks, and keys that travel from chunks to buckets and back.

A chunk holds the texts of consecutive rows of one task, up to CHUNK bytes, compressed;
a task of any size makes as many chunks as it needs. Each chunk sends its keys
(64-bit hashes) to buckets of the hash range as packed arrays, one row per chunk and
bucket; whoever owns a bucket answers each chunk about its own keys only. So no task
holds more than a bucket or a chunk, and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from helixframe.llm.text import mix, raw
from helixframe.session import materialise

CHUNK = 8 << 20
PACK = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
                  ("classes", pa.list_(pa.binary())), ("body", pa.binary())])
PACK_DDL = "chunk long, bucket int, ids array<long>, sizes array<long>, classes array<binary>, body binary"
# From a chunk's texts and given numbers: (bucket, body) of its keys and, by text, a size and a class.
KeysOf = Callable[[list[bytes], list[int | None]], tuple[list[tuple[int, bytes]], list[int] | None, list[bytes] | None]]


def bucket_count(spark: SparkSession) -> int:
    return max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def place(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each hash, and a 32-bit print that tells hashes of a bucket apart."""
    g = mix(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A))
    return ((g >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), g.astype(np.uint32)


def join_key(buckets: np.ndarray, prints: np.ndarray) -> np.ndarray:
    return (buckets.astype(np.uint64) << np.uint64(32)) | prints.astype(np.uint64)


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, column by column."""
    return b"".join([np.array([len(arrays[0])], "<u4").tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]])


def load(data: bytes, *types: str) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    out, at = [], 4
    for t in types:
        out.append(np.frombuffer(data, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def pack_texts(texts: Sequence[bytes]) -> bytes:
    lengths = np.array([len(t) for t in texts], "<u4")
    return dump(lengths) + zstandard.ZstdCompressor(level=1).compress(b"".join(texts))


def unpack_texts(body: bytes) -> list[bytes]:
    (lengths,) = load(body, "<u4")
    data = zstandard.ZstdDecompressor().decompress(body[4 + 4 * len(lengths):], max_output_size=int(lengths.sum()) + 1)
    ends = np.cumsum(lengths.astype(np.int64)).tolist()
    return [data[e - n:e] for e, n in zip(ends, lengths.tolist())]


def by_bucket(to: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of each bucket that occurs, in their order."""
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), order[cuts[b]:cuts[b + 1]]


def _row(chunk: int, bucket: int, ids, sizes, classes, body: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
                                       pa.array([sizes], pa.list_(pa.int64())), pa.array([classes], pa.list_(pa.binary())),
                                       pa.array([body], pa.binary())], schema=PACK)


def pack(docs: DataFrame, keys_of: KeysOf | None, id_col: str = "doc_id", text_col: str = "text", name: str = "packs",
         extra: Column | None = None) -> DataFrame:
    """Written table: rows with bucket -1 hold a chunk's ids and texts, the others its keys for one bucket.

    ``extra``: a number per row that becomes ``sizes`` when the keys give none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        ids, texts, given, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            chunk = base | number
            sizes, classes = given, None
            if keys_of is not None:
                keys, own, classes = keys_of(texts, given)
                sizes = own if own is not None else given
                for b, body in keys:
                    yield _row(chunk, b, None, None, None, body)
            yield _row(chunk, -1, ids, sizes, classes, pack_texts(texts))

        for batch in batches:
            for i, t, e in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), batch["extra"].to_pylist()):
                b = raw(t)
                ids.append(i)
                texts.append(b)
                given.append(e)
                held += len(b)
                if held >= CHUNK:
                    yield from flush()
                    ids, texts, given, held, number = [], [], [], 0, number + 1
        if ids:
            yield from flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), (F.lit(None) if extra is None else extra).cast("long").alias("extra"))
    return materialise(rows.mapInArrow(run, PACK_DDL), name)


def texts_of(packs: DataFrame) -> DataFrame:
    return packs.filter("bucket < 0")


def keys_in(packs: DataFrame) -> DataFrame:
    return packs.filter("bucket >= 0").select("chunk", "bucket", "body")


def answer(keys: DataFrame, by: Sequence[str], run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return keys.groupBy(*by).applyInArrow(run, schema)


def rejoin(packs: DataFrame, answers: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Each chunk's texts together with the answers to it."""
    texts = texts_of(packs).select("chunk", "ids", "sizes", "body")
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)
