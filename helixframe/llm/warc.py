"""WARC archives with a two-level capture index.

``write`` makes one gzip member per record, one archive file per task. Of records with
equal payloads (``min_revisit`` bytes or more) the one with the largest page id is the
response; the others are revisits without payload. ``build_index`` range-sorts the
captures by reversed-host key into compressed blocks, one file per range, each with a
sparse directory of its blocks' first keys. ``lookup`` bisects the files' last keys, then
the directory, reads one block, and ``fetch`` the records it names, by range.

A null html is an empty payload; a null url has the key "-"; null page ids are the
smallest; of rows with equal payload and page id the later url, then the later row,
wins; every row, also a repeated one, has its record; an empty table writes nothing and
reads as an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.llm import files
from helixframe.llm.text import raw
from helixframe.session import materialise, shared_dir

LINES = 256  # captures in an index block
TAIL = "<Q8s"
MAGIC = b"CAPTURE1"
ENTRY = "key string, page_id long, path string, offset long, length long"
ENTRY_NAMES = ["key", "page_id", "path", "offset", "length"]
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORD_NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def capture_key(url: str | None) -> str:
    """``http://m.example.com:80/a?b#c`` -> ``com,example,m)/a?b``."""
    if not url:
        return "-"
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").rstrip("."), u.port
    except ValueError:
        return url
    if not host:
        return url
    shown = "" if port in (None, 80, 443) else f":{port}"
    return ",".join(reversed(host.split("."))) + shown + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url}")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page-Id: {'' if refers_to is None else refers_to}"]
    data = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
    return gz.compress(data) + gz.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and HTTP payload of one gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[:int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")]
    headers["Payload-Length"] = sizes[0][16:]
    return headers, payload


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 0) -> DataFrame:
    """Write the archives; returns the captures: key, page_id, path, offset, length."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                        F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    first = (rows.filter(F.octet_length(F.coalesce("html", F.lit(""))) >= min_revisit).groupBy("digest")
             .agg(F.max(F.struct("page_id", "url", "row")).alias("r"), F.count(F.lit(1)).alias("n")).filter("n > 1")
             .select(F.col("digest").alias("d"), F.col("r.row").alias("response"), F.col("r.page_id").alias("refers_to")))
    first = materialise(first, "payloads")  # payloads that occur once need no answer
    joined = rows.join(first, F.col("digest") == F.col("d"), "left")
    revisit = F.coalesce(F.col("row") != F.col("response"), F.lit(False))
    joined = joined.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "digest", F.octet_length(F.coalesce("html", F.lit(""))).alias("size"),
                           "refers_to", revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/archive-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.warc.gz"
        out, at = None, 0
        for batch in batches:
            made = []
            for page, url, html, sha, size, refers, again in zip(*[batch[c].to_pylist() for c in ("page_id", "url", "html", "digest", "size", "refers_to", "revisit")]):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                data = record(page, url, raw(html), digest, size, refers, again)
                if out is None:
                    out = files.create(path)
                out.write(data)
                made.append((capture_key(url), page, path, at, len(data)))
                at += len(data)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ENTRY_NAMES)
        if out is not None:
            out.close()
    return materialise(joined.mapInArrow(run, ENTRY), "captures")


@dataclass
class Index:
    """Files of index blocks with their first and last keys, in order."""
    shards: list[tuple[str, str, str]]  # first key, last key, path

    @staticmethod
    def directory(path: str) -> list[list]:
        """[first key, offset, length] of each block, from the end of the file."""
        tail, size = files.read_tail(path, 64)
        length, magic = struct.unpack(TAIL, tail[-struct.calcsize(TAIL):])
        if magic != MAGIC:
            raise ValueError(f"{path} is not a capture index")
        return json.loads(zlib.decompress(files.read_range(path, size - struct.calcsize(TAIL) - length, length)))

    @staticmethod
    def block(path: str, offset: int, length: int) -> list[list]:
        return [json.loads(line) for line in zlib.decompress(files.read_range(path, offset, length)).decode().split("\n")]

    def find(self, url: str) -> list[list]:
        """Captures of one url."""
        return list(Finder(self).captures(capture_key(url)))


class Finder:
    """Look-ups in an index by bisection: files by their last keys, the file's block directory, then one block.

    The last directory and block stay at hand, so that keys asked in order read each once.
    """

    def __init__(self, index: Index):
        self.shards, self.lasts = index.shards, [s[1] for s in index.shards]
        self.path, self.blocks, self.firsts = None, [], []
        self.place, self.rows, self.keys = None, [], []
        self.reads = 0

    def _open(self, path: str) -> None:
        if path != self.path:
            self.path, self.blocks = path, Index.directory(path)
            self.firsts = [b[0] for b in self.blocks]
            self.reads += 1

    def _load(self, i: int) -> None:
        if self.place != (self.path, i):
            self.place, self.rows = (self.path, i), Index.block(self.path, *self.blocks[i][1:])
            self.keys = [e[0] for e in self.rows]
            self.reads += 1

    def captures(self, key: str) -> Iterator[list]:
        for first, _, path in self.shards[bisect.bisect_left(self.lasts, key):]:
            if first > key:
                return
            self._open(path)
            for i in range(max(0, bisect.bisect_left(self.firsts, key) - 1), len(self.blocks)):
                if self.firsts[i] > key:
                    break
                self._load(i)
                yield from self.rows[bisect.bisect_left(self.keys, key):bisect.bisect_right(self.keys, key)]


def build_index(captures: DataFrame, folder: str) -> Index:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.cdx"
        out, at, blocks, held, ends = None, 0, [], [], None

        def flush() -> None:
            nonlocal at, held
            data = zlib.compress("\n".join(json.dumps(e) for e in held).encode())
            out.write(data)
            blocks.append([held[0][0], at, len(data)])
            at, held = at + len(data), []

        for batch in batches:
            for entry in zip(*[batch[c].to_pylist() for c in ENTRY_NAMES]):
                if out is None:
                    out, ends = files.create(path), [entry[0], None]
                ends[1] = entry[0]
                held.append(entry)
                if len(held) == LINES:
                    flush()
        if out is not None:
            if held:
                flush()
            foot = zlib.compress(json.dumps(blocks).encode())
            out.write(foot + struct.pack(TAIL, len(foot), MAGIC))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*ends, path)], ["first", "last", "path"])

    order = ["key", "page_id", "path", "offset"]
    ranged = captures.repartitionByRange(*order).sortWithinPartitions(*order)
    shards = materialise(ranged.select(*ENTRY_NAMES).mapInArrow(run, "first string, last string, path string"), "shards")
    return Index([(r["first"], r["last"], r["path"]) for r in shards.orderBy("first", "last").collect()])  # one row per file


def lookup(index: Index, pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Captures of every distinct key among the pages' urls, each once. Keys are sorted, so a task walks one part of the index."""
    def to_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u) for u in batch["url"].to_pylist()], pa.string())], ["key"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(index)
        for batch in batches:
            found = []
            for key in batch["key"].to_pylist():
                for entry in finder.captures(key):
                    found.append(entry)
                    if len(found) == 10_000:
                        yield _entries(found)
                        found = []
            if found:
                yield _entries(found)

    keys = pages.select(F.col(url_col).cast("string").alias("url")).distinct().mapInArrow(to_keys, "key string").distinct()
    return keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(find, ENTRY)


def _entries(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ENTRY_NAMES)


def fetch(captures: DataFrame) -> DataFrame:
    """The captures' records, read from the archives by range: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for batch in batches:
            made = []
            for path, offset, length in zip(*[batch[c].to_pylist() for c in ("path", "offset", "length")]):
                if path != name:
                    system, local = files.split(path)
                    name, f = path, system.open_input_file(local)
                f.seek(offset)
                headers, payload = parse(f.read(length))
                again = headers["WARC-Type"] == "revisit"
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if not again and digest_of(payload) != digest:
                    raise ValueError(f"the digest differs in {path} at {offset}")
                refers = headers.get("Refers-To-Page-Id")
                made.append((int(headers["Page-Id"]) if "Page-Id" in headers else None, int(headers["Payload-Length"]) if again else len(payload), digest,
                             headers["WARC-Type"], int(refers) if refers else None))
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], RECORD_NAMES)

    return captures.repartitionByRange("path", "offset").sortWithinPartitions("path", "offset").select(*ENTRY_NAMES).mapInArrow(records, RECORD)


def round_trip(pages: DataFrame, folder: str | None = None, url_col: str = "url", **columns) -> DataFrame:
    """Write the pages' archives, index them, look every page's url up and read the records."""
    folder = folder or shared_dir(pages.sparkSession, "archives")
    index = build_index(write(pages, folder, url_col=url_col, **columns), folder)
    return fetch(materialise(lookup(index, pages, url_col), "found-captures"))
