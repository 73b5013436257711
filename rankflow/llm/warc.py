"""WARC archives: a writer of gzip members with revisits, and a splittable reader.

Files are reached through pyarrow's file systems, in a folder that all executors share.  A writing task makes files of its own, named
anew at each attempt, and returns their names: what a lost attempt left is in no manifest, so never read.

The reader's tasks have byte ranges.  A task looks for the gzip magic from its start on, takes a place as a member if it
inflates to a WARC header, and owns the records that start inside its range, to their ends behind it.  A member that turns out
broken is passed over to the next valid place.

Edge cases: null payloads are empty; null urls have no Target-URI; rows that repeat a page_id with one payload are all
responses if the page_id is the smallest; null page_ids are written without an id and read as null, and refer to or are
responses like others (a payload with null ids only has only responses).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, dealt_join, many, shared_dir

_MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 18
#: Bytes inflated at once: a small member costs no copy of the range behind it.
_PIECE = 1 << 14


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def record(page_id, url, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to: the smallest page_id of the pages with an equal payload, where that is another page's and the payload has min_bytes at least."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumn("sha", F.sha1("payload"))
    counted = cut(rows.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1"))
    again = (F.length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    # a payload that very many pages have meets its first page in many tasks
    return dealt_join(rows, counted.select("sha", "first"), "sha", many(counted, "sha"), "left", ["page_id", "url"]).select("page_id", "url", "payload", F.when(again, F.col("first")).alias("refers_to"))


def write_warc(rows: DataFrame, folder: str, roll_bytes: int = 1 << 30) -> DataFrame:
    """Writes (page_id, url, payload, refers_to) and returns the manifest (path, length, records) of the files that count."""

    def step(batches):
        fs, at = _open(folder)
        fs.create_dir(at, recursive=True)
        out, name, size, n = None, None, 0, 0
        for batch in batches:
            for page, url, payload, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                r = record(page, url, payload, sha1_base32(payload), first, first is not None)
                out.write(r)
                size, n = size + len(r), n + 1
                if size >= roll_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "length": [size], "records": [n]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "length": [size], "records": [n]})

    return cut(rows.mapInArrow(step, "path string, length long, records long"))


def _member(data: bytes, at: int, more):
    """(content, end) of the valid member at this place, else None; more(): the data with more read behind, or None."""
    z = zlib.decompressobj(31)
    try:
        head = z.decompress(data[at : at + 4096], 512)
        if not head.startswith(b"WARC/1."):
            return None
        z, body, fed = zlib.decompressobj(31), [], at
        while not z.eof:
            if fed == len(data) and (data := more()) is None:
                return None
            piece = data[fed : fed + _PIECE]
            body.append(z.decompress(piece))
            fed += len(piece)
    except zlib.error:
        return None
    whole = b"".join(body)
    if b"\r\n\r\n" not in whole:
        return None
    return whole, fed - len(z.unused_data)


def _fields(whole: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = whole.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    return named, rest[: int(named.get("Content-Length", len(rest)))]


def scan_range(path: str, lo: int, hi: int):
    """(offset, header fields, block) of the records that start in [lo, hi)."""
    fs, at = _open(path)
    with fs.open_input_file(at) as f:
        size = f.size()
        hi = min(hi, size)
        data = f.read_at(max(0, min(hi + 4096, size) - lo), lo)

        def more():
            nonlocal data
            if lo + len(data) >= size:
                return None
            # half as much again each time: a record of any length is copied a few times only
            data += f.read_at(min(max(_READ, len(data) // 2), size - lo - len(data)), lo + len(data))
            return data

        p = data.find(_MAGIC)
        while p >= 0 and lo + p < hi:
            found = _member(data, p, more)
            if found is None:
                p = data.find(_MAGIC, p + 1)
                continue
            yield (lo + p, *_fields(found[0]))
            p = data.find(_MAGIC, found[1])


def _page(value: str | None):
    value = (value or "").strip("<>").removeprefix("urn:page:")
    return int(value) if value.lstrip("-").isdigit() else None


_READ_SQL = "path string, offset long, page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def read_warc(files: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """Records of archives (path, length), read in byte ranges of split_bytes; payload is null for revisits."""
    ranges = files.where("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("lo"))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def step(batches):
        for batch in batches:
            for path, lo in zip(batch.column("path").to_pylist(), batch.column("lo").to_pylist()):
                rows: list[tuple] = []
                held = 0
                for at, named, block in scan_range(path, lo, lo + split_bytes):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, digest = named.get("WARC-Type"), named.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                    if kind == "response":
                        rows.append((path, at, _page(named.get("WARC-Record-ID")), named.get("WARC-Target-URI"), kind, payload, len(payload), sha1_base32(payload), None))
                    elif kind == "revisit":
                        said = next((int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
                        rows.append((path, at, _page(named.get("WARC-Record-ID")), named.get("WARC-Target-URI"), kind, None, said, digest, _page(named.get("WARC-Refers-To"))))
                    held += len(payload)
                    if held > _READ * 16:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return ranges.repartition(n, "path", "lo").mapInArrow(step, _READ_SQL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
    names = [x.split()[0] for x in _READ_SQL.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def archive_files(spark, folder: str) -> DataFrame:
    """(path, length) of the archives in a folder that Spark can list."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")


def op3_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_warc(with_revisits(pages), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
