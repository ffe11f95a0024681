"""WARC in ZIP packages: write records, deduplicate by revisits, and read by ranges without extraction.

A package is a ZIP file with stored members only: ``archive/*.warc.gz`` (a gzip member a record),
``indexes/index.cdxj`` (a line a record: page, digest, offset and length in the archive) and
``datapackage.json``. The reader finds the end record (and its ZIP64 form), parses the central
directory, locates the members and reads the index and then each record by its range.

Of records with equal payloads of at least ``least`` bytes, that with the largest page id keeps the
payload; the others become revisits that name its page, digest and length.

Defined cases: null html is empty; null urls have no target line; a null page id is never the one
that others refer to unless all are null, and then all stay responses; rows alike in page id and
payload are all responses if theirs is the largest id; an empty table writes no package; other
columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _files, _scale

LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
#: Bytes of payload, and records, after which a task begins another package (an index entry is held for every record).
MOST_BYTES, MOST_RECORDS = 256 << 20, 200_000


# ---- ZIP -----------------------------------------------------------------------------------


class ZipWriter:
    """Stored members, sizes in descriptors behind them; ZIP64 fields where needed, or always."""

    def __init__(self, zip64: bool = False):
        self.at, self.entries, self.zip64 = 0, [], zip64

    def member(self, name: str, parts: Iterable[bytes]) -> Iterator[bytes]:
        raw, start, crc, size = name.encode(), self.at, 0, 0
        head = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0x0808, 0, 0, 0x21, 0, 0, 0, len(raw), 0) + raw
        self.at += len(head)
        yield head
        for x in parts:
            crc, size = zlib.crc32(x, crc), size + len(x)
            self.at += len(x)
            yield x
        wide = self.zip64 or size >= 0xFFFFFFFF
        tail = struct.pack("<4sIQQ" if wide else "<4sIII", b"PK\x07\x08", crc, size, size)
        self.at += len(tail)
        yield tail
        self.entries.append((raw, crc, size, start))

    def end(self) -> Iterator[bytes]:
        start, size, wide = self.at, 0, self.zip64 or self.at >= 0xFFFFFFFF or len(self.entries) >= 0xFFFF
        for raw, crc, n, at in self.entries:
            extra = b""
            if self.zip64 or n >= 0xFFFFFFFF or at >= 0xFFFFFFFF:
                extra, n, at, wide = struct.pack("<HHQQQ", 1, 24, n, n, at), 0xFFFFFFFF, 0xFFFFFFFF, True
            x = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0x0808, 0, 0, 0x21, crc, n, n, len(raw), len(extra), 0, 0, 0, 0, at) + raw + extra
            size += len(x)
            yield x
        n = len(self.entries)
        if wide:
            yield struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, start)
            yield struct.pack("<4sIQI", b"PK\x06\x07", 0, start + size, 1)
            yield struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
        else:
            yield struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, n, n, size, start, 0)


def directory(file: _files.Reader) -> dict[str, tuple[int, int]]:
    """Stored members of a ZIP file: name -> (offset of the data, length)."""
    tail_at = max(0, file.size - 65_557)
    tail = file.at(tail_at, file.size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no ZIP end record")
    count, size, at = struct.unpack("<HII", tail[end + 10 : end + 20])
    where = file.at(tail_at + end - 20, 20) if tail_at + end >= 20 else b""
    if where[:4] == b"PK\x06\x07":
        far = file.at(int.from_bytes(where[8:16], "little"), 56)
        if far[:4] != b"PK\x06\x06":
            raise ValueError("broken ZIP64 end record")
        count, size, at = struct.unpack("<QQQ", far[32:56])
    raw, p, out = file.at(at, size), 0, {}
    for _ in range(count):
        if raw[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, full, a, b, c = (*struct.unpack("<H", raw[p + 10 : p + 12]), *struct.unpack("<II", raw[p + 20 : p + 28]), *struct.unpack("<HHH", raw[p + 28 : p + 34]))
        local = int.from_bytes(raw[p + 42 : p + 46], "little")
        name, extra = raw[p + 46 : p + 46 + a].decode(), raw[p + 46 + a : p + 46 + a + b]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:
                wide = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            extra = extra[4 + n :]
        if method == 0:
            head = file.at(local, 30)
            if head[:4] != b"PK\x03\x04":
                raise ValueError("broken local header")
            out[name] = (local + 30 + sum(struct.unpack("<HH", head[26:30])), packed)
        p += 46 + a + b + c
    return out


# ---- WARC ----------------------------------------------------------------------------------


def _line(x: str) -> str:
    """A header value: controls and per cent signs are escaped, so it stays on its line."""
    return "".join(f"%{b:02X}" if b < 0x20 or b in (0x25, 0x7F) else chr(b) for b in x.encode()).encode("latin-1").decode("utf-8")


def record_id(page_id: int | None, digest: str) -> uuid.UUID:
    """What a revisit can tell of the record it refers to, too: its page and its digest."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}/{digest}")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 response, or a revisit if it refers to a page; the HTTP head tells the payload's length either way."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if refers_to is None else "revisit"
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id(page_id, digest)}>", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {_line(url)}"] if url is not None else []
    head += [f"X-Page-ID: {page_id}"] if page_id is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{record_id(refers_to, digest)}>", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC headers (lower-case names), HTTP head, body."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return headers, http, body


def write_package(uri: str, rows: Iterable[tuple], zip64: bool = False) -> int:
    """``rows``: (page_id, url, payload, digest, refers_to). The index follows the records, in their order."""
    z, index = ZipWriter(zip64), []

    def records():
        at = 0
        for page_id, url, payload, digest, refers_to in rows:
            x = gzip.compress(record(page_id, url, payload, digest, refers_to), 6, mtime=0)
            index.append(json.dumps({"page_id": page_id, "digest": digest, "offset": at, "length": len(x)}))
            at += len(x)
            yield x

    def parts():
        yield from z.member("archive/data.warc.gz", records())
        yield from z.member("indexes/index.cdxj", [("\n".join(index) + "\n").encode()])
        yield from z.member("datapackage.json", [json.dumps({"profile": "data-package", "records": len(index)}).encode()])
        yield from z.end()

    return _files.write(uri, parts())


def read_package(uri: str) -> Iterator[tuple[int | None, int, str, str, int | None]]:
    """(page_id, payload bytes, digest, type, page referred to) of each indexed record; payloads are checked against their digests."""
    with _files.Reader(uri) as f:
        members = directory(f)
        base, size = members["archive/data.warc.gz"]
        for line in f.at(*members["indexes/index.cdxj"]).decode().splitlines():
            entry = json.loads(line)
            if entry["offset"] + entry["length"] > size:
                raise ValueError("the index points past its archive")
            headers, http, body = parse(gzip.decompress(f.at(base + entry["offset"], entry["length"])))
            digest = headers["warc-payload-digest"].removeprefix("sha1:")
            length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
            if headers["warc-type"] == "response" and (len(body) != length or hashlib.sha1(body).hexdigest() != digest):
                raise ValueError(f"damaged record at {entry['offset']}")
            page, other = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
            yield page if page is None else int(page), length, digest, headers["warc-type"], other if other is None else int(other)


# ---- Spark ---------------------------------------------------------------------------------


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write all pages (page_id, url, html) as packages under ``folder`` -> manifest (path, n_records)."""
    spark = pages.sparkSession
    _scale.workers_can_import(spark)
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # Only payloads that can have twins are shuffled: the small ones (empty pages above all) have no hot digest then.
    small, rows = rows.where(F.octet_length("payload") < least), rows.where(F.octet_length("payload") >= least)
    twins = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first"))
    twins = twins.where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first")
    rows = rows.join(twins, "digest", "left")
    rows = rows.select("page_id", "url", "payload", "digest", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))
    rows = rows.unionByName(small.withColumn("refers_to", F.lit(None).cast("long")))

    def run(batches):
        def each():
            for b in batches:
                yield from zip(*[b.column(n).to_pylist() for n in ("page_id", "url", "payload", "digest", "refers_to")], strict=True)

        source, n = each(), 0
        first = next(source, None)
        while first is not None:
            taken = 0

            def some(first=first):
                nonlocal n, taken
                row = first
                while row is not None:
                    n, taken = n + 1, taken + len(row[2])
                    yield row
                    row = next(source, None) if taken < MOST_BYTES and n < MOST_RECORDS else None

            path, n = f"{folder}/{uuid.uuid4().hex}.wacz", 0
            write_package(path, some())
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n_records"])
            first = next(source, None)

    return _scale.saved(_scale.map_arrow(rows, run, "path string, n_records long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """-> page_id, payload_bytes, payload_digest, record_type, refers_to of every record in the packages."""
    spark = manifest.sparkSession
    _scale.workers_can_import(spark)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = []
                for x in read_package(path):
                    rows.append(x)
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = manifest.select("path").repartition(_scale.partitions(spark))
    return _scale.map_arrow(files, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archives(write_archives(pages, f"{_scale.shared_dir(spark)}/warc-{uuid.uuid4().hex[:12]}"))


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(x)) AS BIGINT) AS n, sha1(x) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top, count(*) OVER (PARTITION BY h) AS k FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND k > 1 AND top IS DISTINCT FROM page_id AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND k > 1 AND top IS DISTINCT FROM page_id THEN top END AS refers_to
FROM m
"""
