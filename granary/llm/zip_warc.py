"""Web archives packed in ZIP files: a writer, and a reader that never unpacks.

An archive is a ZIP file with two stored (not compressed) members: archive/data.warc.gz, the records,
each a gzip member of its own, and indexes/index.cdx, a line of JSON for each record with its offset and length. The reader takes the end of the file, finds the central
directory (by the ZIP64 records where the plain ones are full), locates the members, reads the index, then reads just the
ranges of the records it wants.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column

WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Bytes of records after which a writer begins a new archive, and bytes that a reader asks for at once.
ARCHIVE_BYTES, RANGE_BYTES = 16 << 20, 4 << 20
#: Payloads under this size are always written in full.
REVISIT_BYTES = 100
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


# ---------------------------------------------------------------- ZIP


class ZipWriter:
    """Stored members, one after the other, on a stream that only goes forward. Sizes go in a descriptor behind the data.

    Local headers always carry the ZIP64 field, as sizes aren't known before; `zip64` forces the ZIP64 end records too.
    """

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.members, self.zip64 = out, 0, [], zip64

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.name, self.header, self.crc = raw, self.at, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._write(struct.pack("<4s5H3I2H", b"PK\3\4", 45, 0x0808, 0, 0, 0x21, 0, _FULL32, _FULL32, len(raw), len(extra)) + raw + extra)
        self.data = self.at

    def write(self, data: bytes) -> int:
        """Returns where in the member the data starts."""
        start = self.at - self.data
        self.crc = zlib.crc32(data, self.crc)
        self._write(data)
        return start

    def end(self) -> None:
        size = self.at - self.data
        self._write(struct.pack("<4sIQQ", b"PK\7\10", self.crc, size, size))
        self.members.append((self.name, self.header, size, self.crc))

    def close(self) -> None:
        start = self.at
        for name, header, size, crc in self.members:
            big = self.zip64 or max(size, header) >= _FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, header) if big else b""
            size, header = (_FULL32, _FULL32) if big else (size, header)
            self._write(
                struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45, 0x0808, 0, 0, 0x21, crc, size, size, len(name), len(extra), 0, 0, 0, 0, header)
                + name
                + extra
            )
        length, n = self.at - start, len(self.members)
        big = self.zip64 or max(start, length) >= _FULL32 or n >= _FULL16
        if big:
            where = self.at
            self._write(struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, length, start))
            self._write(struct.pack("<4sIQI", b"PK\6\7", 0, where, 1))
            n, length, start = _FULL16, _FULL32, _FULL32
        self._write(struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, n, n, length, start, 0))
        self.out.close()


def zip_members(size: int, read) -> dict[str, tuple[int, int]]:
    """Members that are stored: name to offset of the data and length. read(offset, length) gives bytes of the file."""
    tail_at = max(0, size - 66_000)  # the end record, with the longest comment that it can have
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, end + 10)
    if _FULL16 == n or _FULL32 in (length, start):
        locator = read(tail_at + end - 20, 20) if end < 20 else tail[end - 20 : end]
        if locator[:4] == b"PK\6\7":
            record = read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end of central directory")
            n, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, at, out = read(start, length), 0, {}
    for _ in range(n):
        sig, flags, method = struct.unpack_from("<4s4xHH", directory, at)
        if sig != b"PK\1\2":
            raise ValueError("broken central directory")
        packed, plain, k, x, c = struct.unpack_from("<IIHHH", directory, at + 20)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name, extra = directory[at + 46 : at + 46 + k].decode(), directory[at + 46 + k : at + 46 + k + x]
        i = 0
        while i + 4 <= len(extra):  # the 64-bit values stand in for those that are full, in this order
            kind, long = struct.unpack_from("<HH", extra, i)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{long // 8}Q", extra, i + 4))
                plain = next(values) if plain == _FULL32 else plain
                packed = next(values) if packed == _FULL32 else packed
                header = next(values) if header == _FULL32 else header
            i += 4 + long
        if method == 0 and not flags & 1 and packed == plain:
            local = read(header, 30)
            name_len, extra_len = struct.unpack_from("<HH", local, 26)
            out[name] = (header + 30 + name_len + extra_len, plain)
        at += 46 + k + x + c
    return out


# ---------------------------------------------------------------- WARC


def warc_record(kind: str, page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    own = f"urn:uuid:{uuid.uuid4()}" if page_id is None else f"urn:page:{page_id}"
    url, refers_url = (x.replace("\r", "%0D").replace("\n", "%0A") if x else x for x in (url, refers_url))
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{own}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        head.append(f"WARC-Refers-To-Target-URI: {refers_url}")
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, with lower-case names, and the block."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    start = end + 4
    block = data[start : start + int(headers["content-length"])]
    if data[start + len(block) :] != b"\r\n\r\n":
        raise ValueError("the record does not end where its length says")
    return headers, block


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_archives(pages: DataFrame, folder: str, zip64: bool = False) -> DataFrame:
    """Writes one WARC record per row of pages to ZIP archives under folder (a URI that executors can write to), and
    returns a table of archive (URI) and records.

    pages: page_id, url, html, digest, refers_to, refers_url (see `archived`). Each attempt of a task writes files of its
    own name; the table names those of the attempt that counted, so files of lost attempts are never read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _filesystem(folder)
        where.create_dir(base, recursive=True)
        task, out, done, n, index = TaskContext.get(), None, [], 0, []

        def close() -> None:
            nonlocal out
            out.end()
            out.begin(INDEX)
            out.write("".join(json.dumps(x) + "\n" for x in index).encode())
            out.end()
            out.close()
            done.append((f"{folder.rstrip('/')}/{name}", len(index)))
            index.clear()
            out = None

        for batch in batches:
            rows = zip(*(column(batch, c) for c in ("page_id", "url", "html", "digest", "refers_to", "refers_url")), strict=True)
            for row in rows:
                page, url, html, digest, to, to_url = (x.as_py() for x in row)
                if out is None:
                    name = f"{task.partitionId()}-{task.taskAttemptId()}-{n}-{uuid.uuid4().hex}.zip"
                    n += 1
                    out = ZipWriter(where.open_output_stream(f"{base}/{name}"), zip64)
                    out.begin(WARC)
                kind = "response" if to is None else "revisit"
                record = gzip.compress(warc_record(kind, page, url or "", (html or "").encode(), digest, to, to_url or ""), 1, mtime=0)
                index.append({"id": page, "offset": out.write(record), "length": len(record), "digest": digest, "type": kind})
                if out.at >= ARCHIVE_BYTES:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"archive": [x for x, _ in done], "records": pa.array([k for _, k in done], pa.int64())})

    return pages.mapInArrow(write, "archive string, records long")


def _ranges(entries: list[dict]) -> Iterator[list[dict]]:
    """Neighbours in the file, joined up to RANGE_BYTES."""
    group: list[dict] = []
    for x in entries:
        if group and (x["offset"] != group[-1]["offset"] + group[-1]["length"] or x["offset"] + x["length"] - group[0]["offset"] > RANGE_BYTES):
            yield group
            group = []
        group.append(x)
    if group:
        yield group


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives (column archive: URIs): page_id, url, record_type, refers_to, payload (of
    revisits null), payload_digest (as the record states it; checked against the payload where there is one)."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for uri in (x for f in frames for x in f["archive"]):
            where, path = _filesystem(uri)
            with where.open_input_file(path) as file:
                members = zip_members(file.size(), lambda at, n: file.read_at(n, at))  # noqa: B023
                at, length = members[INDEX]
                entries = [json.loads(x) for x in file.read_at(length, at).decode().splitlines()]
                start, _ = members[WARC]
                for group in _ranges(entries):
                    first, last = group[0], group[-1]
                    data, rows = file.read_at(last["offset"] + last["length"] - first["offset"], start + first["offset"]), []
                    for x in group:
                        at = x["offset"] - first["offset"]
                        headers, block = parse_record(gzip.decompress(data[at : at + x["length"]]))
                        digest, kind = headers["warc-payload-digest"].removeprefix("sha256:"), headers["warc-type"]
                        to = headers.get("warc-refers-to")
                        if kind == "response" and hashlib.sha256(block).hexdigest() != digest:
                            raise ValueError(f"record {x['id']} of {uri} is damaged")
                        rows.append((x["id"], headers["warc-target-uri"], kind, int(to[10:-1]) if to else None, block if kind == "response" else None, digest))
                    frame = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload", "payload_digest"])
                    yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    return archives.select("archive").mapInPandas(
        read, "page_id long, url string, record_type string, refers_to long, payload binary, payload_digest string"
    )


def archived(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to, refers_url of every page: of pages with equal payloads of at least 100 bytes
    all but that with the smallest page_id refer to it.

    The elections need digests and ids alone; the html goes straight to the writer. Equal payloads join by digest with one
    row for each payload that occurs twice or more, a join that Spark can split if one payload is hot.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    first = (
        rows.where((F.octet_length("html") >= REVISIT_BYTES))
        .groupBy("digest")
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("first").isNotNull())
        .select("digest", F.col("first.page_id").alias("_first"), F.col("first.url").alias("_url"))
    )
    later = (F.col("page_id") > F.col("_first")) | (F.col("page_id").isNull() & F.col("_first").isNotNull())
    return rows.join(first, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(later, F.col("_first")).alias("refers_to"), F.when(later, F.col("_url")).alias("refers_url")
    )


def round_trip(pages: DataFrame, zip64: bool = False) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to. A revisit's bytes come from the response that it refers to.

    Null html is the empty payload. A row with a null page_id is a record under an id of its own, and revisits its equals
    that have one. Rows that repeat a page_id are records of their own; of those with equal payloads, all with the smallest
    id are responses. Other columns are not archived.
    """
    keep = Scratch(pages.sparkSession)
    rows = archived(pages.withColumn("page_id", F.col("page_id").cast("long")))
    written = keep.save(write_archives(rows, keep.path("archives"), zip64), "manifest")
    archives = written.repartition(max(1, written.count()), "archive")
    read = keep.save(read_archives(archives).withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload", "url"), "read")
    sizes = read.where("record_type = 'response'").groupBy(F.col("page_id").alias("_of"), F.col("payload_digest").alias("_digest")).agg(F.max("payload_bytes").alias("_bytes"))
    revisits = read.where("record_type = 'revisit'").join(sizes, (F.col("refers_to") == F.col("_of")) & (F.col("payload_digest") == F.col("_digest")), "left")
    both = revisits.withColumn("payload_bytes", F.col("_bytes")).select(read.columns).unionByName(read.where("record_type = 'response'"))
    return both.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip_sql() -> str:
    return f"""
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p),
    g AS (SELECT *, first IS NOT NULL AND page_id IS DISTINCT FROM first AS later FROM f)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN later THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN later THEN first END AS refers_to FROM g"""
