"""Web archives in ZIP packages: written as WARC records in stored members, read back by ranges without extraction.

An archive is a ZIP file with three stored (uncompressed) members: `archive/data.warc.gz`, in which each record is a gzip
member of its own; `indexes/index.cdxj`, one JSON line for each record with its offset and length in the data member; and `datapackage.json`. The
reader looks at the end of the file for the end-of-directory record (following the ZIP64 locator where there is one), parses the central
directory, finds where stored members begin from their local headers, reads the index member alone, and then fetches single records by byte
ranges. Members that are compressed as a whole can't be read by ranges and raise an error.

Files are opened through pyarrow's file systems by URI, so a folder may be in any store that these reach. A task writes to a name of its own
and moves the finished file to its place, so a task that runs again replaces its file as a whole.

Defined cases: null html is an empty payload, null url a urn made from the id. Null page ids are written and come back as null; repeated ids
are records of their own. Pages with equal payloads: the one with the largest id is the response, others
are revisits of it (of repeated rows with that id all are responses); a null id is a revisit if another has an id, else a response. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import common

DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
#: Fixed values of the ZIP format: signatures of its records, and the limits from which ZIP64 fields are needed.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
#: Index bytes that are read at once.
INDEX_BLOCK = 1 << 20
#: Digests of repeated bodies that are sent to all executors at most (about 100 bytes each); beyond it the join shuffles.
BROADCAST_DIGESTS = 200_000
#: Archive bytes whose records one task reads back.
READ_BYTES = 16 << 20


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header but no payload."""
    name = f"urn:page:{'null' if page_id is None else page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Target-URI: {(url or name).replace(chr(13), '').replace(chr(10), '')}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


class ZipWriter:
    """Writes stored members one after the other. Sizes and checksums of a streamed member stand in a data descriptor and in the directory; ZIP64 fields are used where needed, or always if asked for."""

    def __init__(self, sink, zip64: bool = False):
        self.sink, self.at, self.members, self.zip64 = sink, 0, [], zip64

    def write(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.start, self.crc = name.encode(), self.at, 0
        self.write(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x0808, 0, 0, 0x5821, 0, FULL32, FULL32, len(self.name), 20) + self.name + struct.pack("<HHQQ", 1, 16, 0, 0))
        self.body = self.at

    def add(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self.write(data)

    def end(self) -> None:
        size = self.at - self.body
        self.write(struct.pack("<IIQQ", 0x08074B50, self.crc, size, size))
        self.members.append((self.name, self.crc, size, self.start))

    def close(self) -> None:
        start = self.at
        for name, crc, size, offset in self.members:
            wide = self.zip64 or max(size, offset) >= FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if wide else b""
            s, o = (FULL32, FULL32) if wide else (size, offset)
            self.write(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x0808, 0, 0, 0x5821, crc, s, s, len(name), len(extra), 0, 0, 0, 0, o) + name + extra)
        size, n = self.at - start, len(self.members)
        if wide := self.zip64 or start >= FULL32 or size >= FULL32 or n >= FULL16:
            at = self.at
            self.write(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start))
            self.write(struct.pack("<IIQI", LOCATOR64, 0, at, 1))
        self.write(struct.pack("<IHHHHIIH", END, 0, 0, FULL16 if wide else n, FULL16 if wide else n, FULL32 if wide else size, FULL32 if wide else start, 0))


def read_at(source, offset: int, length: int) -> bytes:
    source.seek(offset)
    data = source.read(length)
    if len(data) != length:
        raise ValueError(f"the archive ends before byte {offset + length}")
    return data


def directory(source, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (method, stored size, offset of its local header), from the central directory."""
    tail_size = min(size, 22 + FULL16 + 20)
    tail = read_at(source, size - tail_size, tail_size)
    at = tail.rfind(struct.pack("<I", END))
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(struct.pack("<I", END), 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, at + 10)
    if FULL16 == n or FULL32 in (length, start):
        place = size - tail_size + at - 20
        if place >= 0 and (locator := struct.unpack("<IIQI", read_at(source, place, 20)))[0] == LOCATOR64:
            fields = struct.unpack("<IQHHIIQQQQ", read_at(source, locator[2], 56))
            if fields[0] != END64:
                raise ValueError("no ZIP64 end of central directory")
            n, length, start = fields[7], fields[8], fields[9]
    data, at, out = read_at(source, start, length), 0, {}
    for _ in range(n):
        f = struct.unpack_from("<IHHHHHHIIIHHHHHII", data, at)
        if f[0] != CENTRAL:
            raise ValueError("the central directory is damaged")
        method, stored, plain, names, extras, comments, offset = f[4], f[8], f[9], f[10], f[11], f[12], f[16]
        name = data[at + 46 : at + 46 + names].decode("utf-8", "replace")
        extra = data[at + 46 + names : at + 46 + names + extras]
        e = 0
        while e + 4 <= len(extra):
            kind, own = struct.unpack_from("<HH", extra, e)
            if kind == 1:
                # Only the fields that are full above stand here, in this order.
                wide = iter(struct.unpack_from(f"<{own // 8}Q", extra, e + 4))
                plain = next(wide) if plain == FULL32 else plain
                stored = next(wide) if stored == FULL32 else stored
                offset = next(wide) if offset == FULL32 else offset
            e += 4 + own
        out[name] = (method, stored, offset)
        at += 46 + names + extras + comments
    return out


def located(source, size: int, name: str) -> tuple[int, int]:
    """(offset, length) of a stored member's bytes in the file."""
    method, length, header = directory(source, size)[name]
    if method:
        raise ValueError(f"{name} is compressed as a whole")
    fields = struct.unpack("<IHHHHHIIIHH", read_at(source, header, 30))
    if fields[0] != LOCAL:
        raise ValueError(f"{name} has no local header")
    return header + 30 + fields[9] + fields[10], length


def parse(raw: bytes) -> dict:
    """Fields of one record: id, type, refers_to, digest, payload length, payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda x: None if x is None or x == "<urn:page:null>" else int(x.removeprefix("<urn:page:").removesuffix(">"))
    revisit = fields["warc-type"] == "revisit"
    return {"page_id": number(fields["warc-record-id"]), "record_type": fields["warc-type"], "refers_to": number(fields.get("warc-refers-to")), "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"), "payload_bytes": length, "payload": None if revisit else payload}


def with_originals(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_digests: int = BROADCAST_DIGESTS, salts: int = 16) -> DataFrame:
    """page_id, url, html, refers_to, revisit. Which page is the response is settled from digests alone. The list of repeated digests then goes to the pages, if it has at most broadcast_digests rows; else pages meet it by
    a join in which each digest is dealt over `salts` keys, so that a common body isn't in one task."""
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    slim = slim.withColumns({"sha": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html")})
    again = slim.where(F.col("size") >= least).groupBy("sha", "size").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1 and original is not null").select("sha", "size", "original")
    again = common.saved(again, "repeated")
    if again.count() <= broadcast_digests:
        both = slim.join(F.broadcast(again), ["sha", "size"], "left")
    else:
        again = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        both = slim.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(again, ["sha", "size", "salt"], "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return both.select("page_id", "url", "html", F.when(revisit, F.col("original")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str, least: int = 0, zip64: bool = False, level: int = 1, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes an archive for each partition into folder (a URI on a store that executors share) and returns their paths and sizes (path, size, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = open_store(folder)
        fs.create_dir(root, recursive=True)
        final, own = f"{root}/part-{task.partitionId():06d}.wacz", f"{root}/.part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        index, n = [], 0
        sink = None
        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if sink is None:
                    sink = fs.open_output_stream(own)
                    out = ZipWriter(sink, zip64)
                    out.begin(DATA)
                raw = gzip.compress(record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, revisit), level, mtime=0)
                index.append(json.dumps({"id": page_id, "offset": out.at - out.body, "length": len(raw)}) + "\n")
                out.add(raw)
                n += 1
        if sink is None:
            return
        out.end()
        out.begin(INDEX)
        for i in range(0, n, 1000):
            out.add("".join(index[i : i + 1000]).encode())
        out.end()
        out.begin(PACKAGE)
        out.add(json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": DATA}, {"path": INDEX}]}).encode())
        out.end()
        out.close()
        sink.close()
        fs.move(own, final)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/part-{task.partitionId():06d}.wacz"]), pa.array([out.at], pa.int64()), pa.array([n], pa.int64())], ["path", "size", "records"])

    return common.saved(with_originals(pages, least, id_col, url_col, html_col).transform(common.in_batches, run, "path string, size long, records long"), "archives")


def locate_records(archives: DataFrame) -> DataFrame:
    """(path, offset, length) in the file of each record that the archives' indexes list. Index members are read in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = open_store(path)
                with fs.open_input_file(name) as source:
                    size = source.size()
                    base = located(source, size, DATA)[0]
                    at, left = located(source, size, INDEX)
                    rest = b""
                    while left:
                        block = read_at(source, at, min(INDEX_BLOCK, left))
                        at, left = at + len(block), left - len(block)
                        *lines, rest = (rest + block).split(b"\n")
                        found = [json.loads(x) for x in (lines if left else [*lines, rest]) if x]
                        if found:
                            yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array([base + x["offset"] for x in found], pa.int64()), pa.array([x["length"] for x in found], pa.int64())], ["path", "offset", "length"])

    return archives.select("path").transform(common.in_batches, run, "path string, offset long, length long")


def read_records(ranges: DataFrame, payloads: bool = True) -> DataFrame:
    """The records at the ranges (path, offset, length): page_id, record_type, refers_to, payload_digest, payload_bytes, and payload (null for revisits, or if payloads are not wanted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        try:
            for batch in batches:
                rows, held = [], 0
                for name, offset, length in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                    if name != path:
                        if source:
                            source.close()
                        fs, own = open_store(name)
                        path, source = name, fs.open_input_file(own)
                    row = parse(gzip.decompress(read_at(source, offset, length)))
                    if row["payload"] is not None and digest(row["payload"]) != row["payload_digest"]:
                        raise ValueError(f"{name}: the record at {offset} is damaged")
                    row["payload"] = row["payload"] if payloads else None
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)
        finally:
            if source:
                source.close()

    return ranges.transform(common.in_batches, run, "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def archive_and_read(spark: SparkSession, pages: DataFrame, folder: str, least: int = 0, payloads: bool = False) -> DataFrame:
    """Writes the pages' archives into folder and reads all their records back."""
    archives = write_archives(pages, folder, least)
    tasks = max(1, -(-(archives.agg(F.sum("size")).first()[0] or 0) // READ_BYTES))
    return read_records(locate_records(archives).repartition(tasks, F.col("path"), (F.col("offset") / READ_BYTES).cast("long")).sortWithinPartitions("path", "offset"), payloads)
