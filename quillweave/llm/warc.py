"""Legacy archives (ARC) to WARC.

``write_arc`` makes ARC archives of a table of pages, gzip members of one record each as crawlers wrote them, in the
two versions of the format; ``convert`` reads any such archives and writes one WARC beside each; ``read_warc`` reads
the results back.

The converter never moves payloads between tasks. A first pass reads header lines and declared lengths and makes an
index (file, offset, payload digest); the index, a few bytes a record, is grouped by digest to find which records
repeat another's payload; a second pass streams each archive once more and writes its WARC file. Files are written
under a task's own name and renamed, so that a task that runs again leaves the same file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, filesystem, scratch, table

#: Uncompressed bytes after which a task starts another archive.
ARCHIVE_BYTES = 256 << 20
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_FIELDS = {
    "1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    "2": ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}


class Record(NamedTuple):
    offset: int  # of the gzip member, or of the header line in an archive that isn't compressed
    fields: dict[str, str]  # of the header line, by the names that the archive's version gives
    block: bytes  # of the declared length


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def members(read, size: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of each gzip member of a stream; of the whole, in pieces, if it isn't compressed."""
    at, start, chunk = 0, 0, read(size)
    if chunk[:2] != b"\x1f\x8b":
        while chunk:
            yield start, chunk
            start += len(chunk)
            chunk = read(size)
        return
    while chunk:
        if not chunk.strip(b"\0"):  # padding after the last member
            at, chunk = at + len(chunk), read(size)
            start = at
            continue
        inflate, out = zlib.decompressobj(31), []
        while True:
            out.append(inflate.decompress(chunk))
            at += len(chunk) - len(inflate.unused_data)
            if inflate.eof:
                chunk = inflate.unused_data or read(size)
                break
            chunk = read(size)
            if not chunk:
                raise ValueError(f"the member at {start} is cut off")
        yield start, b"".join(out)
        start = at


class _Bytes:
    """Lines and counts of bytes from members; knows at which member's offset a record starts."""

    def __init__(self, read):
        self.source, self.compressed = members(read), False
        self.buffer, self.base, self.used = b"", 0, 0

    def fill(self) -> bool:
        piece = next(self.source, None)
        if piece is None:
            return False
        if self.used >= len(self.buffer):
            self.base, self.buffer, self.used = piece[0], piece[1], 0
        else:
            self.buffer, self.base, self.used = self.buffer[self.used :] + piece[1], self.base + (0 if self.compressed else self.used), 0
        return True

    def line(self) -> bytes | None:
        while (end := self.buffer.find(b"\n", self.used)) < 0:
            if not self.fill():
                return None
        out, self.used = self.buffer[self.used : end], end + 1
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.used < n:
            if not self.fill():
                raise ValueError(f"a record of {n} bytes is cut off")
        out, self.used = self.buffer[self.used : self.used + n], self.used + n
        return out


def arc_records(read, compressed: bool = True) -> Iterator[Record]:
    """The records of an ARC stream; its first, the version block, names the fields of the header lines after it."""
    data = _Bytes(read)
    data.compressed = compressed
    names = _FIELDS["1"]
    while True:
        if data.used >= len(data.buffer) and not data.fill():
            return
        offset = data.base if compressed else data.base + data.used
        line = data.line()
        if line is None:
            return
        if not line.strip():
            continue
        values = line.decode("utf-8", "replace").rstrip("\r").split(" ")
        first = values[0].startswith("filedesc:")
        fields = dict(zip(_FIELDS["1"] if first and len(values) == 5 else _FIELDS["2"] if first else names, values))
        block = data.take(int(values[-1]))
        if first:
            version = block.split(b"\n", 2)
            names = version[1].decode().split() if len(version) > 1 and version[1].strip() else _FIELDS[block[:1].decode()]
        yield Record(offset, fields, block)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(head with its empty line, payload) of an HTTP response; (nothing, all) of any other block."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    m = re.search(rb"\r?\n\r?\n", block)
    return (block[: m.end()], block[m.end() :]) if m else (block, b"")


def http_field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace").strip() if m else None


def record_id(archive: str, offset: int, kind: str = "record") -> str:
    """The same for every conversion of the same archive."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{archive}/{offset}/{kind}')}>"


def warc_date(arc: str) -> str:
    """ISO 8601 of an ARC date of 14 digits, or of 12 to 4 with the rest as small as it can be; else the epoch."""
    d = re.sub(r"\D", "", arc)[:14]
    if len(d) < 4:
        return "1970-01-01T00:00:00Z"
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip(data: bytes) -> bytes:
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


class _Sink:
    """A file that appears under its name when it is whole."""

    def __init__(self, folder: str, name: str):
        self.fs, root = filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        self.temporary, self.final = f"{root}/.{name}.{task.taskAttemptId() if task else 0}", f"{root}/{name}"
        self.out, self.at = self.fs.open_output_stream(self.temporary), 0

    def write(self, member: bytes) -> int:
        self.out.write(member)
        self.at += len(member)
        return self.at - len(member)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.final)


def _write_arc(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, sink, raw = TaskContext.get().partitionId(), 0, None, 0
        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "html")]
            for page, url, html in zip(*cols):
                page, url, payload = page.as_py(), url.as_py(), (html.as_py() or "").encode()
                if sink is None:
                    # Both versions of the format occur in old crawls, and so do they here.
                    version, name = "21"[part % 2], f"part-{part:05d}-{n:04d}.arc.gz"
                    sink = _Sink(folder, name)
                    text = f"{version} 0 pages\n{' '.join(_FIELDS[version])}\n".encode()
                    more = f" 200 - - 0 {name}" if version == "2" else ""
                    sink.write(gzip(f"filedesc://{name} 0.0.0.0 20000101000000 text/plain{more} {len(text)}\n".encode() + text + b"\n"))
                row = "" if page is None else f"X-Row-Id: {page}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{row}\r\n"
                block = head.encode() + payload
                where = re.sub(r"\s", lambda m: "".join(f"%{x:02X}" for x in m[0].encode()), url or "") or "about:blank"
                more = f" 200 {hashlib.md5(payload).hexdigest()} - {sink.at} {name}" if version == "2" else ""
                sink.write(gzip(f"{where} 0.0.0.0 20000101000000 text/html{more} {len(block)}\n".encode() + block + b"\n"))
                raw += len(block)
                if raw >= ARCHIVE_BYTES:
                    sink.close()
                    yield pa.record_batch([pa.array([name])], ["file"])
                    sink, raw, n = None, 0, n + 1
        if sink is not None:
            sink.close()
            yield pa.record_batch([pa.array([name])], ["file"])

    return run


def write_arc(pages: DataFrame, folder: str) -> list[str]:
    """ARC archives of every row of pages (page_id, url, html) below folder; their names."""
    return sorted(x.file for x in pages.select("page_id", "url", "html").transform(arrow, _write_arc(folder), "file string").collect())


def _index(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in batches:
            for number, name in zip(batch.column("number").to_pylist(), batch.column("file").to_pylist()):
                rows = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for r in arc_records(f.read, name.endswith(".gz")):
                        if r.fields["URL"].startswith("filedesc:"):
                            continue
                        head, payload = split_http(r.block)
                        row = http_field(head, "X-Row-Id")
                        rows.append((number, name, r.offset, None if row is None else int(row), len(payload), digest(payload)))
                if rows:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["number", "file", "offset", "row_id", "payload_bytes", "payload_digest"])

    return run


def _convert(folder: str, to: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        name, records, sink, source = None, None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if sink is not None:
                source.close()
                sink.close()
                yield pa.record_batch([pa.array([sink.final.rpartition("/")[2]])], ["file"])

        for batch in batches:
            for file, offset, ref_file, ref_offset, ref_row in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "ref_file", "ref_offset", "ref_row"))):
                if file != name:
                    yield from done()
                    name = file
                    source = fs.open_input_stream(f"{root}/{file}", compression=None)
                    records = arc_records(source.read, file.endswith(".gz"))
                    sink = _Sink(to, re.sub(r"\.arc(\.gz)?$", "", file) + ".warc.gz")
                while (r := next(records)).offset != offset:
                    if r.fields["URL"].startswith("filedesc:"):
                        info = f"software: quillweave\r\nformat: WARC File Format 1.1\r\nconverted-from: {file}\r\n".encode()
                        sink.write(gzip(warc_record("warcinfo", [("WARC-Record-ID", record_id(file, r.offset)), ("WARC-Date", warc_date(r.fields["Archive-date"])), ("WARC-Filename", sink.final.rpartition("/")[2]), ("Content-Type", "application/warc-fields")], info)))
                head, payload = split_http(r.block)
                common = [("WARC-Record-ID", record_id(file, offset)), ("WARC-Date", warc_date(r.fields["Archive-date"])), ("WARC-Target-URI", r.fields["URL"]), ("WARC-IP-Address", r.fields["IP-address"]), ("WARC-Payload-Digest", "sha1:" + digest(payload))]
                kind = ("Content-Type", "application/http; msgtype=response" if head else r.fields["Content-type"])
                if ref_file is not None:
                    common += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(ref_file, ref_offset))]
                    common += [] if ref_row is None else [("WARC-X-Refers-To-Row", str(ref_row))]
                    sink.write(gzip(warc_record("revisit", [*common, ("WARC-Block-Digest", "sha1:" + digest(head)), kind], head)))
                else:
                    sink.write(gzip(warc_record("response" if head else "resource", [*common, ("WARC-Block-Digest", "sha1:" + digest(r.block)), kind], r.block)))
        yield from done()

    return run


def _files(spark: SparkSession, names: list[str]) -> DataFrame:
    """number, file of the archives, each in a partition of its own."""
    return spark.createDataFrame(list(enumerate(names)), "number int, file string").repartitionById(max(1, len(names)), "number")


def convert(spark: SparkSession, folder: str, names: list[str], to: str, min_bytes: int = 0) -> list[str]:
    """Writes a WARC file below to for each ARC file below folder; their names.

    HTTP records become response, others resource. Of records with equal payloads of at least min_bytes, that with the
    smallest row id (X-Row-Id of the HTTP head; those without come last, then by file and offset) is whole and the
    others are revisit records of it, with the HTTP head as block.
    """
    home = scratch(spark, "cdx")
    schema = "number int, file string, offset long, row_id long, payload_bytes long, payload_digest string"
    index = table(_files(spark, names).transform(arrow, _index(folder), schema), f"{home}/index")
    first = F.min(F.struct(F.col("row_id").isNull(), F.col("row_id").alias("ref_row"), F.col("file").alias("ref_file"), F.col("offset").alias("ref_offset")))
    groups = index.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(first.alias("f"), F.count("*").alias("n"))
    groups = groups.where("n > 1").select("payload_digest", "payload_bytes", "f.ref_row", "f.ref_file", "f.ref_offset")
    plan = index.join(groups, ["payload_digest", "payload_bytes"], "left")
    itself = (F.col("file") == F.col("ref_file")) & (F.col("offset") == F.col("ref_offset"))
    ref = [F.when(~F.coalesce(itself, F.lit(True)), F.col(c)).alias(c) for c in ("ref_file", "ref_offset", "ref_row")]
    # One task streams one whole archive in order: by its number, as hashes of names leave some tasks empty and give others several.
    plan = plan.select("number", "file", "offset", *ref).repartitionById(max(1, len(names)), "number").drop("number").sortWithinPartitions("offset")
    return sorted(x.file for x in plan.transform(arrow, _convert(folder, to), "file string").collect())


def warc_records(read) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a WARC stream with a gzip member for each."""
    for _, member in members(read):
        head, _, rest = member.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        names = ["page_id", "url", "record_id", "date", "payload_bytes", "payload_digest", "record_type", "refers_to", "file"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for h, block in warc_records(f.read):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        head, payload = split_http(block)
                        revisit, ref, row = h["WARC-Type"] == "revisit", h.get("WARC-X-Refers-To-Row"), http_field(head, "X-Row-Id")
                        said = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not revisit and digest(payload) != said:
                            raise ValueError(f"{name}: {h['WARC-Record-ID']} has another digest than it says")
                        n = int(http_field(head, "Content-Length") or 0) if revisit else len(payload)
                        rows.append((None if row is None else int(row), h["WARC-Target-URI"], h["WARC-Record-ID"], h["WARC-Date"], n, said, h["WARC-Type"], None if ref is None else int(ref), name))
                if rows:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    return run


def read_warc(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """page_id, url, record_id, date, payload_bytes, payload_digest, record_type, refers_to, file of each record."""
    schema = "page_id long, url string, record_id string, date string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"
    return _files(spark, names).transform(arrow, _read(folder), schema)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages (page_id, url, html) to ARC, converted to WARC, read back: a row of read_warc for every row of pages.

    A null html is an empty payload; a null or empty url is about:blank; white space in urls is escaped. A null
    page_id comes last among equal payloads and gives null. Repeated rows are separate records: the first response,
    the others revisit it. A very long page is one record. An empty table gives an empty result. Other columns, of
    whatever name, are ignored.
    """
    spark, home = pages.sparkSession, scratch(pages.sparkSession, "warc")
    arcs = write_arc(pages, f"{home}/arc")
    warcs = convert(spark, f"{home}/arc", arcs, f"{home}/warc", min_bytes)
    return read_warc(spark, f"{home}/warc", warcs)


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), bits AS (
  SELECT *, array_to_string([substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', substr(hex, i, 1)) - 3, 4) FOR i IN range(1, 41)], '') AS bits FROM p
), named AS (
  SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, i, 1)::INTEGER + 8 * substr(bits, i + 1, 1)::INTEGER
    + 4 * substr(bits, i + 2, 1)::INTEGER + 2 * substr(bits, i + 3, 1)::INTEGER + substr(bits, i + 4, 1)::INTEGER, 1) FOR i IN range(1, 157, 5)], '') AS payload_digest,
    min(page_id) OVER (PARTITION BY hex) AS first FROM bits
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM named
"""
