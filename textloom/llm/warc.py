"""WARC archives: a writer with revisit records and a salvage reader.

Writing: records whose payload digest was seen at a smaller id become revisits. Each task writes gzip members, one a record, to
files of its own in the shared folder and returns a manifest; files of lost attempts are in no manifest.

Reading: a member counts when its gzip check, its version line, its Content-Length and its payload digest hold. After a failed check the
reader looks for the next gzip member (or, in plain archives, the next version line) that holds, goes on from there, and logs the bytes
between as a quarantined gap with its reason. It streams: memory is one record and two read blocks. A plain record's length is believed only
if the record's end stands where it says, which is looked up in the file before the block is read.

Cases: null html is an empty payload; null url becomes ``about:blank``; rows without id are written with an empty id; repeated rows with
the smallest id of a payload are all responses; extra columns are ignored; an empty table makes no archive and no record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import work

#: Compressed bytes after which a task begins another archive.
ROLL_BYTES = 32 << 20
LEVEL = 3
READ_BYTES = 1 << 20
#: Records whose payload is smaller are never revisits.
MIN_REVISIT_BYTES = 0
DATE = "2000-01-01T00:00:00Z"
ID = "urn:textloom:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
MARK = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
#: Bytes of header that are read before a record counts as broken.
MOST_HEADER = 1 << 16
#: Bytes of a gzip member after which it is broken if nothing was unpacked: a false start may look like a name without end.
MOST_SILENT = 1 << 13
END = b"\r\n\r\n"


def digest(payload: bytes) -> str:
    return base32(hashlib.sha1(payload).hexdigest())


def base32(sha1: str) -> str:
    """A hexadecimal digest in upper-case base 32."""
    return base64.b32encode(bytes.fromhex(sha1)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit keeps the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"
    name = lambda i: f"<{ID}{'' if i is None else i}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{sha1}",
        *([f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Broken(ValueError):
    """A record that fails a check."""


def header(data: bytes | bytearray, at: int = 0, more: bool = False) -> tuple[dict, int]:
    """The fields of the record header at ``at`` and where its block begins; raises Broken, or EOFError if it is cut and ``more`` may come."""
    if not VERSION.match(data, at):
        if more and len(data) - at < 10:
            raise EOFError
        raise Broken("no version line")
    end = data.find(END, at, at + MOST_HEADER)
    if end < 0:
        if more and len(data) - at < MOST_HEADER:
            raise EOFError
        raise Broken("no end of header")
    head = {}
    for line in bytes(data[at:end]).split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            raise Broken("bad header line")
        head[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"[0-9]{1,18}", head.get("content-length", "")):
        raise Broken("no content length")
    return head, end + 4


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` of ``data`` and where it ends; raises Broken."""
    head, begin = header(data, at)
    stop = begin + int(head["content-length"])
    if stop + 4 > len(data):
        raise Broken("record cut short")
    if data[stop : stop + 4] != END:
        raise Broken("wrong content length")
    return _checked(head, bytes(data[begin:stop])), stop + 4


def _checked(head: dict, block: bytes) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^Content-Length:\s*(\d+)", http)
    sha1 = head.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = head.get("warc-type", "")
    if kind == "response" and sha1 and digest(payload) != sha1:
        raise Broken("wrong payload digest")
    page = lambda k: int(m[1]) if (m := re.fullmatch(rf"<{ID}(-?\d+)>", head.get(k, ""))) else None
    return {
        "page_id": page("warc-record-id"), "url": head.get("warc-target-uri"), "record_type": kind, "payload_digest": sha1, "refers_to": page("warc-refers-to"),
        "payload_bytes": len(payload) if kind == "response" else int(length[1]) if length else 0, "payload": payload,
    }


class Stream:
    """A seekable file's bytes; ``data`` holds them from ``base`` on, and ``at`` is the place in ``data`` that is read next."""

    def __init__(self, source):
        self.source, self.data, self.at, self.base, self.done = source, bytearray(), 0, 0, False

    def more(self) -> bool:
        block = b"" if self.done else self.source.read(READ_BYTES)
        self.done = not block
        self.data += block
        return not self.done

    def has(self, n: int) -> bool:
        """Whether ``n`` bytes from ``at`` on are there; reads what is needed."""
        while len(self.data) - self.at < n and self.more():
            pass
        return len(self.data) - self.at >= n

    def peek(self, far: int, n: int) -> bytes:
        """``n`` bytes that begin ``far`` after ``at``, without holding those between."""
        if self.at + far + n <= len(self.data):
            return bytes(self.data[self.at + far : self.at + far + n])
        back = self.source.tell()
        self.source.seek(self.base + self.at + far)
        found = self.source.read(n)
        self.source.seek(back)
        return found

    def skip(self, n: int) -> None:
        """Goes on by ``n``; bytes that are past go once a read block of them is there."""
        self.at += n
        if self.at >= READ_BYTES:
            del self.data[: self.at]
            self.base, self.at = self.base + self.at, 0

    @property
    def place(self) -> int:
        return self.base + self.at


def _member(stream: Stream) -> tuple[bytes, int]:
    """The gzip member at the stream's place, unpacked, and its packed length."""
    z, out, fed, size = zlib.decompressobj(31), [], stream.at, 256
    while not z.eof:
        if fed == len(stream.data) and not stream.more():
            raise Broken("member cut short")
        block = bytes(stream.data[fed : fed + size])
        fed, size = fed + len(block), min(2 * size, READ_BYTES)  # a false start mostly shows at once
        try:
            out.append(z.decompress(block))
        except zlib.error as e:
            raise Broken(f"gzip: {str(e)[:60]}") from None
        if not any(out) and fed - stream.at > MOST_SILENT:
            raise Broken("gzip: no data after the header")
        if not out[-1]:
            out.pop()
    return b"".join(out), fed - len(z.unused_data) - stream.at


def _next(stream: Stream) -> tuple[list[dict], int]:
    """The records of the next member, or the next plain record, and its length; raises Broken."""
    stream.has(10)
    if stream.data.startswith(MAGIC, stream.at):
        data, n = _member(stream)
        found, at = [], 0
        while at < len(data):
            one, at = parse(data, at)
            found.append(one)
        return found, n
    while True:
        try:
            head, begin = header(stream.data, stream.at, not stream.done)
            break
        except EOFError:
            stream.more()
    begin -= stream.at
    size = int(head["content-length"])
    if stream.peek(begin + size, 4) != END:
        raise Broken("wrong content length")
    stream.has(begin + size + 4)
    return [_checked(head, bytes(stream.data[stream.at + begin : stream.at + begin + size]))], begin + size + 4


def _find(stream: Stream) -> None:
    """Goes on to the next place that may begin a record, or to the end."""
    while True:
        found = MARK.search(stream.data, stream.at)
        if found:
            at = found.start()
            del found  # a match holds the buffer
            return stream.skip(at - stream.at)
        stream.skip(max(0, len(stream.data) - stream.at - 9))  # the last bytes may begin a mark
        if not stream.more():
            return stream.skip(len(stream.data) - stream.at)


def salvage(source) -> Iterator[tuple[str, dict]]:
    """Yields ``("record", fields)`` and ``("gap", {start, end, reason})`` in file order from a seekable file."""
    stream, gap, reason = Stream(source), None, ""
    while stream.has(1):
        try:
            found, n = _next(stream)
        except Broken as e:
            if gap is None:
                gap, reason = stream.place, str(e)
            stream.skip(1)
            _find(stream)
            continue
        if gap is not None:
            yield "gap", {"start": gap, "end": stream.place, "reason": reason}
            gap = None
        stream.skip(n)
        yield from (("record", x) for x in found)
    if gap is not None:
        yield "gap", {"start": gap, "end": stream.place, "reason": reason}


_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_READ = pa.schema([("kind", pa.string()), ("path", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("gap_start", pa.int64()), ("gap_end", pa.int64()), ("reason", pa.string())])
_READ_DDL = "kind string, path string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, gap_start long, gap_end long, reason string"


def _write(folder: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def files():
            store, top = fs.FileSystem.from_uri(folder)
            store.create_dir(top, recursive=True)
            out, name, records, size = None, "", 0, 0
            for part in work.pieces(parts):
                for page_id, url, sha1, head, revisit, html in zip(*(c.to_pylist() for c in part.columns[:-1]), work.utf8(part.columns[-1]), strict=True):
                    if out is None:
                        name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = store.open_output_stream(f"{top}/{name}", compression=None)
                    data = member(record(page_id, url, html, base32(sha1), head, revisit))
                    out.write(data)
                    records, size = records + 1, size + len(data)
                    if size >= ROLL_BYTES:
                        out.close()
                        out = None
                        yield f"{folder}/{name}", records, size
            if out is not None:
                out.close()
                yield f"{folder}/{name}", records, size

        yield from work.batches(_MANIFEST, files())

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes a record for each page to archives under ``folder``; returns the manifest (path, records, bytes)."""
    own = work.spread(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", work.text_of("html").alias("html")))
    hashed = own.withColumn("sha1", F.sha1("html"))
    heads = hashed.where(F.octet_length("html") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("head"))
    revisit = F.coalesce(F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head")), F.lit(False))
    decided = hashed.join(heads, "sha1", "left").select("page_id", "url", "sha1", "head", revisit.alias("revisit"), "html")
    return work.keep(decided.mapInArrow(_write(folder), "path string, records long, bytes long"), "warc-manifest")[0]


def _read(payloads: bool):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in work.pieces(parts):
                for path in part.column(0).to_pylist():
                    store, name = fs.FileSystem.from_uri(path)
                    with store.open_input_file(name) as source:
                        for kind, x in salvage(source):
                            if kind == "gap":
                                yield kind, path, None, None, None, None, None, None, None, x["start"], x["end"], x["reason"]
                            else:
                                yield kind, path, x["page_id"], x["url"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"], x["payload"] if payloads else None, None, None, None

        yield from work.batches(_READ, rows())

    return run


def read_archives(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps of the archives named in column ``path``, which are dealt out evenly to as many tasks as shuffles have."""
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return paths.select("path").repartition(n).mapInArrow(_read(payloads), _READ_DDL)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """The contract's query: writes ``pages`` to archives, then reads them back."""
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), work.work_path(spark, "warc"))
    return read_archives(manifest, payloads=False).where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages
), q AS (
  SELECT page_id, strlen(h) AS payload_bytes,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST('0x' || substr(x, CAST(5 * i // 4 AS INT) + 1, 2) AS INT) >> CAST(3 - 5 * i % 4 AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
         min(page_id) OVER (PARTITION BY h) AS head
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> head THEN head END AS refers_to
FROM q
"""
