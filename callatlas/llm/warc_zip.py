"""WARC records in ZIP packages: written as files, and read back by ranges.

An archive is a ZIP file in the shared folder with three members, stored as they are:
archive/data.warc.gz (one gzip member for each record), indexes/index.cdxj (one line for
each record, with its place in that member) and datapackage.json. A reader takes the end of
the file, follows the ZIP64 locator if there is one, parses the central directory, finds
where the members' data begin, and then asks for records by offset and length, neighbours
together. Nothing is extracted. Digest and length of every payload are computed anew.

Of pages with equal payloads, the one with the largest page_id is a response; the others
are revisits without a payload, which keep the HTTP header and name that response. A payload
that many pages share is looked up in a broadcast table: those of over a hundred-thousandth
of all pages, of which there are fewer than that number. Others meet by a shuffle.

Defined results: a null html is an empty payload. A null page_id is smaller than any other.
Rows that share the largest page_id of a payload are all responses. A null url is an empty
one. Very long pages are single records; an archive with one may be larger than others. An
empty table makes no archive. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ddl, keep, load, record, shared_path

#: An archive is closed after so many bytes of payload.
ARCHIVE_BYTES = 8 << 20
#: Neighbouring records are read together up to so many bytes.
READ_BYTES = 1 << 20
HOT_SHARE, HOT_LEAST = 100_000, 10_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Pages carry no time of capture, and archives should be the same from run to run.
DATE = "2026-01-01T00:00:00Z"
ARCHIVES = [("path", "string"), ("bytes", "long"), ("n_records", "long")]
READ = [("page_id", "long"), ("url", "string"), ("payload", "binary"), ("payload_bytes", "long"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "long")]


def base32_sha1(column: str) -> Column:
    """Base32 of RFC 4648: each 5 bytes are 8 digits of base 32, in another alphabet."""
    digest = F.sha1(F.col(column))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


# --- writing ------------------------------------------------------------------------------------


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def warc_record(page_id, url, payload: bytes, n_bytes: int, digest: str, refers_to, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {quote(url or '', safe=chr(0x21) + '#$&()*+,/:;=?@[]~')}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[tuple[str, bytes]]) -> bytes:
    """A ZIP of (target, WARC record) pairs."""
    data, lines = io.BytesIO(), []
    for target, raw in records:
        at = data.tell()
        data.write(gzip.compress(raw, 6, mtime=0))
        lines.append(f"{target} {json.dumps({'offset': at, 'length': data.tell() - at, 'filename': DATA.rpartition('/')[2]})}\n")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, content in ((DATA, data.getvalue()), (INDEX, "".join(lines).encode()), ("datapackage.json", json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}).encode())):
            with z.open(zipfile.ZipInfo(name, (2026, 1, 1, 0, 0, 0)), "w", force_zip64=True) as member:
                member.write(content)
    return out.getvalue()


def file_system(at: str):
    """(file system, path) of a path or URI, such as file: or hdfs:"""
    from pyarrow import fs

    return fs.FileSystem.from_uri(at)


def write_archive(folder: str, records: list[tuple[str, bytes]]) -> tuple[str, int, int]:
    """(path, bytes, records). A file gets its name when it is whole; those of lost attempts have no row."""
    system, at = file_system(folder)
    system.create_dir(at, recursive=True)
    name, raw = f"{uuid.uuid4().hex}.zip", archive(records)
    with system.open_output_stream(f"{at}/.{name}") as out:
        out.write(raw)
    system.move(f"{at}/.{name}", f"{at}/{name}")
    return f"{folder}/{name}", len(raw), len(records)


def _written(batches, folder: str, most: int):
    held, size = [], 0
    for b in batches:
        made = []
        for page_id, url, html, n, digest, top in zip(*(b.column(c) for c in ("page_id", "url", "html", "n_bytes", "digest", "top")), strict=True):
            page_id, top = page_id.as_py(), top.as_py()
            revisit = page_id != top
            payload = b"" if revisit else html.as_py() or b""
            held.append((f"urn:page:{'' if page_id is None else page_id}", warc_record(page_id, url.as_py(), payload, n.as_py(), digest.as_py(), top, revisit)))
            size += len(payload) + 500
            if size >= most:
                made.append(write_archive(folder, held))
                held, size = [], 0
        if made:
            yield record(ARCHIVES, *map(list, zip(*made, strict=True)))
    if held:
        yield record(ARCHIVES, *([x] for x in write_archive(folder, held)))


def with_response(pages: DataFrame, share: int = HOT_SHARE, least: int = HOT_LEAST) -> DataFrame:
    """(page_id, url, html, n_bytes, digest, top): top is the response's page_id"""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    p = p.withColumn("digest", base32_sha1("html")).withColumn("n_bytes", F.octet_length("html").cast("long"))
    tops = keep(p.groupBy(F.col("digest").alias("of")).agg(F.max("page_id").alias("top"), F.count("*").alias("n")))
    most = max(least, (tops.agg(F.sum("n")).first()[0] or 0) // share)
    hot = tops.filter(F.col("n") > most).select(F.col("of").alias("hot"), F.col("top").alias("hot_top"))
    rows = p.join(F.broadcast(hot), p.digest == hot.hot, "left")
    # rows that are served need no partner; their keys spread them
    key = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.hex(F.xxhash64("page_id", "url"))))
    rows = rows.withColumn("key", key).join(tops.filter(F.col("n") <= most).drop("n"), F.col("key") == F.col("of"), "left")
    return rows.select("page_id", "url", "html", "n_bytes", "digest", F.coalesce("hot_top", "top").alias("top"))


def archives(pages: DataFrame, most: int = ARCHIVE_BYTES) -> DataFrame:
    """(path, bytes, n_records) of the archives of about `most` bytes of payload that hold the pages, written to the shared folder."""
    folder = shared_path(pages.sparkSession)
    return keep(with_response(pages).mapInArrow(lambda b: _written(b, folder, most), ddl(ARCHIVES)))


# --- reading ------------------------------------------------------------------------------------


class Buffer:
    """A source of ranges: bytes at hand."""

    def __init__(self, data: bytes):
        self.data, self.size = memoryview(data), len(data)

    def read(self, offset: int, length: int) -> bytes:
        return bytes(self.data[offset : offset + length])


class File:
    """A source of ranges: a file or anything that seeks."""

    def __init__(self, handle):
        self.handle = handle
        self.size = handle.seek(0, 2)

    def read(self, offset: int, length: int) -> bytes:
        self.handle.seek(offset)
        return self.handle.read(length)


class Archive:
    """The members of a ZIP as (offset of the data, length), found without reading them."""

    def __init__(self, source):
        self.source = source
        tail_at = max(0, source.size - (22 + 0xFFFF + 20))
        tail = source.read(tail_at, source.size - tail_at)
        end = tail.rfind(b"PK\5\6")
        if end < 0:
            raise ValueError("no end of central directory: this isn't a ZIP file")
        n, size, at = struct.unpack_from("<HII", tail, end + 10)
        stop = tail_at + end  # where the directory, or the ZIP64 record after it, ends
        locator = end - 20
        if locator >= 0 and tail[locator : locator + 4] == b"PK\6\7":
            (where,) = struct.unpack_from("<Q", tail, locator + 8)
            big = source.read(where, 56)
            if big[:4] != b"PK\6\6":  # bytes before the archive: the record is right before its locator
                where = tail_at + locator - 56
                big = source.read(where, 56)
            if big[:4] != b"PK\6\6":
                raise ValueError("the ZIP64 locator points at no ZIP64 record")
            n, size, at = struct.unpack_from("<QQQ", big, 32)
            stop = where
        elif n == 0xFFFF or 0xFFFFFFFF in (size, at):
            raise ValueError("ZIP64 values without a ZIP64 record")
        #: offsets count from here
        self.base = stop - size - at
        if self.base < 0:
            raise ValueError("broken central directory")
        self.entries: dict[str, tuple[int, int, int]] = {}
        self._directory(source.read(self.base + at, size), n)

    def _directory(self, raw: bytes, n: int) -> None:
        at = 0
        for _ in range(n):
            if raw[at : at + 4] != b"PK\1\2":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            packed, full = struct.unpack_from("<II", raw, at + 20)
            n_name, n_extra, n_comment = struct.unpack_from("<HHH", raw, at + 28)
            (header,) = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
            wide = self._zip64(extra)
            # the field holds, in this order, only those values that don't fit above
            if full == 0xFFFFFFFF:
                full = next(wide)
            if packed == 0xFFFFFFFF:
                packed = next(wide)
            if header == 0xFFFFFFFF:
                header = next(wide)
            self.entries[name] = (header, packed, method)
            at += 46 + n_name + n_extra + n_comment

    @staticmethod
    def _zip64(extra: bytes) -> Iterator[int]:
        at = 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                yield from struct.unpack_from(f"<{n // 8}Q", extra, at + 4)
            at += 4 + n

    def locate(self, name: str) -> tuple[int, int]:
        header, size, method = self.entries[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; only stored members have ranges")
        header += self.base
        local = self.source.read(header, 30)
        if local[:4] != b"PK\3\4":
            raise ValueError(f"no local header for {name}")
        n_name, n_extra = struct.unpack_from("<HH", local, 26)
        return header + 30 + n_name + n_extra, size

    def index(self) -> Iterator[tuple[str, int, int]]:
        at, size = self.locate(INDEX)
        for line in self.source.read(at, size).decode().splitlines():
            target, _, rest = line.partition(" ")
            place = json.loads(rest)
            yield target, place["offset"], place["length"]

    def records(self) -> Iterator[bytes]:
        base, size = self.locate(DATA)
        run: list[tuple[int, int]] = []
        for _, offset, length in self.index():
            if offset + length > size:
                raise ValueError("an index line points past the end of its member")
            if run and (offset != sum(run[-1]) or offset + length - run[0][0] > READ_BYTES):
                yield from self._ranges(base, run)
                run = []
            run.append((offset, length))
        yield from self._ranges(base, run)

    def _ranges(self, base: int, run: list[tuple[int, int]]) -> Iterator[bytes]:
        """Records that follow each other, by one read."""
        if run:
            raw, at = self.source.read(base + run[0][0], sum(run[-1]) - run[0][0]), run[0][0]
            for offset, length in run:
                yield gzip.decompress(raw[offset - at : offset - at + length])


def page_of(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def parse_record(raw: bytes) -> tuple:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("this isn't a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind = fields["WARC-Type"]
    revisit = kind == "revisit"
    if not revisit and len(payload) != stated:
        raise ValueError("a payload is shorter than its header says")
    refers, digest = page_of(fields.get("WARC-Refers-To")), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError("a payload doesn't give its digest")
    return page_of(fields["WARC-Record-ID"]), unquote(fields["WARC-Target-URI"]), None if revisit else payload, stated, digest, kind, refers


def _read(batches):
    for b in batches:
        for at in b.column("path").to_pylist():
            system, path = file_system(at)
            rows, size = [], 0
            with system.open_input_file(path) as handle:
                for raw in Archive(File(handle)).records():
                    rows.append(parse_record(raw))
                    size += len(raw)
                    if size > ARCHIVE_BYTES:
                        yield record(READ, *map(list, zip(*rows, strict=True)))
                        rows, size = [], 0
            if rows:
                yield record(READ, *map(list, zip(*rows, strict=True)))


def read_archives(stored: DataFrame) -> DataFrame:
    """The records of the archives at `path`. Archives are dealt evenly to tasks, as their paths are few bytes and much work."""
    n, least = stored.count(), int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored.select("path").repartition(max(1, min(n, max(least, n // 16)))).mapInArrow(_read, ddl(READ))


def op6_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = archives(load(spark, sf_dir, "pages"))
    return read_archives(stored).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGITS = "list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * bits[5 * i + 1] + 8 * bits[5 * i + 2] + 4 * bits[5 * i + 3] + 2 * bits[5 * i + 4] + bits[5 * i + 5], 1))"
ORACLE = f"""
WITH hashed AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
bits_of AS (
  SELECT *, flatten(list_transform(range(40), lambda j: list_transform([8, 4, 2, 1],
           lambda v: CAST((instr('0123456789abcdef', substr(hex, CAST(j + 1 AS BIGINT), 1)) - 1) // v % 2 AS BIGINT)))) AS bits FROM hashed),
digest_of AS (SELECT page_id, payload_bytes, array_to_string({_DIGITS}, '') AS payload_digest FROM bits_of),
top_of AS (SELECT payload_digest AS d, max(page_id) AS top FROM digest_of GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM digest_of JOIN top_of ON payload_digest = d
"""
