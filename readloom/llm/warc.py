"""WARC archives as a PySpark Python data source.

``spark.read.format("warc")`` reads a file or a folder of ``.warc`` and ``.warc.gz`` files, whoever wrote them: one partition
for each file, or, where a manifest of the writer below tells record starts, for each segment of one. It takes predicates on
record type and other header columns, parses a record's headers first, and skips the payload of records that don't pass, or
of all with option ``payload=false``. A gzip member that tells its compressed size in the extra field "sl", as the writer's
do, is skipped by a seek, as are plain records; other members are inflated and discarded. A member may hold any number of
records. Header names are read in any case, folded lines are joined, bytes that are no UTF-8 are replaced. The payload of an
HTTP record is its body, of others the block. With ``verify=true`` payloads of response records are held against their
SHA-1 digest, and a mismatch fails the read.

``df.write.format("warc")`` writes a file for each task and, on commit, a manifest with the files of the tasks that
succeeded and with segment starts; the files of lost or repeated tasks are not in it. Paths are opened with pyarrow's file
systems, by their scheme.

Deduplication: of records with equal payloads of at least ``min_payload`` bytes, that with the largest id is a response,
the others revisit it. Defined results: a null payload is empty; rows repeated with the largest id are all responses; null
ids are least; a null URL leaves out its header; an empty table makes an archive without records; payloads may have any
length that a row can.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from readloom.llm.common import scratch_path, table

SEGMENT_BYTES = 8 << 20
MANIFEST = "manifest.json"
READ_BYTES = 1 << 16
BATCH_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
URN = "urn:record:"
SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, content_type string, payload_digest string, payload_length long, "
    "refers_to string, payload binary"
)
_HEADERS = SCHEMA.removesuffix(", payload binary")


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, kind: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record, not compressed; a revisit has no payload."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE)]
    if uri is not None:
        fields.append(("WARC-Target-URI", quote(uri, safe="%/:=&?~#+!$,;'@()*[]")))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(len(payload)))]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    else:
        body += payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member with its own size in the extra field "sl", if 32 bits hold it."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    packed = deflate.compress(raw) + deflate.flush()
    size = 24 + len(packed) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(raw)) if max(size, len(raw)) < 1 << 32 else b"\x1f\x8b\x08\0\0\0\0\0\0\xff"
    return head + packed + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


@dataclass
class Segment(InputPartition):
    path: str
    start: int
    end: int
    packed: bool = True


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    starts: list[int]
    size: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = _file_system(self.path)
        fs.create_dir(base, recursive=True)
        name, starts, size, out = f"part-{uuid.uuid4().hex}.warc.gz", [0], 0, None
        try:
            for batch in iterator:
                for at in range(0, batch.num_rows, 64):
                    for r in batch.slice(at, 64).to_pylist():
                        out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
                        if size - starts[-1] >= SEGMENT_BYTES:
                            starts.append(size)
                        own = member(record(r["record_id"], r["record_type"], r["target_uri"], r["payload"] or b"", r["payload_digest"], r["refers_to"]))
                        out.write(own)
                        size += len(own)
        finally:
            if out:
                out.close()
        return Written(name if out else None, starts, size)

    def commit(self, messages: list[Written]) -> None:
        fs, base = _file_system(self.path)
        fs.create_dir(base, recursive=True)
        files = [{"file": m.file, "starts": m.starts, "size": m.size} for m in messages if m and m.file]
        with fs.open_output_stream(f"{base}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[Written]) -> None:
        fs, base = _file_system(self.path)
        for m in messages:
            if m and m.file:
                fs.delete_file(f"{base}/{m.file}")


def parse_header(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with white space goes on with the one before."""
    found, name = {}, None
    for line in head.decode(errors="replace").replace("\r\n", "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


class _Source:
    """Bytes of a file from ``start`` to ``end``, of its gzip members one after the other if it is ``packed``."""

    def __init__(self, stream, start: int, end: int, packed: bool):
        self.stream, self.at, self.end, self.packed = stream, start, end, packed
        self.held, self.inflate, self.next_member = b"", None, None
        stream.seek(start)

    def _feed(self) -> bytes:
        data = self.stream.read(min(READ_BYTES, self.end - self.at))
        self.at += len(data)
        return data

    def _more(self) -> bool:
        """More bytes in ``held``; False at the end."""
        if not self.packed:
            data = self._feed()
            self.held += data
            return bool(data)
        while True:
            if self.inflate is None or self.inflate.eof:
                first = self.inflate.unused_data if self.inflate else b""
                while len(first) < 24 and (data := self._feed()):
                    first += data
                first = first.lstrip(b"\0") if first[:2] != b"\x1f\x8b" else first  # padding between members
                if not first:
                    return False
                size = struct.unpack_from("<I", first, 16)[0] if first[3:4] == b"\x04" and first[12:14] == b"sl" and len(first) >= 24 else None
                self.next_member = self.at - len(first) + size if size else None
                self.inflate, data = zlib.decompressobj(31), first
            else:
                data = self._feed()
                if not data:
                    raise ValueError("a gzip member is cut off")
            found = self.inflate.decompress(data)
            if found:
                self.held += found
                return True

    def head(self, most: int | None = None) -> bytes:
        """What stands before the next empty line, which is taken as well; all there is, up to ``most``, if there is none."""
        seen = 0
        while True:
            ends = [(i, n) for mark, n in ((b"\r\n\r\n", 4), (b"\n\n", 2)) if (i := self.held.find(mark, max(0, seen - 3))) >= 0 and (most is None or i + n <= most)]
            if ends:
                i, n = min(ends)
                found, self.held = self.held[:i], self.held[i + n :]
                self.taken = i + n
                return found
            seen = len(self.held)
            if most is not None and seen >= most or not self._more():
                n = seen if most is None else min(seen, most)
                found, self.held, self.taken = self.held[:n], self.held[n:], n
                return found

    def read(self, n: int) -> bytes:
        parts, need = [], n
        while need:
            if not self.held and not self._more():
                raise ValueError("a record is cut off")
            parts.append(self.held[:need])
            self.held = self.held[need:]
            need -= len(parts[-1])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        if not self.packed and n > len(self.held):
            self.at += n - len(self.held)
            self.held = b""
            if self.at > self.end:
                raise ValueError("a record is cut off")
            self.stream.seek(self.at)
            return
        while n:
            if not self.held and not self._more():
                raise ValueError("a record is cut off")
            taken = min(n, len(self.held))
            self.held, n = self.held[taken:], n - taken

    def records(self) -> Iterator[tuple[dict[str, str], int]]:
        """(header fields, length of the block) of each record; the caller takes as much of the block as it wants, through ``block``."""
        while True:
            self.held = self.held.lstrip(b"\r\n")
            if not self.held:
                alone = self.packed and (self.inflate is None or self.inflate.eof)
                if not self._more():
                    return
                if not self.held.lstrip(b"\r\n"):
                    continue
                self.held = self.held.lstrip(b"\r\n")
            else:
                alone = False
            head = self.head()
            if not head.startswith(b"WARC/"):
                raise ValueError(f"no record where one should begin: {head[:40]!r}")
            fields = parse_header(head)
            self.left = int(fields.get("content-length") or 0)
            yield fields, self.left
            if alone and self.next_member and self.left:  # a member of one record that tells its size
                self.at, self.held, self.inflate = self.next_member, b"", None
                self.stream.seek(self.at)
            else:
                self.skip(self.left)

    def block(self, n: int | None = None) -> bytes:
        n = self.left if n is None else min(n, self.left)
        self.left -= n
        return self.read(n)

    def block_head(self) -> int:
        """The length of the HTTP header that the block begins with, which is taken."""
        self.head(self.left)
        self.left -= self.taken
        return self.taken


def _urn(value: str | None) -> str | None:
    return value.strip().strip("<>") if value else None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.names = options["path"], schema.fieldNames()
        self.with_payload = "payload" in self.names and options.get("payload", "true") == "true"
        self.verify = options.get("verify", "false") == "true"
        self.tests: list[tuple[str, set]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if isinstance(f, EqualTo | In) and name in self.names and name not in ("payload", "payload_length"):
                self.tests.append((name, {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f

    def partitions(self) -> list[Segment]:
        from pyarrow import fs as pafs

        fs, base = _file_system(self.path)
        if fs.get_file_info(base).type == pafs.FileType.File:
            held = [fs.get_file_info(base)]
        elif fs.get_file_info(f"{base}/{MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{base}/{MANIFEST}") as told:
                files = json.loads(told.read())
            return [Segment(f"{base}/{f['file']}", a, b) for f in files for a, b in zip(f["starts"], [*f["starts"][1:], f["size"]], strict=True)] or [Segment("", 0, 0)]
        else:
            held = sorted((f for f in fs.get_file_info(pafs.FileSelector(base, recursive=True)) if f.type == pafs.FileType.File and f.path.endswith((".warc", ".warc.gz"))), key=lambda f: f.path)
        return [Segment(f.path, 0, f.size, f.path.endswith(".gz")) for f in held] or [Segment("", 0, 0)]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = _file_system(self.path)
        types = {"payload_length": pa.int64(), "payload": pa.binary()}
        rows, held = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], types.get(n, pa.string())) for n in self.names], self.names)
        with fs.open_input_file(partition.path) as stream:
            source = _Source(stream, partition.start, partition.end, partition.packed)
            for fields, length in source.records():
                digest = fields.get("warc-payload-digest")
                row = {
                    "record_id": _urn(fields.get("warc-record-id")),
                    "record_type": fields.get("warc-type"),
                    "target_uri": _urn(fields.get("warc-target-uri")),
                    "date": fields.get("warc-date"),
                    "content_type": fields.get("content-type"),
                    "payload_digest": digest.removeprefix("sha1:") if digest else None,
                    "refers_to": _urn(fields.get("warc-refers-to")),
                }
                if not all(row[name] in values for name, values in self.tests):
                    continue
                kind, http = row["record_type"], (row["content_type"] or "").startswith("application/http")
                told = fields.get("warc-payload-length")
                check = self.verify and kind == "response" and (digest or "").startswith("sha1:")
                wanted = kind != "revisit" and (self.with_payload or check)
                if told is None or wanted:
                    length -= source.block_head() if http else 0
                row["payload_length"] = int(told) if told is not None else None if kind == "revisit" else length
                if wanted:
                    payload = source.block()
                    if check and (base32_digest(payload) != row["payload_digest"].upper() or len(payload) != row["payload_length"]):
                        raise ValueError(f"record {row['record_id']} of {partition.path}: payload and digest differ")
                    if self.with_payload:
                        row["payload"] = payload
                        held += len(payload)
                rows.append(row)
                if len(rows) >= 4096 or held >= BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA if self.options.get("payload", "true") == "true" else _HEADERS

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def deduplicated(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """The rows to write for (page_id, url, html).

    A combining aggregate finds the digests that two rows or more have. Only these meet the rows again, in a join that
    adaptive execution broadcasts where they are few, and splits where one of them is hot.
    """
    rows = pages.select(F.col("page_id").alias("id"), F.col("url").alias("target_uri"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    last = rows.groupBy("digest").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = rows.join(last, "digest", "left")
    revisit = (F.length("payload") >= min_payload) & F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("id"))
    urn = lambda c: F.concat(F.lit(URN), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return rows.select(
        urn("id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        "payload",
        base32(F.col("digest")).alias("payload_digest"),
        F.when(revisit, urn("last")).alias("refers_to"),
    )


def base32(hex_digest):
    """Base 32 of forty hex digits, five digits to four characters at a time."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for k in range(8):
        five = F.conv(F.substring(hex_digest, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substring(letters, (F.shiftright(five, 15 - 5 * j).bitwiseAND(F.lit(31)) + 1), F.lit(1)) for j in range(4)]
    return F.concat(*parts)


def write_archive(rows: DataFrame, path: str) -> None:
    register(rows.sparkSession)
    rows.write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archive(deduplicated(table(spark, sf_dir, "pages")), path)
    found = read_archive(spark, path, payload="false", verify="true")
    return found.select(
        F.substring_index("record_id", ":", -1).try_cast("long").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.substring_index("refers_to", ":", -1).try_cast("long").alias("refers_to"),
    )


_CHARACTERS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, {5 * k + 1}, 5) AS INTEGER) >> {15 - 5 * j}) & 31) + 1, 1)" for k in range(8) for j in range(4)
)
ORACLE = f"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages
), m AS (
  SELECT page_id, octet_length(b) AS n, h, max(page_id) OVER (PARTITION BY h) AS last FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_CHARACTERS} AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM m
"""
