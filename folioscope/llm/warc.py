"""WARC archives as a Spark data source.

Reading: files are packed into partitions of even size when the scan is planned. Predicates on the
record type and on header columns are pushed into the scan; each record's header is parsed first, and
where it fails a predicate, or payloads are not asked for, the rest of the record is passed over:
by a seek in plain files, and in compressed ones, too, if their members carry their length (the
``sl`` extra field of the format's annex, which the writer sets).

Writing: one or more files per task, under names of their own. The files of tasks that committed
are listed in a ``_files-`` list of their commit, so a task that ran twice or was lost leaves nothing
that is read, and a later commit adds to the earlier ones. A record that its file does not hold to
its end raises an error, whether payloads are asked for or not.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, IsNull,
    StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage)

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, "
    "payload_bytes long, content_type string, content_length long, payload binary, file string, offset long")
WRITTEN = "record_type string, record_id string, target_uri string, refers_to string, payload binary"
_ARROW = pa.schema([
    *((n, pa.string()) for n in ("record_type", "record_id", "target_uri", "date", "refers_to", "payload_digest")),
    ("payload_bytes", pa.int64()), ("content_type", pa.string()), ("content_length", pa.int64()), ("payload", pa.binary()),
    ("file", pa.string()), ("offset", pa.int64())])
#: Columns known once a header is parsed.
HEADER = frozenset(_ARROW.names) - {"payload"}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_S3 = r"^s3[an]://"
#: Bytes read at once, payload bytes of a batch, and bytes after which a task starts another file.
CHUNK, BATCH, FILE = 256 << 10, 8 << 20, 256 << 20


def digest(payload: bytes) -> str:
    """Bare base-32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, record_id: str, uri: str | None, refers_to: str | None, payload: bytes, date: str) -> bytes:
    """One record; a revisit keeps the digest and length of its payload, not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_one_line(record_id)}>", f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_one_line(uri)}"] if uri is not None else []),
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Profile: {REVISIT}"] if kind == "revisit" else []),
        *([f"WARC-Refers-To: <{_one_line(refers_to)}>"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info(date: str) -> bytes:
    body = b"format: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """``data`` as a gzip member that tells its own length."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF) if max(size, len(data)) < 1 << 32 else b"xx" + struct.pack("<HQ", 8, 0)
    return (b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", 12) + extra + body
            + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


class _Plain:
    """Bytes of a file from some place on, and records in it."""

    def __init__(self, stream, size: int):
        self.stream, self.size, self.at = stream, size, 0

    def head(self) -> tuple[bytes, bytes] | None:
        """Header of the record at this place and what was read behind it; None at the end."""
        self.stream.seek(self.at)
        data = b""
        while (end := data.find(b"\r\n\r\n")) < 0:
            more = self.stream.read(CHUNK)
            if not more:
                if data.strip():
                    raise ValueError(f"cut record at {self.at}")
                return None
            data += more
        return data[:end], data[end + 4 :]

    def block(self, rest: bytes, length: int) -> bytes:
        self.stream.seek(self.at + self.skipped + len(rest))
        return rest[:length] if len(rest) >= length else rest + self.stream.read(length - len(rest))

    def start(self, header: bytes) -> None:
        self.skipped = len(header) + 4

    def skip(self, rest: bytes, length: int) -> None:
        self.at += self.skipped + length + 4
        if self.at - 4 > self.size:
            raise ValueError(f"a record is cut: the file ends at {self.size}, the record at {self.at - 4}")


class _Packed(_Plain):
    """The same for a file of gzip members."""

    def head(self) -> tuple[bytes, bytes] | None:
        self.stream.seek(self.at)
        data = self.stream.read(CHUNK)
        if not data:
            return None
        self.length = 0
        if data[3] & 4 and data[12:14] == b"sl":
            self.length = struct.unpack("<I", data[16:20])[0]
        self.inflate, self.fed = zlib.decompressobj(31), len(data)
        out = self.inflate.decompress(data, 4096)
        while (end := out.find(b"\r\n\r\n")) < 0:
            out += self._more(4096)
        return out[:end], out[end + 4 :]

    def _more(self, most: int) -> bytes:
        data = self.inflate.unconsumed_tail
        if not data:
            data = self.stream.read(CHUNK)
            self.fed += len(data)
            if not data:
                raise ValueError(f"cut member at {self.at}")
        return self.inflate.decompress(data, most)

    def block(self, rest: bytes, length: int) -> bytes:
        parts, have = [rest], len(rest)
        while have < length:
            parts.append(self._more(max(4096, length - have)))
            have += len(parts[-1])
        return b"".join(parts)[:length]

    def skip(self, rest: bytes, length: int) -> None:
        if not self.length:
            while not self.inflate.eof:
                self._more(CHUNK)
            self.length = self.fed - len(self.inflate.unused_data)
        self.at += self.length
        if self.at > self.size:
            raise ValueError(f"a member is cut: the file ends at {self.size}, the member at {self.at}")


def _fields(header: bytes) -> dict[str, str]:
    lines = re.sub(r"\r\n[ \t]+", " ", header.decode("utf-8", "replace").lstrip("\r\n")).split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    out = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        out.setdefault(name.strip().lower(), value.strip())
    return out


def _row(head: dict[str, str]) -> dict:
    bare = lambda v: None if v is None else v[1:-1] if v[:1] == "<" and v[-1:] == ">" else v
    seal = head.get("warc-payload-digest")
    size = head.get("x-payload-length")
    return {
        "record_type": head.get("warc-type"), "record_id": bare(head.get("warc-record-id")),
        "target_uri": bare(head.get("warc-target-uri")), "date": head.get("warc-date"), "refers_to": bare(head.get("warc-refers-to")),
        "payload_digest": seal and seal.partition(":")[2], "payload_bytes": size and int(size),
        "content_type": head.get("content-type"), "content_length": int(head.get("content-length", 0)), "payload": None}


def records(stream, size: int, name: str, wanted, payloads: bool, verify: bool):
    """Rows of one archive whose header passes ``wanted``; payloads are decoded for those only."""
    first = stream.read(2)
    reader = (_Packed if first == b"\x1f\x8b" else _Plain)(stream, size)
    while (found := reader.head()) is not None:
        header, rest = found
        reader.start(header)
        try:
            row = _row(_fields(header))
        except ValueError as wrong:
            raise ValueError(f"{name} at {reader.at}: {wrong}") from wrong
        row |= {"file": name, "offset": reader.at}
        length = row["content_length"]
        if wanted(row):
            # a record that the file does not hold to its end is no record
            if isinstance(reader, _Plain) and not isinstance(reader, _Packed) and reader.at + reader.skipped + length > size:
                raise ValueError(f"{name} at {reader.at}: cut record")
            if (payloads or verify) and row["record_type"] not in ("revisit", "warcinfo"):
                block = reader.block(rest, length)
                http = (row["content_type"] or "").startswith("application/http")
                payload = block.partition(b"\r\n\r\n")[2] if http else block
                if verify and row["payload_digest"] and (digest(payload) != row["payload_digest"] or row["payload_bytes"] not in (None, len(payload))):
                    raise ValueError(f"{name} at {reader.at}: the payload is not the one that was written")
                row["payload"] = payload if payloads else None
            yield row
        try:
            reader.skip(rest, length)
        except ValueError as wrong:
            raise ValueError(f"{name}: {wrong}") from wrong


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of ``uri``; Hadoop's names of S3 are S3, too."""
    return fs.FileSystem.from_uri(re.sub(_S3, "s3://", uri))


@dataclass
class Files(InputPartition):
    paths: list


@dataclass
class Written(WriterCommitMessage):
    names: list


_TESTS = {
    EqualTo: lambda v, f: v is not None and v == f.value, EqualNullSafe: lambda v, f: v == f.value,
    In: lambda v, f: v is not None and v in f.value, IsNull: lambda v, f: v is None, IsNotNull: lambda v, f: v is not None,
    StringStartsWith: lambda v, f: v is not None and v.startswith(f.value),
    StringEndsWith: lambda v, f: v is not None and v.endswith(f.value),
    StringContains: lambda v, f: v is not None and f.value in v,
}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payloads = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.target = int(options.get("partitionbytes", options.get("partitionBytes", 64 << 20)))
        self.filters: list = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _TESTS and f.attribute[0] in HEADER:
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        files, root = filesystem(self.path)
        found = [i for i in files.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file] if files.get_file_info(root).type == fs.FileType.Directory else [files.get_file_info(root)]
        lists = [i for i in found if re.fullmatch(r"_files(-[0-9a-f]+)?", i.base_name)]
        if lists:
            good: set[str] = set()
            for listed in lists:
                with files.open_input_file(listed.path) as f:
                    good.update(json.loads(f.read()))
            found = [i for i in found if i.base_name in good]
        found = sorted((i for i in found if re.search(r"\.warc(\.gz)?$", i.base_name)), key=lambda i: (-i.size, i.path))
        parts: list[list] = []
        sizes: list[int] = []
        for info in found:  # large files first; small ones fill up the last partition
            if not sizes or sizes[-1] + info.size > self.target:
                parts.append([])
                sizes.append(0)
            parts[-1].append((info.path, info.size))
            sizes[-1] += info.size
        return [Files(p) for p in parts] or [Files([])]

    def read(self, partition):
        files, _ = filesystem(self.path)
        rows, held = [], 0

        def wanted(row):
            return all(_TESTS[type(f)](row[f.attribute[0]], f) for f in self.filters)

        for path, size in partition.paths:
            with files.open_input_file(path) as stream:
                for row in records(stream, size, path, wanted, self.payloads, self.verify):
                    rows.append(row)
                    held += 500 + len(row["payload"] or b"")
                    if held > BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.packed = options.get("compression", "gzip") == "gzip"

    def write(self, iterator):
        files, root = filesystem(self.path)
        files.create_dir(root, recursive=True)
        pack = member if self.packed else bytes
        names, out, size = [], None, 0
        for batch in iterator:
            columns = [batch.column(n) for n in ("record_type", "record_id", "target_uri", "refers_to", "payload")]
            for i in range(batch.num_rows):
                kind, record_id, uri, refers, payload = (c[i].as_py() for c in columns)
                if out is None or size > FILE:
                    if out:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc{'.gz' if self.packed else ''}")
                    out, size = files.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                    out.write(pack(_info(self.date)))
                data = pack(record(kind, record_id, uri, refers, payload or b"", self.date))
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return Written(names)

    def commit(self, messages):
        files, root = filesystem(self.path)
        files.create_dir(root, recursive=True)
        # a list for each commit: what was appended before stays listed
        with files.open_output_stream(f"{root}/_files-{uuid.uuid4().hex}", compression=None) as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages):
        files, root = filesystem(self.path)
        for name in (n for m in messages if m for n in m.names):
            files.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """``spark.read.format("warc")``; options: path, payload, verify, partitionBytes; date, compression to write."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known, and let Spark push predicates into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """Records of ``pages (page_id, url, html)``: ``WRITTEN`` columns.

    Of pages with equal payloads of at least ``least`` bytes, the one of smallest id is the
    response, the others revisit it. A null html is an empty payload; a null url is left out.
    Rows without an id revisit a page that has one, and are responses where none has. Repeated
    rows of the response's own id are responses, too. Other columns are not read.
    """
    from pyspark.sql import functions as F

    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("sha"))
    first = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    later = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    return rows.join(first, "sha", "left").select(
        F.when(later, "revisit").otherwise("response").alias("record_type"), urn("page_id").alias("record_id"),
        F.col("url").alias("target_uri"), F.when(later, urn("first")).alias("refers_to"), "payload")


def write(records_: DataFrame, path: str, **options: str) -> None:
    register(records_.sparkSession)
    records_.write.format("warc").mode("append").options(**options).save(path)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)
