"""WARC archives as a Spark data source: files in ranges, header predicates before payloads, and pages archived with revisits of equal payloads."""

from __future__ import annotations

import base64
import datetime
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import IO

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import CaseInsensitiveDict, DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from ._shared import shared_dir, small_batches, written

SCHEMA = "record_id string, record_type string, record_date string, target_uri string, content_type string, content_length long, payload_digest string, refers_to string, headers map<string, string>, payload_bytes long, payload binary, file string, offset long"
# Names of the format.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "record_date": "WARC-Date", "target_uri": "WARC-Target-URI", "content_type": "Content-Type", "content_length": "Content-Length", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http"

MANIFEST = "_manifest.json"
#: Bytes of a reading task; of a file's parts that can be read alone; of a file; of what is read at a time; of a batch; of a header at most.
RANGE_BYTES, PART_BYTES, FILE_BYTES, CHUNK_BYTES, BATCH_BYTES, HEADER_BYTES = 64 << 20, 8 << 20, 1 << 30, 1 << 20, 4 << 20, 1 << 20
#: Revisits are written for payloads of so many bytes at least.
MIN_REVISIT_BYTES = 0


def _files(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; any that pyarrow knows."""
    return pyarrow.fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][\w+.-]+:", path) else (pyarrow.fs.LocalFileSystem(), path)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(record: bytes, level: int) -> bytes:
    """A gzip member that says in its extra field how long it is, so that readers can pass over it without inflating."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    total = 10 + 2 + 12 + len(body) + 8
    if max(total, len(record)) >= 1 << 32:
        return b"\x1f\x8b\x08\x00" + bytes(4) + b"\x00\xff" + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<HccHII", 12, b"s", b"l", 8, total, len(record)) + body + struct.pack("<II", zlib.crc32(record), len(record))


def record_bytes(record_type: str, record_id: str, date: str, uri: str | None, content_type: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A record; a response has an HTTP head before its payload, and a revisit the head alone. Control characters and spaces in a URI are percent-encoded."""
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f\x85  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), uri))
    lines.append(f"WARC-Payload-Digest: sha1:{_digest(payload)}")
    block = payload
    if record_type in ("response", "revisit"):
        block = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type or 'application/octet-stream'}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        content_type = f"{HTTP}; msgtype=response"
        if record_type == "response":
            block += payload
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [f"Content-Type: {content_type or 'application/octet-stream'}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict[str, str]:
    """Headers by lower-cased name, after the version line; folded lines are joined, of repeated names the first counts."""
    found: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            if last in found:
                last = None
            else:
                found[last] = value.strip()
    return found


class _Raw:
    """The bytes of a file from an offset, in chunks; what is passed over is not read."""

    def __init__(self, file: IO, at: int) -> None:
        self.file, self.at, self.kept = file, at, b""
        file.seek(at)

    def more(self) -> bool:
        chunk = self.file.read(CHUNK_BYTES)
        self.kept += chunk
        return bool(chunk)

    def peek(self, n: int) -> bytes:
        while len(self.kept) < n and self.more():
            pass
        return self.kept[:n]

    def take(self, n: int) -> bytes:
        parts, need = [], n
        while need:
            if not self.kept and not self.more():
                raise EOFError
            part, self.kept = self.kept[:need], self.kept[need:]
            parts.append(part)
            need -= len(part)
        self.at += n
        return b"".join(parts)

    def skip(self, n: int) -> None:
        self.at += n
        if n <= len(self.kept):
            self.kept = self.kept[n:]
        else:
            self.kept = b""
            self.file.seek(self.at)


class _Plain:
    """A record of an archive that isn't compressed."""

    def __init__(self, raw: _Raw) -> None:
        self.raw = raw
        self.take, self.peek, self.skip = raw.take, raw.peek, raw.skip

    def end(self) -> None:
        while self.raw.peek(2) == b"\r\n":
            self.raw.skip(2)


class _Member:
    """A record in a gzip member of its own. It is inflated as far as it is asked for; its end is jumped to where the member says its length."""

    def __init__(self, raw: _Raw) -> None:
        self.raw, self.start, self.inflate, self.kept = raw, raw.at, zlib.decompressobj(31), b""
        head = raw.peek(24)
        self.length = struct.unpack("<I", head[16:20])[0] if len(head) == 24 and head[3] == 4 and head[10:16] == b"\x0c\x00sl\x08\x00" else None

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        if not self.raw.kept and not self.raw.more():
            raise EOFError
        given = self.raw.kept
        self.kept += self.inflate.decompress(given, CHUNK_BYTES)
        rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        self.raw.at += len(given) - len(rest)
        self.raw.kept = rest
        return True

    def peek(self, n: int) -> bytes:
        while len(self.kept) < n and self._more():
            pass
        return self.kept[:n]

    def take(self, n: int) -> bytes:
        parts, need = [], n
        while need:
            if not self.kept and not self._more():
                raise EOFError
            part, self.kept = self.kept[:need], self.kept[need:]
            parts.append(part)
            need -= len(part)
        return b"".join(parts)

    def skip(self, n: int) -> None:
        """What is left is passed over by end()."""

    def end(self) -> None:
        if self.length is not None:
            self.raw.skip(self.start + self.length - self.raw.at)
            return
        self.kept = b""
        while self._more():
            self.kept = b""


def _head(source: _Plain | _Member, end: bytes = b"\r\n\r\n") -> bytes:
    """Up to the first empty line, which is taken too; it is looked for in what is inflated or read already first."""
    n = 1024
    while (at := (seen := source.peek(n)).find(end)) < 0:
        if len(seen) < n:
            raise EOFError
        if n > HEADER_BYTES:
            raise ValueError(f"a header of over {HEADER_BYTES} bytes")
        n *= 2
    return source.take(at + len(end))[:at]


def records(file: IO, start: int, end: int | None, wanted: Callable[[dict], bool], payloads: bool, lengths: bool, verify: bool) -> Iterator[dict]:
    """The records that begin in [start, end) and whose headers are wanted: their headers first, the payload only if it is asked for."""
    raw = _Raw(file, start)
    while (end is None or raw.at < end) and (magic := raw.peek(2)):
        at = raw.at
        source = _Member(raw) if magic == b"\x1f\x8b" else _Plain(raw)
        try:
            head = _head(source)
            if not head.startswith(b"WARC/"):
                raise ValueError("no record")
            named = parse_headers(head)
            row = {c: named.pop(h.lower(), None) for c, h in HEADERS.items()}
            left = row["content_length"] = int(row["content_length"] or 0)
            for c in ("record_id", "refers_to"):
                row[c] = row[c].removeprefix("<").removesuffix(">") if row[c] else None
            row["payload_digest"] = re.sub("^sha1:", "", row["payload_digest"]) if row["payload_digest"] else None
            row |= {"headers": named, "offset": at}
            if wanted(row):
                if (payloads or lengths) and (row["content_type"] or "").startswith(HTTP) and left:
                    left -= len(_head(source)) + 4
                row["payload_bytes"] = left
                if payloads:
                    row["payload"] = source.take(left)
                    left = 0
                    if verify and row["record_type"] != "revisit" and row["payload_digest"] and len(row["payload_digest"]) == 32 and row["payload_digest"] != _digest(row["payload"]):
                        raise ValueError("the payload isn't that of its digest")
                yield row
            source.skip(left)
            source.end()
        except (EOFError, ValueError, zlib.error) as fault:
            raise ValueError(f"record at byte {at}: {str(fault) or 'cut off'}") from fault


_TESTS: dict[type, Callable[[object, object], bool]] = {
    EqualTo: lambda x, v: x == v, EqualNullSafe: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
    StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x,
}
_ORDER = (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)


def _test(f: Filter) -> tuple[str, bool, type, object] | None:
    """(column, negated, kind, value) of a filter that headers answer as Spark does; None for others."""
    no = isinstance(f, Not)
    f = f.child if no else f
    column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
    if column not in HEADERS or type(f) not in (*_TESTS, IsNull, IsNotNull) or (isinstance(f, EqualNullSafe) and f.value is None):
        return None
    if type(f) in _ORDER and column != "content_length":  # the order of strings is that of their UTF-8 bytes
        return None
    value = getattr(f, "value", None)
    return column, no, type(f), set(value) if isinstance(f, In) else value


def _fits(row: dict, tests: list[tuple[str, bool, type, object]]) -> bool:
    """SQL's logic: what compares a null isn't true, nor is its negation; but <=> is."""
    for column, no, kind, value in tests:
        x = row[column]
        if kind in (IsNull, IsNotNull):
            good = (x is None) == (kind is IsNull)
        elif x is None:
            good = False
            if kind is not EqualNullSafe:
                return False
        else:
            good = _TESTS[kind](x, value)
        if good == no:
            return False
    return True


@dataclass
class Ranges(InputPartition):
    """(file, first byte, byte after) that one task reads."""

    parts: list[tuple[str, int, int]]


class WarcReader(DataSourceReader):
    """Reads the columns of schema only; a payload is decoded if schema has it and the headers fit the pushed filters."""

    def __init__(self, schema: StructType, options: CaseInsensitiveDict) -> None:
        self.schema, self.path, self.tests = schema, options["path"], []
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.verify = str(options.get("verify", "true")).lower() == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if test := _test(f):
                self.tests.append(test)
            else:
                yield f

    def partitions(self) -> list[Ranges]:
        fs, path = _files(self.path)
        parts: list[tuple[str, int, int]] = []
        if fs.get_file_info(f"{path}/{MANIFEST}").type != pyarrow.fs.FileType.NotFound:
            for file in read_manifest(fs, path):
                cuts = [*file["parts"], file["bytes"]]
                parts += [(f"{path}/{file['name']}", a, b) for a, b in zip(cuts, cuts[1:])]
        elif (info := fs.get_file_info(path)).type == pyarrow.fs.FileType.File:
            parts = [(path, 0, info.size)]
        else:
            found = fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
            parts = [(i.path, 0, i.size) for i in sorted(found, key=lambda i: i.path) if re.search(r"\.warc(\.gz)?$", i.path) and i.size]
        tasks: list[Ranges] = []
        room = 0
        for name, a, b in parts:
            if not tasks or room < b - a:
                tasks.append(Ranges([]))
                room = self.range_bytes
            room -= b - a
            own = tasks[-1].parts
            if own and own[-1][0] == name and own[-1][2] == a:
                own[-1] = (name, own[-1][1], b)
            else:
                own.append((name, a, b))
        return tasks or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        names = schema.names
        fs, _ = _files(self.path)
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([list(r[n].items()) if n == "headers" else r.get(n) for r in rows], schema.field(n).type) for n in names], schema=schema)

        for name, a, b in partition.parts:
            with fs.open_input_file(name) as file:
                try:
                    for row in records(file, a, b, lambda r: _fits(r, self.tests), "payload" in names, "payload_bytes" in names, self.verify):
                        rows.append(row | {"file": name})
                        size += 1000 + len(row.get("payload", b""))
                        if size > BATCH_BYTES:
                            yield batch()
                            rows, size = [], 0
                except ValueError as fault:
                    raise ValueError(f"{name}: {fault}") from fault
        if rows:
            yield batch()


def read_manifest(fs: pyarrow.fs.FileSystem, path: str) -> list[dict]:
    with fs.open_input_stream(f"{path}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    """What a task has written."""

    files: list[dict]


class WarcWriter(DataSourceArrowWriter):
    """Each attempt writes files of its own; the manifest, moved into place last, lists those that were committed, with the places where readers may begin."""

    def __init__(self, schema: StructType, options: CaseInsensitiveDict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.gzip, self.level = str(options.get("gzip", "true")).lower() == "true", int(options.get("level", 1))
        self.file_bytes = int(options.get("fileBytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = _files(self.path)
        fs.create_dir(path, recursive=True)
        files: list[dict] = []
        out = None
        now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        try:
            for batch in iterator:
                col = {n: batch.column(n) for n in batch.schema.names}
                for k in range(batch.num_rows):
                    get = lambda n: col[n][k].as_py() if n in col else None  # noqa: B023, E731
                    record = record_bytes(get("record_type") or "resource", get("record_id") or f"urn:uuid:{uuid.uuid4()}", get("record_date") or now, get("target_uri"), get("content_type"), get("payload") or b"", get("refers_to"))
                    record = _member(record, self.level) if self.gzip else record
                    if out is None or files[-1]["bytes"] + len(record) > self.file_bytes:
                        if out:
                            out.close()
                        files.append({"name": f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip, "bytes": 0, "records": 0, "parts": []})
                        out = fs.open_output_stream(f"{path}/{files[-1]['name']}", compression=None)
                    file = files[-1]
                    if not file["parts"] or file["bytes"] - file["parts"][-1] >= PART_BYTES:
                        file["parts"].append(file["bytes"])
                    out.write(record)
                    file["bytes"] += len(record)
                    file["records"] += 1
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = _files(self.path)
        fs.create_dir(path, recursive=True)
        old = read_manifest(fs, path) if fs.get_file_info(f"{path}/{MANIFEST}").type == pyarrow.fs.FileType.File else []
        new = [f for m in messages if m for f in m.files]
        with fs.open_output_stream(f"{path}/{MANIFEST}.new", compression=None) as out:
            out.write(json.dumps(new if self.overwrite else old + new).encode())
        fs.move(f"{path}/{MANIFEST}.new", f"{path}/{MANIFEST}")
        self._delete(old if self.overwrite else [])

    def abort(self, messages: list[Written | None]) -> None:
        self._delete([f for m in messages if m for f in m.files])

    def _delete(self, files: list[dict]) -> None:
        fs, path = _files(self.path)
        for f in files:
            fs.delete_file(f"{path}/{f['name']}")


class WarcSource(DataSource):
    """format("warc"): a file or folder of .warc and .warc.gz. Options: path, rangeBytes and verify to read; gzip, level and fileBytes to write."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes format("warc") known to the session, and has filters handed to Python data sources."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    small_batches(spark)


def read_warc(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Records with these columns of SCHEMA, or all; without payload among them no payload is decoded. Filter the result: predicates on headers are pushed down."""
    register(spark)
    kinds = dict(re.findall(r"(\w+) (map<[^>]*>|\w+)", SCHEMA))
    return spark.read.format("warc").schema(", ".join(f"{c} {kinds[c]}" for c in columns or kinds)).load(path)


def archive_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Writes a record for each page to path: of equal payloads of at least min_bytes that of the largest id is a response, and the others revisit it.

    A null html is an empty payload, a null url is left out. A null id is the least; rows that share the
    largest id of their payload are all responses, as a record can't revisit itself.
    """
    spark = pages.sparkSession
    register(spark)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    # 256 bits of the payload are its key; a table of one row for each, so that Spark can split the rows of a hot one
    keyed = rows.withColumn("key", F.when(F.length("payload") >= min_bytes, F.sha2("payload", 256)))
    heads = keyed.where("key is not null").groupBy("key").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null")
    joined = keyed.join(written(heads.select("key", "keeper"), "heads"), "key", "left")
    revisits = F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    ready = joined.select(urn(F.col("id")).alias("record_id"), F.when(revisits, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit("text/html; charset=utf-8").alias("content_type"), F.when(revisits, urn(F.col("keeper"))).alias("refers_to"), "payload")
    ready.write.format("warc").mode("append").save(path)


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record that archive_pages() wrote.

    Payloads of responses are decoded and held against their digests. A revisit has none: its record is
    read by headers alone, and how long its payload is is that of the response it names.
    """
    number = lambda c: F.substring_index(c, ":", -1).try_cast("long")
    full = read_warc(spark, path, "record_id", "record_type", "payload_digest", "payload").where("record_type = 'response'")
    full = written(full.select("record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest"), "responses")
    short = read_warc(spark, path, "record_id", "record_type", "payload_digest", "refers_to").where("record_type = 'revisit'").drop("record_type")
    known = full.select(F.col("record_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    short = short.join(known, ["refers_to", "payload_digest"], "left")
    rows = full.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("string")}).unionByName(short.withColumn("record_type", F.lit("revisit")))
    return rows.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """archive_pages() to a new folder of the shared one, and archived_pages() of it."""
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    archive_pages(pages, path)
    return archived_pages(pages.sparkSession, path)
