"""WARC archives as a Spark data source, and pages written to them with revisit records for equal payloads.

The reader plans one partition a file (the writer rolls files at a size), and takes over predicates on the record type
and on headers: a record's headers are parsed first, and unless its row is wanted and its payload asked for by the
schema, the payload is stepped over without decoding. Files are .warc or .warc.gz (a gzip member a record).
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from pagemill.llm._common import NULL_ID, shared_path

SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, payload_digest string, refers_to string, http_length bigint, file string, position bigint, payload binary"
#: Columns that come from WARC headers.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest.json"
FILE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
STEP = 1 << 16


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    """Header values hold no control characters."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(kind: str, record_id: str, uri: str | None, date: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_line(uri)}"] if uri is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}"]
    head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"] if kind == "revisit" else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Bytes:
    """Sequential reading of a plain or gzip file, whose members follow each other."""

    def __init__(self, stream, packed: bool):
        self.stream, self.packed, self.held, self.unpack, self.raw, self.at = stream, packed, b"", None, b"", 0

    def _more(self) -> bool:
        while True:
            raw = self.raw or self.stream.read(STEP)
            self.raw = b""
            if not raw:
                return False
            if not self.packed:
                self.held += raw
                return True
            self.unpack = self.unpack or zlib.decompressobj(31)
            new = self.unpack.decompress(raw)
            if self.unpack.eof:
                self.raw, self.unpack = self.unpack.unused_data, None
            if new:
                self.held += new
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with the mark; None at the end of the file."""
        seen = 0
        while (i := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self._more():
                return None
        return self.take(i + len(mark))

    def take(self, n: int) -> bytes:
        if n > len(self.held):
            parts, have = [self.held], len(self.held)
            self.held = b""
            while have < n and self._more():
                parts.append(self.held)
                have += len(self.held)
                self.held = b""
            self.held = b"".join(parts)
        out, self.held = self.held[:n], self.held[n:]
        self.at += len(out)
        return out

    def skip(self, n: int) -> None:
        """Step over n bytes; in a plain file without reading them."""
        inside = min(n, len(self.held))
        self.held, self.at, n = self.held[inside:], self.at + inside, n - inside
        if n and not self.packed and self.stream.seekable():
            self.stream.seek(self.stream.tell() + n)
            self.at += n
            return
        while n > 0 and self._more():
            inside = min(n, len(self.held))
            self.held, self.at, n = self.held[inside:], self.at + inside, n - inside


def _headers(raw: bytes) -> dict[str, str]:
    """Names in lower case; continued lines are joined, of repeated ones the first counts."""
    lines = re.split(r"\r?\n", re.sub(r"\r?\n[ \t]+", " ", raw.decode("utf-8", "replace")))
    found: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            found.setdefault(name.strip(" \t").lower(), value.strip(" \t"))
    return found


def records(stream, packed: bool, wanted, with_http: bool, with_payload: bool) -> Iterator[tuple[int, dict, int | None, bytes | None]]:
    """(position, headers, HTTP length, payload) of each record whose headers are wanted."""
    data = _Bytes(stream, packed)
    while True:
        while data.held[:1] in (b"\r", b"\n"):
            data.take(1)
        position = data.at
        raw = data.until(b"\r\n\r\n")
        if raw is None:
            return
        if raw.lstrip(b"\r\n")[:5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {position}")
        head = _headers(raw.lstrip(b"\r\n"))
        left = int(head.get("content-length", 0))
        if wanted(head):
            length = payload = None
            if head.get("content-type", "").startswith("application/http") and (with_http or with_payload):
                http = data.until(b"\r\n\r\n") or b""
                left -= len(http)
                own = _headers(http)
                length = int(own["content-length"]) if own.get("content-length", "").isdigit() else None
            if with_payload and head.get("warc-type") != "revisit":
                payload = data.take(left)
                left = 0
            yield position, head, length, payload
        data.skip(left)


@dataclass
class File(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns, self.path, self.verify, self.tests = [f.name for f in schema], options["path"], options.get("verify", "false").lower() == "true", []

    def pushFilters(self, filters):  # noqa: N802
        """Equality, membership, prefix and presence of header columns are taken over; Spark keeps the rest."""
        for f in filters:
            name = HEADERS.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if name and isinstance(f, (EqualTo, EqualNullSafe)):
                self.tests.append((name, "in", (f.value,)))
            elif name and isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif name and isinstance(f, StringStartsWith):
                self.tests.append((name, "prefix", f.value))
            elif name and isinstance(f, IsNotNull):
                self.tests.append((name, "there", None))
            else:
                yield f

    def partitions(self):
        where, root = _place(self.path)
        manifest = posixpath.join(root, MANIFEST)
        if where.get_file_info(root).type == fs.FileType.File:
            return [File(root)]
        if where.get_file_info(manifest).type == fs.FileType.File:
            with where.open_input_stream(manifest) as f:
                return [File(posixpath.join(root, x)) for x in json.loads(f.read())]
        found = where.get_file_info(fs.FileSelector(root, recursive=True))
        return [File(x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file and re.search(r"\.warc(\.gz)?$", x.path)]

    def _wanted(self, head: dict) -> bool:
        for name, kind, value in self.tests:
            own = _value(head, name)
            if kind == "in" and own not in value or kind == "prefix" and not (own or "").startswith(value) or kind == "there" and own is None:
                return False
        return True

    def read(self, partition):
        if partition is None:  # no files
            return
        where, _ = _place(self.path)
        asked = set(self.columns)
        schema = pa.schema([(c, {"http_length": pa.int64(), "position": pa.int64(), "payload": pa.binary()}.get(c, pa.string())) for c in self.columns])
        rows, size = [], 0
        with where.open_input_file(partition.path) as f:
            for position, head, length, payload in records(f, partition.path.endswith(".gz"), self._wanted, "http_length" in asked, "payload" in asked):
                if self.verify and payload is not None and (said := head.get("warc-payload-digest", "")).startswith("sha1:") and said[5:] != digest_of(payload):
                    raise ValueError(f"the record at byte {position} of {partition.path} has another payload than its digest says")
                own = {"http_length": length, "payload": payload, "file": partition.path, "position": position}
                rows.append({c: _value(head, HEADERS[c]) if c in HEADERS else own[c] for c in self.columns})
                size += 256 + len(payload or b"")
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _value(head: dict, name: str) -> str | None:
    value = head.get(name)
    if value is not None and name in ("warc-record-id", "warc-refers-to"):
        return value.strip("<>")
    return value


class WarcWriter(DataSourceWriter):
    def __init__(self, options):
        self.path, self.date, self.packed = options["path"], options.get("date", "2000-01-01T00:00:00Z"), options.get("compression", "gzip") == "gzip"

    def write(self, iterator):
        where, root = _place(self.path)
        where.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        try:
            for r in iterator:
                if out is None:
                    files.append(f"{uuid.uuid4().hex}.warc" + ".gz" * self.packed)
                    out, size = where.open_output_stream(posixpath.join(root, files[-1]), compression=None), 0
                raw = record(r.record_type, r.record_id, r.target_uri, self.date, bytes(r.payload), r.payload_digest or digest_of(bytes(r.payload)), r.refers_to)
                if self.packed:
                    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                    raw = pack.compress(raw) + pack.flush()
                out.write(raw)
                size += len(raw)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages):
        """Only the files of tasks that succeeded are named; those of lost attempts are never read."""
        where, root = _place(self.path)
        where.create_dir(root, recursive=True)
        with where.open_output_stream(posixpath.join(root, MANIFEST), compression=None) as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())

    def abort(self, messages):
        where, root = _place(self.path)
        for m in messages:
            for x in m.files if m else ():
                where.delete_file(posixpath.join(root, x))


class WarcSource(DataSource):
    """Options: path (any that pyarrow opens); verify (true: payloads are held against their digests); writing also
    compression (gzip, none) and date. Rows to write: record_type, record_id, target_uri, payload_digest (null: made from
    the payload), refers_to, payload (of a revisit too, for its length)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


PREFIX = "urn:pagemill:page:"


def archive(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for each row of pages: of rows with equal payloads of least_bytes or more, the one with the largest
    id is a response and the others are revisits of it."""
    register(pages.sparkSession)
    own = pages.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NULL_ID)).alias("id"), F.col(f"`{url_col}`").alias("target_uri"), F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8").alias("payload"))
    own = own.withColumns({"sha": F.sha2("payload", 256), "n": F.octet_length("payload")})
    # Equal payloads meet as ids and digests alone; payloads are dealt by id, of which no value is frequent.
    slim = own.select("id", "sha", "n").where(F.col("n") >= least_bytes)
    lead = slim.groupBy("sha", "n").agg(F.max("id").alias("lead"))
    again = slim.join(lead, ["sha", "n"]).where("id <> lead").select("id", "sha", "lead").distinct()
    rows = own.join(again, ["id", "sha"], "left").withColumn("again", F.col("lead").isNotNull())
    name = lambda c: F.concat(F.lit(PREFIX), F.when(F.col(c) == NULL_ID, "none").otherwise(F.col(c).cast("string")))
    rows.select(F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"), name("id").alias("record_id"), "target_uri", F.lit(None).cast("string").alias("payload_digest"), F.when(F.col("again"), name("lead")).alias("refers_to"), "payload").write.format("warc").mode("append").save(path)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the archived pages; payloads are decoded for
    responses alone, and held against their digests there."""
    register(spark)
    bare = "record_type string, record_id string, payload_digest string, refers_to string, "
    full = spark.read.format("warc").schema(bare + "payload binary").option("verify", "true").load(path).where("record_type = 'response'").withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    again = spark.read.format("warc").schema(bare + "http_length bigint").load(path).where("record_type = 'revisit'").withColumn("payload_bytes", F.col("http_length"))
    number = lambda c: F.try_to_number(F.substr(F.col(c), F.lit(len(PREFIX) + 1)), F.lit("S9999999999999999999")).cast("bigint")
    both = full.drop("payload").unionByName(again.drop("http_length"))
    return both.select(number("record_id").alias("page_id"), "payload_bytes", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


def round_trip(pages: DataFrame, least_bytes: int = 0, **columns: str) -> DataFrame:
    """Archive the pages in the shared folder and read them back, a row for each.

    A null html counts as empty; a null id counts as the smallest and comes back as null; rows that repeat the largest id
    of equal payloads are all responses. Control characters in a URL are percent-encoded, a null one has no header. An
    empty table gives no rows; columns other than id, url and html are not read.
    """
    path = shared_path(pages.sparkSession, "warc")
    archive(pages, path, least_bytes, **columns)
    return read_back(pages.sparkSession, path)
