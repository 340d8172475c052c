"""WARC archives as a PySpark Python data source, read and written.

Reading: files are planned into partitions (small files together, one file never split); predicates on record type, ids,
URI, digest and date are pushed down; a record's headers are parsed first, and the payload of a record that no one wants
(by predicate, or by the option payload=false) is skipped by its length, neither read nor decoded. Files that end in .gz
hold a member for each record; there skipped payloads are inflated but not decoded.

Writing: a response record holds the HTTP head and the payload, a revisit record the head alone, whose Content-Length
still tells the full payload's bytes, with the digest of the full payload and the response that it refers to. Every commit leaves one
file _committed-* that names the files of its tasks. A folder with such files is read by them, so that files of failed tasks are no part of the
archive, and no file is renamed; a folder without (of other tools) is read whole.

Defined results: a null payload is an empty one; null ids are written as "null", null URIs left out; header values lose line
ends; payloads of any length are written and read whole, one at a time; repeated rows are records of their own; an empty table makes an empty
archive; other columns than key, URI and body are left out, whatever their names. Among rows of equal payloads the largest
id is the response; all rows of that id are; rows without an id revisit it, or are responses where no row has one. An archive that is truncated, or whose
records can't be told apart (no WARC line, no whole Content-Length, bad compression), gives an error that names file and place; with the option broken="leave"
the records before that place are given and the rest of that file is left out.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from tidelog.llm.common import open_fs, scratch, ship, spread_join, stored

SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes long, content_type string, payload binary, path string, offset long"
#: Columns that are read from headers, with the header of each.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
#: Fixed value: the profile of a revisit whose payload is that of the record it refers to.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: How the files begin that list what a commit wrote.
COMMITTED = "_committed-"
READ_SCHEMA = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (x.split() for x in SCHEMA.split(", "))])


@dataclass
class Files(InputPartition):
    paths: list

    def __init__(self, paths: list):
        super().__init__(tuple(paths))
        self.paths = paths


@dataclass
class Written(WriterCommitMessage):
    names: list


def digest(payload: bytes) -> str:
    """Base32 SHA-1, upper case, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _value(x) -> str:
    return str(x).replace("\r", " ").replace("\n", " ")


def record(kind: str, record_id: str, uri: str | None, payload: bytes, date: str, refers_to: str | None = None, content_type: str = "text/html; charset=utf-8") -> bytes:
    """The bytes of one record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {_value(content_type)}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{_value(record_id)}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if uri is None else _value(uri),
        "WARC-Payload-Digest": "sha1:" + digest(payload),
        "WARC-Profile": PROFILE if kind == "revisit" else None,
        "WARC-Refers-To": None if refers_to is None else f"<{_value(refers_to)}>",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None) + "\r\n").encode() + block + b"\r\n\r\n"


class BrokenArchive(ValueError):
    """A file that is no sequence of whole records."""


class PlainFile:
    """Reads by position through a window, so that skipped bytes are not read."""

    def __init__(self, file, window: int = 1 << 16):
        self.file, self.size, self.window = file, file.size(), window
        self.cut = False
        self.at, self.held = 0, b""

    def upto(self, mark: bytes, start: int) -> bytes | None:
        """The bytes from start up to and with mark; None where the file ends first."""
        step = 4096
        while True:
            raw = self.bytes(start, step)
            if (k := raw.find(mark)) >= 0:
                return raw[: k + len(mark)]
            if start + step >= self.size:
                return None
            step *= 4

    def bytes(self, start: int, length: int) -> bytes:
        if not (self.at <= start and start + length <= self.at + len(self.held)):
            self.at, self.held = start, self.file.read_at(max(0, min(max(length, self.window), self.size - start)), start)
        return self.held[start - self.at : start - self.at + length]

    def ended_before(self, at: int) -> bool:
        return at > self.size


class GzipFile:
    """The same over a file of gzip members, inflated member by member; positions are those of the inflated bytes."""

    def __init__(self, file):
        self.file, self.pending, self.at, self.held, self.ended = file, b"", 0, bytearray(), False
        self.inflate, self.fed = zlib.decompressobj(31), False

    @property
    def cut(self) -> bool:
        """Whether the file ends inside a member."""
        return self.ended and self.fed and not self.inflate.eof

    def _more(self) -> bool:
        raw = self.pending or self.file.read(1 << 16)
        if not raw:
            self.ended = True
            return False
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        self.fed = True
        self.held += self.inflate.decompress(raw)
        self.pending = self.inflate.unused_data
        return True

    def _from(self, start: int) -> None:
        while not self.ended and self.at + len(self.held) < start:
            self.at += len(self.held)
            self.held.clear()
            self._more()
        del self.held[: start - self.at]
        self.at = start

    def upto(self, mark: bytes, start: int) -> bytes | None:
        if self.ended_before(start):
            return None
        seen = 0
        while (k := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                return None
        return bytes(self.held[: k + len(mark)])

    def bytes(self, start: int, length: int) -> bytes:
        if self.ended_before(start):
            return b""
        while len(self.held) < length and self._more():
            pass
        return bytes(self.held[:length])

    def ended_before(self, at: int) -> bool:
        """Whether the inflated bytes end before a position; goes on to it."""
        if at < self.at:
            return False
        behind = self.at + len(self.held)
        while not self.ended and behind < at:
            self._from(behind)
            self._more()
            behind = self.at + len(self.held)
        if behind >= at:
            self._from(at)
        return behind < at


def parsed(raw: bytes) -> dict[str, str]:
    """Lower-case header names with their values; a folded line continues the one before."""
    out: dict[str, str] = {}
    last = None
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def _bare(name: str, value: str | None) -> str | None:
    if value is None:
        return None
    if name in ("record_id", "refers_to"):
        return value.removeprefix("<").removesuffix(">")
    return value.partition(":")[2] if name == "payload_digest" and ":" in value else value


def records(file, path: str, wanted, with_payload: bool) -> Iterator[tuple]:
    """The records whose header columns `wanted` accepts, as rows of SCHEMA; BrokenArchive after those before a broken one."""
    at = 0
    try:
        while (raw := file.upto(b"\r\n\r\n", at)) is not None:
            head = parsed(raw)
            told = head.get("content-length", "")
            if not raw.startswith(b"WARC/") or not told.isascii() or not told.isdigit():
                raise BrokenArchive(f"{path}: no WARC record at {at}")
            start, length = at + len(raw), int(told)
            own = {c: _bare(c, head.get(h)) for c, h in HEADERS.items()}
            row = None
            if wanted(own):
                payload_bytes, kind, payload = length, head.get("content-type"), None
                skip = 0
                if head.get("content-type", "").startswith("application/http") and length:
                    http = file.upto(b"\r\n\r\n", start)
                    if http is not None and len(http) <= length:
                        inner, skip = parsed(http), len(http)
                        kind = inner.get("content-type")
                        # a revisit's block is the head alone; its payload's length is in it
                        inside = inner.get("content-length", "0")
                        payload_bytes = (int(inside) if inside.isdigit() else 0) if own["record_type"] == "revisit" else length - skip
                if with_payload and own["record_type"] != "revisit":
                    payload = file.bytes(start + skip, length - skip)
                row = (*own.values(), payload_bytes, kind, payload, path, at)
            if file.ended_before(start + length) or file.cut:
                raise BrokenArchive(f"{path}: the record at {at} is truncated")
            if row is not None:
                yield row
            at = start + length + 4
        if file.bytes(at, 4096).strip(b"\r\n") or file.cut:
            raise BrokenArchive(f"{path}: no whole record at {at}")
    except zlib.error as e:
        raise BrokenArchive(f"{path}: bad compression behind {at}: {e}") from e


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.with_payload = str(options.get("payload", "true")).lower() != "false"
        self.together = int(options.get("partitionBytes", 128 << 20))
        self.broken = options.get("broken", "raise")
        if self.broken not in ("raise", "leave"):
            raise ValueError("broken is 'raise' or 'leave'")
        self.filters: list[tuple[str, str, object]] = []

    def _wanted(self, own: dict) -> bool:
        for name, how, value in self.filters:
            x = own[name]
            if x is None or how == "in" and x not in value or how == "starts" and not x.startswith(value):
                return False
        return True

    def partitions(self):
        from pyarrow import fs

        store, path = open_fs(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        listed = [x.path for x in found if x.type == fs.FileType.File and x.base_name.startswith(COMMITTED)]
        homes = {x.rpartition("/")[0] for x in listed}
        ours = {f"{x.rpartition('/')[0]}/{name}" for x in listed for name in _names(store, x)}
        seen = lambda x: x.path in ours or x.path.rpartition("/")[0] not in homes
        files = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")) and x.base_name.endswith((".warc", ".warc.gz")) and seen(x))
        out, size = [[]], 0
        for name, n in files:
            if out[-1] and size + n > self.together:
                out.append([])
                size = 0
            out[-1].append(name)
            size += n
        return [Files(x) for x in out]

    def read(self, partition):
        store, _ = open_fs(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with store.open_input_stream(path, compression=None) if path.endswith(".gz") else store.open_input_file(path) as raw:
                try:
                    for x in records(GzipFile(raw) if path.endswith(".gz") else PlainFile(raw), path, self._wanted, self.with_payload):
                        rows.append(x)
                        held += len(x[8] or b"")
                        if len(rows) >= 4096 or held >= 32 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                except BrokenArchive:
                    if self.broken == "raise":
                        raise
        if rows:
            yield _batch(rows)


class PushingReader(WarcReader):
    """The same with predicates pushed down, for which Spark wants spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters):  # noqa: N802
        for x in filters:
            name = x.attribute[0] if len(getattr(x, "attribute", ())) == 1 else None
            if name in HEADERS and isinstance(x, EqualTo):
                self.filters.append((name, "in", {x.value}))
            elif name in HEADERS and isinstance(x, In):
                self.filters.append((name, "in", set(x.value)))
            elif name in HEADERS and isinstance(x, StringStartsWith):
                self.filters.append((name, "starts", x.value))
            elif name in HEADERS and isinstance(x, IsNotNull):
                self.filters.append((name, "there", None))
            else:
                yield x


def _names(store, path: str) -> list[str]:
    with store.open_input_stream(path, compression=None) as f:
        return f.read().decode().split()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), READ_SCHEMA.types, strict=True)], schema=READ_SCHEMA)


class WarcWriter(DataSourceArrowWriter):
    """Rows of record_type, record_id, target_uri, payload and refers_to."""

    def __init__(self, options):
        self.path = options["path"]
        self.most = int(options.get("fileBytes", 256 << 20))
        self.gz = str(options.get("gzip", "false")).lower() == "true"
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator):
        store, path = open_fs(self.path)
        store.create_dir(path, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("record_type", "record_id", "target_uri", "payload", "refers_to")]
            for kind, own, uri, payload, to in zip(*columns, strict=True):
                if out is None or size >= self.most:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc{'.gz' * self.gz}")
                    out, size = store.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                raw = record(kind.as_py(), own.as_py() or "null", uri.as_py(), payload.as_py() or b"", self.date, to.as_py())
                if self.gz:
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = pack.compress(raw) + pack.flush()
                out.write(raw)
                size += len(raw)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages):
        """One file with the names of those that count: a name for each fileBytes of archive reaches the driver."""
        store, path = open_fs(self.path)
        store.create_dir(path, recursive=True)
        hidden, own = f"{path}/.{uuid.uuid4().hex}", f"{path}/{COMMITTED}{uuid.uuid4().hex}"
        with store.open_output_stream(hidden, compression=None) as f:
            f.write("".join(f"{n}\n" for m in messages if m for n in m.names).encode())
        store.move(hidden, own)

    def abort(self, messages):
        store, path = open_fs(self.path)
        for name in (n for m in messages if m for n in m.names):
            store.delete_file(f"{path}/{name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return (PushingReader if str(self.options.get("pushdown", "false")).lower() == "true" else WarcReader)(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, *, where: Column | None = None, payload: bool = True, broken: str = "raise") -> DataFrame:
    """The records under path; with `where`, those that it holds for, its predicates pushed down.

    A condition switches spark.sql.python.filterPushdown.enabled on for the session, as Spark asks Python sources for their filters only then. Spark keeps pushed predicates with the loaded source, and a later query without any would find them still at work. So pushdown
    is on only where there is a condition to begin with, and every call loads anew. Two scans under different conditions in one
    plan need two calls.
    """
    register(spark)
    if where is not None:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    found = spark.read.format("warc").option("broken", broken).option("payload", str(payload).lower()).option("pushdown", str(where is not None).lower()).load(path)
    return found if where is None else found.where(where)


def sha1_base32(payload: str) -> Column:
    """digest() of a binary column."""
    code = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(code, at, 5), 16, 32), 4, "0") for at in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def read_archive(spark: SparkSession, path: str, *, strict: bool = False) -> DataFrame:
    """Responses and revisits under path without payload: payload_bytes and payload_digest of a response are those of the payload read back, of a revisit those its headers tell.

    strict: a response whose payload has another digest than its header tells is an error that names it.
    """
    found = read_warc(spark, path, where=F.col("record_type") == "response").withColumn("_read", sha1_base32("payload"))
    digest = F.col("_read")
    if strict:
        wrong = F.raise_error(F.concat(F.lit("the payload of "), F.col("record_id"), F.lit(" in "), F.col("path"), F.lit(" is not the one that was written")))
        digest = F.when(F.col("_read") == F.col("payload_digest"), F.col("_read")).otherwise(wrong.cast("string"))
    read = found.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": digest}).drop("_read")
    return read.unionByName(read_warc(spark, path, where=F.col("record_type") == "revisit", payload=False)).drop("payload")


def write_archive(pages: DataFrame, path: str | None = None, *, key: str = "page_id", uri: str = "url", body: str = "html", least: int = 0, **options) -> str:
    """Writes a record for each row and returns the archive's path. Of equal bodies of at least `least` bytes, the largest key's is the response and others revisit it."""
    spark = pages.sparkSession
    register(spark)
    home = path or scratch(spark, "warc")
    own = pages.select(F.col(key).alias("_key"), F.col(uri).cast("string").alias("target_uri"), F.coalesce(F.col(body).cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("_sha", F.sha1("payload"))
    shared = own.where(F.octet_length("payload") >= least).groupBy("_sha").agg(F.max("_key").alias("_first"), F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) & F.col("_first").isNotNull())
    # stored, so that its size is known when the join is planned: bodies are shuffled only if what they share is too much to send around
    shared = stored(shared.select("_sha", "_first", "_n"), "shared")
    joined = spread_join(own, shared, ["_sha"], weight="_n", total=shared.agg(F.sum("_n")).first()[0] or 0, salt=F.xxhash64("_key", "target_uri"), how="left")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    again = F.col("_first").isNotNull() & ~F.col("_key").eqNullSafe(F.col("_first"))
    rows = joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        name("_key").alias("record_id"),
        "target_uri",
        "payload",
        F.when(again, name("_first")).alias("refers_to"),
    )
    rows.write.format("warc").options(**options).mode("append").save(home)
    return home


def page_of(column: str):
    """Column: the number in a record id that write_archive gave."""
    return F.expr(f"try_cast(substring({column}, {len('urn:page:') + 1}) as bigint)")
