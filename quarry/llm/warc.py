"""WARC archives as a Spark data source, in Python: writing, planning, pushed filters and header-first reading."""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from quarry.llm.common import shared_dir

#: Payloads of fewer bytes are stored again rather than referred to.
REVISIT_FROM = 1000
#: Bytes of archive that a file may reach before the writer starts another, and that a read partition is planned for.
FILE_BYTES = 256 << 20
PLAN_BYTES = 32 << 20
READ_BYTES = 1 << 20
SCHEMA = "record_id string, record_type string, target_uri string, page_id long, payload_digest string, payload_bytes long, refers_to string, refers_to_page_id long, payload binary"
#: Columns that the header alone decides, and the header of each.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:"):
            return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def record_id(page_id: int | None) -> str:
    """The urn of a page's record, the same on every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def header_value(x: str) -> str:
    """A value that stays on its header line: control characters, blanks at the ends and per cent signs are escaped."""
    return "".join(f"%{ord(c):02X}" if c < " " or c in "%\x7f" else c for c in x).replace(" ", "%20")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, compressed as a gzip member of its own; a revisit has no block."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


class Members:
    """Reads a file of gzip members (or plain bytes) as one stream, inflating no more than is asked for."""

    def __init__(self, raw) -> None:
        self.raw, self.packed, self.plain, self.at = raw, b"", b"", 0
        head = raw.read(2)
        self.zipped = head == b"\x1f\x8b"
        self.packed = head
        self.inflate = zlib.decompressobj(31) if self.zipped else None
        self.ended = False

    def _more(self) -> bool:
        """Append some bytes to what is read; false at the end."""
        if not self.packed and not self.ended:
            self.packed = self.raw.read(READ_BYTES)
            self.ended = not self.packed
        if not self.zipped:
            new, self.packed = self.packed, b""
        else:
            had = self.packed
            new = self.inflate.decompress(had, READ_BYTES)  # without input: what it still holds back
            self.packed = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.packed = self.inflate.unused_data
                self.inflate = zlib.decompressobj(31)
            elif not had and not new:
                return False
        if not new and not self.packed and self.ended:
            return False
        self.plain, self.at = self.plain[self.at:] + new, 0
        return True

    def head(self) -> dict[str, str] | None:
        """The next record's headers in lower case, its version line apart; None at the end."""
        while True:
            end = self.plain.find(b"\r\n\r\n", self.at)
            start = self.at
            while self.plain[start:start + 2] == b"\r\n":
                start += 2
            if start != self.at:
                self.at = start
                continue
            if end >= 0:
                lines = self.plain[self.at:end].decode("utf-8", "replace").split("\r\n")
                self.at = end + 4
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no WARC record starts with {lines[0][:40]!r}")
                return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            if not self._more():
                if self.plain[self.at:].strip():
                    raise ValueError("the last record is cut off")
                return None

    def body(self, n: int, wanted: bool) -> bytes | None:
        """The record's block of n bytes; unwanted ones are passed over without being kept."""
        kept = []
        while n:
            if self.at == len(self.plain) and not self._more():
                raise ValueError("the last record is cut off")
            take = min(n, len(self.plain) - self.at)
            if wanted:
                kept.append(self.plain[self.at:self.at + take])
            self.at += take
            n -= take
        return b"".join(kept) if wanted else None


@dataclass
class Files(InputPartition):
    """Whole files that one task reads."""

    paths: list[str] = field(default_factory=list)


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)
    records: int = 0


class WarcWriter(DataSourceWriter):
    """Writes rows (page_id, url, payload, payload_digest, refers_to) as records.

    Every attempt of a task writes files of its own; only those of attempts that the driver
    accepts are named in the manifest, and the reader reads no others.
    """

    def __init__(self, path: str, file_bytes: int) -> None:
        self.path, self.file_bytes = path, file_bytes

    def write(self, rows: Iterator) -> Written:
        fs, base = file_system(self.path)
        fs.create_dir(base, recursive=True)
        task, files, n, out, size = TaskContext.get(), [], 0, None, 0
        for r in rows:
            if out is None:
                files.append(f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(files):03d}-{uuid.uuid4().hex[:8]}.warc.gz")
                out, size = fs.open_output_stream(f"{base}/{files[-1]}", compression=None), 0
            payload = bytes(r["payload"] or b"")
            raw = record(r["page_id"], r["url"], payload, r["payload_digest"], r["refers_to"])
            out.write(raw)
            n, size = n + 1, size + len(raw)
            if size >= self.file_bytes:
                out.close()
                out = None
        if out is not None:
            out.close()
        return Written(files, n)

    def commit(self, messages: list) -> None:
        fs, base = file_system(self.path)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/manifest.json") as out:
            out.write(json.dumps({"files": sorted(f for m in messages if m for f in m.files), "records": sum(m.records for m in messages if m)}).encode())

    def abort(self, messages: list) -> None:
        fs, base = file_system(self.path)
        for m in messages:
            for f in m.files if m else ():
                fs.delete_file(f"{base}/{f}")


class WarcReader(DataSourceReader):
    """Reads the manifest's files, or all *.warc and *.warc.gz where there is no manifest.

    Filters on columns that headers decide (equality and IN) are pushed: a record's header
    is parsed first and the block of a record that they reject is passed over, as is every
    block where the option payload is false. payload_digest and payload_bytes of a response
    are taken from its block when that is read, so they are proof of what was stored.
    """

    def __init__(self, path: str, payload: bool, plan_bytes: int) -> None:
        self.path, self.payload, self.plan_bytes = path, payload, plan_bytes
        self.tests: list[tuple[str, set]] = []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else ""
            if isinstance(f, (EqualTo, In)) and name in HEADERS:
                self.tests.append((name, {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, base = file_system(self.path)
        manifest = f"{base}/manifest.json"
        if fs.get_file_info(manifest).type == pafs.FileType.File:
            with fs.open_input_stream(manifest) as f:
                infos = fs.get_file_info([f"{base}/{x}" for x in json.loads(f.read())["files"]])
        else:
            infos = [x for x in fs.get_file_info(pafs.FileSelector(base, recursive=True)) if x.path.endswith((".warc", ".warc.gz"))]
        plan, size = [], self.plan_bytes
        for x in sorted(infos, key=lambda x: x.path):
            if size + x.size > self.plan_bytes or not plan:
                plan.append(Files([]))
                size = 0
            plan[-1].paths.append(x.path)
            size += x.size
        return plan or [Files([])]

    def _columns(self, h: dict) -> dict:
        digest = h.get("warc-payload-digest")
        return {
            "record_id": h.get("warc-record-id"), "record_type": h.get("warc-type"), "target_uri": h.get("warc-target-uri"),
            "payload_digest": digest.removeprefix("sha1:") if digest else None, "refers_to": h.get("warc-refers-to"),
        }

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        rows: list[tuple] = []
        size = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for path in part.paths:
            with fs.open_input_stream(path, compression=None) as raw:
                stream = Members(raw)
                while (h := stream.head()) is not None:
                    c = self._columns(h)
                    wanted = all(c[name] in values for name, values in self.tests)
                    block = stream.body(int(h.get("content-length", 0)), wanted and self.payload)
                    if not wanted:
                        continue
                    full = int(h.get("x-payload-length", h.get("content-length", 0)))
                    if block is not None and c["record_type"] == "response":
                        full, c["payload_digest"] = len(block), hashlib.sha1(block).hexdigest()
                    page, other = (int(x) if (x := h.get(k)) else None for k in ("x-page-id", "x-refers-to-page-id"))
                    rows.append((c["record_id"], c["record_type"], c["target_uri"], page, c["payload_digest"], full, c["refers_to"], other, block))
                    size += 500 + len(block or b"")
                    if size > 8 * READ_BYTES:
                        yield out()
                        rows, size = [], 0
        if rows:
            yield out()


class WarcSource(DataSource):
    """format("warc"): options path, payload (true or false), file_bytes, plan_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true", int(self.options.get("plan_bytes", PLAN_BYTES)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("file_bytes", FILE_BYTES)))


def register(spark: SparkSession) -> None:
    """Make format("warc") known and let filters reach Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_warc(pages: DataFrame, path: str, revisit_from: int = REVISIT_FROM) -> None:
    """Write a record per row of pages (page_id, url, html) to the folder `path`.

    Of rows with equal payloads of at least revisit_from bytes, the one with the largest
    page_id is a response and the others are revisits of it; smaller payloads are all
    responses. Equal means equal SHA-1 and length. A null html is an empty payload; rows
    without a page_id are responses; rows that repeat the largest page_id are responses,
    each. Other columns are left out.
    """
    register(pages.sparkSession)
    p = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumns({"payload_digest": F.sha1("payload"), "_n": F.octet_length("payload")})
    firsts = p.where(F.col("_n") >= revisit_from).groupBy(F.col("payload_digest").alias("_d"), F.col("_n").alias("_m")).agg(F.max("page_id").alias("_first"), F.count("*").alias("_copies")).where("_copies > 1").drop("_copies")
    p = p.join(firsts, (p["payload_digest"] == firsts["_d"]) & (p["_n"] == firsts["_m"]), "left")
    p = p.select("page_id", "url", "payload", "payload_digest", F.when(F.col("page_id") < F.col("_first"), F.col("_first")).alias("refers_to"))
    p.write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of a folder of archives; without payloads their digests are the headers'."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def warc_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages to archives (in the shared folder unless told) and read every record back with what it refers to.

    Returns (page_id, record_type, payload_bytes, payload_digest, refers_to, url, payload): refers_to is
    the response's page_id, as a revisit's header names it. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path)
    return read_warc(spark, path).select("page_id", "record_type", "payload_bytes", "payload_digest", F.col("refers_to_page_id").alias("refers_to"), F.col("target_uri").alias("url"), "payload")
