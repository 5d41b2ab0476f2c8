"""WARC archives: a deterministic sharded writer, and a reader that checks every digest.

Records are sorted by page id over contiguous ranges of ids, one range a task. A task rolls its files by compressed size (each record is
a gzip member of its own), regenerates all headers and digests, and writes under temporary names; only when Spark has committed the list
of the files of the tasks that succeeded does the driver rename these and, last, put the manifest in place. A failed or repeated task
leaves nothing that the manifest names, and equal input gives equal bytes.

Of the records with equal payloads of ``least_bytes`` or more, that with the smallest page id is the response and the others revisit it;
all smaller payloads are responses. A null html is an empty payload, a null url becomes ``urn:page:<id>``. Rows that share id and payload
are one response and revisits of it (equal rows have a record each). Rows without an id come first, revisit an equal payload that has an id,
and are never referred to. An empty table gives a manifest without files. A payload is one record, however long, and may exceed the roll
size alone. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import Workspace, balanced_cuts, deal, in_span, named, partitions, table, uri

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = -(1 << 63)
FILES = pa.schema([("name", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


def _record_id(page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}:{digest}:{copy}')}>"


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member; no time or name goes into it."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0) as zipped:
        zipped.write(head.encode() + block + b"\r\n\r\n")
    return out.getvalue()


def _http(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def _page(page_id: int | None, url: str | None, payload: bytes, digest: str, copy: int, refers_to: int | None, revisit: bool, date: str) -> bytes:
    target = f"urn:page:{page_id}" if url is None else "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    block = _http(len(payload)) + (b"" if revisit else payload)
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, digest, copy)), ("WARC-Date", date), ("WARC-Target-URI", target)]
    headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http;msgtype=response")]
    headers += [("X-Page-Id", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(len(payload)))]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest, 0)), ("X-Refers-To-Page-Id", str(refers_to))]
    return _member(headers, block)


class _Roller:
    """Writes members to files of about ``limit`` bytes under temporary names."""

    def __init__(self, folder: str, shard: int, limit: int, date: str):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.shard, self.limit, self.date = shard, limit, date
        context = TaskContext.get()
        self.attempt = f"{context.taskAttemptId() if context else 0}-{uuid.uuid4().hex[:8]}"
        self.done: list[tuple] = []
        self.out = None

    def add(self, member: bytes) -> None:
        if self.out is not None and self.records > 0 and self.size + len(member) > self.limit:
            self.close()
        if self.out is None:
            self.name = f"{self.shard:06d}-{len(self.done):06d}.warc.gz"
            self.temporary = f"{self.name}.{self.attempt}.tmp"
            self.fs.create_dir(f"{self.root}/temporary", recursive=True)
            self.out = self.fs.open_output_stream(f"{self.root}/temporary/{self.temporary}", compression=None)
            self.size, self.records, self.sha = 0, -1, hashlib.sha256()
            block = b"format: WARC File Format 1.1\r\n"
            headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, self.name)}>"), ("WARC-Date", self.date)]
            self._put(_member([*headers, ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], block))
        self._put(member)

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.temporary, self.records, self.size, self.sha.hexdigest()))
            self.out = None


def _write(folder: str, limit: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, before, copies, marks = None, None, 0, {}
        done: list[tuple] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(6)]
            for k, (shard, key, digest, mark, page_id, url) in enumerate(zip(*columns, strict=True)):
                if roller is None or roller.shard != shard:
                    if roller:
                        roller.close()
                        done += roller.done
                    roller = _Roller(folder, shard, limit, date)
                if (key, digest) != before:
                    before, copies, marks = (key, digest), 0, {}
                if mark is not None:  # sorts before the page that it is for
                    marks[digest] = mark
                    continue
                payload = (batch.column(6)[k].as_py() or "").encode()
                large = batch.column(7)[k].as_py()
                refers_to = marks.get(digest, page_id if copies and large else None)
                roller.add(_page(page_id, url, payload, digest, copies, refers_to, refers_to is not None, date))
                copies += 1
        if roller:
            roller.close()
            done += roller.done
        yield table(FILES, *(map(list, zip(*done, strict=True)) if done else [[] for _ in FILES]))

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roll_bytes: int = 64 << 20, least_bytes: int = 100, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes ``folder/*.warc.gz`` and ``folder/manifest.json``. One shuffle of the payloads; which of them revisit is found on digests alone."""
    spark = pages.sparkSession
    ws = Workspace(spark, "warc")
    html = F.coalesce(named(html_col).cast("string"), F.lit(""))
    rows = pages.select(named(id_col).cast("long").alias("page_id"), named(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"k": F.coalesce("page_id", F.lit(NO_ID)), "digest": F.sha2("html", 256), "large": F.octet_length("html") >= least_bytes})
    narrow = rows.where("large").select("k", "page_id", "digest")
    first = ws.write(narrow.groupBy("digest").agg(F.min("page_id").alias("mark"), F.count("*").alias("n")).where("n > 1 and mark is not null").drop("n"), "first")
    marks = narrow.join(first, "digest").where("page_id is null or page_id > mark").select("k", "digest", "mark").distinct()
    cuts = balanced_cuts(rows, "k", F.octet_length("html") + 512, partitions(spark))
    both = rows.withColumn("mark", F.lit(None).cast("long")).unionByName(marks, allowMissingColumns=True).withColumn("shard", in_span("k", cuts))
    order = [F.asc("shard"), F.asc("k"), F.asc("digest"), F.asc_nulls_last("mark"), F.asc("url")]
    dealt = deal(both, partitions(spark), "shard").sortWithinPartitions(*order).select("shard", "k", "digest", "mark", "page_id", "url", "html", "large")
    files = ws.write(dealt.mapInArrow(_write(folder, roll_bytes, date), "name string, temporary string, records long, bytes long, sha256 string"), "files")
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    listed = sorted(files.collect(), key=lambda r: r["name"])  # a row for each file
    for r in listed:
        store.move(f"{root}/temporary/{r['temporary']}", f"{root}/{r['name']}")
    manifest = {"format": "warc-shards-1", "date": date, "files": [{k: r[k] for k in ("name", "records", "bytes", "sha256")} for r in listed]}
    with store.open_output_stream(f"{root}/manifest.json.tmp", compression=None) as out:
        out.write(json.dumps(manifest, sort_keys=True).encode())
    store.move(f"{root}/manifest.json.tmp", f"{root}/manifest.json")
    if store.get_file_info(f"{root}/temporary").type != pafs.FileType.NotFound:
        store.delete_dir(f"{root}/temporary")


def _members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    machine, parts, left = zlib.decompressobj(31), [], b""
    while data := left or stream.read(size):
        parts.append(machine.decompress(data))
        left = b""
        if machine.eof:
            yield b"".join(parts)
            left, machine, parts = machine.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("an archive ends within a record")


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a record: {lines[0]!r}")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, rest[:n]


RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("file", pa.string())])
RECORDS_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string"


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        for name in (n for b in batches for n in b.column(0).to_pylist()):
            rows: list[list] = [[] for _ in RECORDS]
            with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                for member in _members(stream):
                    headers, block = parse_record(member)
                    kind = headers["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    if headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
                        raise ValueError(f"a block's digest is wrong in {name}")
                    payload = block.partition(b"\r\n\r\n")[2]
                    n, digest = int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response":
                        n, own = len(payload), hashlib.sha256(payload).hexdigest()
                        if own != digest:
                            raise ValueError(f"a payload's digest is wrong in {name}")
                    number = lambda h: int(headers[h]) if headers.get(h) else None  # noqa: B023, E731
                    for row, x in zip(rows, (number("X-Page-Id"), n, digest, kind, number("X-Refers-To-Page-Id"), headers["WARC-Target-URI"], name), strict=True):
                        row.append(x)
                    if len(rows[0]) >= 10_000:
                        yield table(RECORDS, *rows)
                        rows = [[] for _ in RECORDS]
            yield table(RECORDS, *rows)

    return run


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each response and revisit of the files that the manifest names, digests checked; a task reads whole files."""
    store, root = pafs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/manifest.json", compression=None) as stream:
        names = [f["name"] for f in json.loads(stream.read())["files"]]
    if not names:
        return spark.createDataFrame([], RECORDS_DDL)
    listed = spark.createDataFrame([(n,) for n in names], "name string").repartition(min(len(names), max(1, 4 * partitions(spark))))
    return listed.mapInArrow(_read(folder), RECORDS_DDL)


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back."""
    folder = uri(Workspace(pages.sparkSession, "warc-archives").path("archives"))
    write_archives(pages, folder, **options)
    return read_archives(pages.sparkSession, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
