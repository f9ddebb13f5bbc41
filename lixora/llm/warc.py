"""WARC archives and a two-level capture index.

``write_archives`` makes one WARC/1.1 record per page and writes .warc.gz files of records that are compressed one
by one; a file ends at FILE_BYTES. Of pages with equal payloads of at least ``least_bytes`` bytes the one with the
smallest page_id is a response, the others are revisits that name it; smaller payloads are always responses.

``build_index`` reads the archives front to back, a piece at a time, and sorts the captures by reversed-host key
(com,example)/path). Runs of ``BLOCK`` lines become compressed blocks; the directory holds each block's first key
alone. A directory of more than MOST_TOP blocks is cut into sorted, compressed blocks itself, with a directory of
their first keys above it, and so on. ``lookup`` finds a key's block by binary search in the topmost directory, then
searches the lines of that block, down to the places of the key's captures; ``read_captures`` reads these byte
ranges with a seek each (ranges close to each other in one read) and parses the records; no archive is read whole.
Archives must lie where pyarrow's file systems reach them (local or mounted folders, hdfs, s3, gs, abfs).

Null html: an empty payload. Null url: no target, the key is empty. A null page_id is never a revisit and names no
other page. Repeated rows give a record each; rows that share the smallest page_id of a payload are all
responses. Extra columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lixora.llm.common import join_hot, new_path, partitions_for, saved

#: Bytes of one archive file, lines of one index block, blocks whose first keys are sent to every task.
FILE_BYTES, BLOCK, MOST_TOP = 64 << 20, 1_000, 50_000
#: Up to so many revisits are broadcast (about 50 bytes each).
MOST_BROADCAST = 100_000
#: Bytes that one step of a scan reads; captures of one stretch of a file are read by one task; captures not
#: further apart than GAP share a read of at most MOST_READ bytes (unless one capture alone is larger).
STEP, STRETCH, GAP, MOST_READ = 64 << 10, 16 << 20, 64 << 10, 8 << 20
#: Partitions that an index or a reading is cut into at most; a task streams what it has, so larger ones need no more memory.
MOST_PARTS = 20_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's bytes: 5 hex digits at a time are 4 of base32."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def clean(url: str) -> str:
    """url without bare control characters or blanks, as a header line needs it."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)


def surt(url: str | None) -> str:
    """Sort-friendly key of a URL: reversed host, then path and query; scheme, user and fragment are dropped."""
    url = clean(url or "")
    try:
        u = urlsplit(url)
        host = ",".join(reversed((u.hostname or "").split(".")))
        port = f":{u.port}" if u.port not in (None, 80, 443) else ""
    except ValueError:
        return url
    return f"{host}{port}){u.path or '/'}" + (f"?{u.query}" if u.query else "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {clean(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers and payload of one record; a revisit's payload is None."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda name: int(x) if (x := re.sub(r"^<urn:page:|>$", "", fields.get(name, ""))) else None
    kind = fields["WARC-Type"]
    return {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to": number("WARC-Refers-To"), "payload_digest": fields["WARC-Payload-Digest"][5:], "payload_bytes": size, "payload": payload if kind == "response" else None}


def members(stream):
    """(offset, length, head) of each gzip member of a stream that is read front to back; head: up to the first
    empty line at least."""
    at, data = 0, b""
    while data or (data := stream.read(STEP)):
        opened, head, length = zlib.decompressobj(31), b"", 0
        while not opened.eof:
            if not data and not (data := stream.read(STEP)):
                raise ValueError(f"the record at byte {at} is cut off")
            got = opened.decompress(data)
            length += len(data) - len(opened.unused_data)
            data = opened.unused_data
            if b"\r\n\r\n" not in head:
                head += got
        yield at, length, head
        at += length


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class ArchiveWriter(DataSourceArrowWriter):
    """Writes rows (page_id, url, html, digest, refers_to) as records. Files have names of their own; a commit
    removes those of attempts that failed."""

    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes = path, file_bytes

    def write(self, iterator) -> Written:
        store, root = FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        files, out, held = [], None, 0
        for b in iterator:
            for page_id, url, html, digest, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                data = gzip.compress(record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to), 5, mtime=0)
                if out is None or held + len(data) > self.file_bytes:
                    if out is not None:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, held = store.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                out.write(data)
                held += len(data)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages) -> None:
        store, root = FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        whole = {f for m in messages if m for f in m.files}
        for info in store.get_file_info(FileSelector(root)):
            if info.base_name not in whole:
                store.delete_file(info.path)

    def abort(self, messages) -> None:
        self.commit([])


class Archives(DataSource):
    """The sink of ``write_archives``."""

    @classmethod
    def name(cls) -> str:
        return "warc_archives"

    def schema(self) -> str:
        return "page_id long, url string, html string, digest string, refers_to long"

    def writer(self, schema, overwrite) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], int(self.options["bytes"]))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write one record per page to .warc.gz files under path. A folder that holds anything already is refused, as a commit
    takes what it didn't write for the rest of a failed attempt."""
    store, root = FileSystem.from_uri(path)
    if store.get_file_info(root).type != FileType.NotFound and store.get_file_info(FileSelector(root)):
        raise ValueError(f"{path} isn't empty")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", base32_sha1(F.col("html")))
    keys = saved(pages.select("page_id", "digest", F.octet_length("html").alias("size")), "digests")
    firsts = saved(keys.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1"), "firsts")
    revisits = saved(join_hot(keys, firsts, "digest", "n").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct(), "revisits")
    revisits = F.broadcast(revisits) if revisits.count() <= MOST_BROADCAST else revisits
    rows = pages.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")
    pages.sparkSession.dataSource.register(Archives)
    rows.write.format("warc_archives").option("path", path).option("bytes", file_bytes).mode("append").save()


CAPTURE = "key string, page_id long, file string, offset long, length long"


def captures(spark: SparkSession, path: str) -> DataFrame:
    """(key, page_id, file, offset, length) of each record in the archives under path; file: its name there."""

    def fn(batches):
        store, root = FileSystem.from_uri(path)
        for b in batches:
            for file in b.column("file").to_pylist():
                rows = []
                with store.open_input_file(f"{root}/{file}") as stream:
                    for offset, length, head in members(stream):
                        text = head[: head.index(b"\r\n\r\n")].decode("utf-8", "surrogatepass")
                        url = re.search(r"^WARC-Target-URI: (.*?)\r?$", text, re.M)
                        number = re.search(r"^WARC-Record-ID: <urn:page:(-?\d*)>", text, re.M)[1]
                        rows.append((surt(url[1] if url else None), int(number) if number else None, file, offset, length))
                        if len(rows) == 10_000:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select(F.substring_index("path", "/", -1).alias("file"))
    return files.mapInArrow(fn, CAPTURE)


SCHEMA = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SCHEMA.types)], SCHEMA.names)


def blocks(rows: DataFrame, level: int, block: int) -> DataFrame:
    """Blocks of rows sorted by all columns, ``key`` first: (level, block, first_key, lines, data)."""
    schema = pa.schema([("level", pa.int32()), ("block", pa.int64()), ("first_key", pa.string()), ("lines", pa.int32()), ("data", pa.binary())])
    names = rows.columns

    def fn(batches):
        number, held = TaskContext.get().partitionId() << 33, []

        def made(lines):
            nonlocal number
            number += 1
            text = "\n".join("\t".join("" if x is None else str(x) for x in r) for r in lines)
            return level, number, lines[0][0], len(lines), zlib.compress(text.encode("utf-8", "surrogatepass"), 6)

        for b in batches:
            held += zip(*(b.column(c).to_pylist() for c in names))
            full = [made(held[i : i + block]) for i in range(0, len(held) - block, block)]
            held = held[len(full) * block :]
            if full:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*full))), schema=schema)
        if held:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(made(held)))), schema=schema)

    parts = min(max(1, rows.count() // (4 * block)), MOST_PARTS)
    ordered = rows.repartitionByRange(parts, *names).sortWithinPartitions(*names)
    return saved(ordered.mapInArrow(fn, "level int, block long, first_key string, lines int, data binary"), "index")


def build_index(found: DataFrame, block: int = BLOCK, most_top: int = MOST_TOP) -> DataFrame:
    """Blocks of sorted captures (level 0), and of the directory as long as that has more than most_top entries."""
    levels = [blocks(found.select(*SCHEMA.names), 0, block)]
    while levels[-1].count() > most_top:
        levels.append(blocks(levels[-1].select(F.col("first_key").alias("key"), "block"), len(levels), block))
    whole = levels[0]
    for x in levels[1:]:
        whole = whole.unionByName(x)
    return whole


def lines_of(data: bytes) -> list[list[str]]:
    return [line.split("\t") for line in zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n")]


def around(firsts: list[str], key: str) -> range:
    """Which of the sorted runs with these first keys can hold a key: the one before the first that starts at it can
    end with it."""
    return range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key))


def lookup(index: DataFrame, keys: DataFrame) -> DataFrame:
    """The captures of every distinct key of ``keys(key)``: a search of the topmost directory, then of a block of
    each level."""
    keys = keys.select("key").dropna().distinct()
    names = SCHEMA.names
    top = index.agg(F.max("level")).first()[0] or 0
    directory = sorted((r["first_key"], r["block"]) for r in index.where(F.col("level") == top).select("first_key", "block").collect())
    firsts, numbers = [d[0] for d in directory], [d[1] for d in directory]

    def place(batches):
        for b in batches:
            out = [(key, numbers[i]) for key in b.column("key").to_pylist() for i in around(firsts, key)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64())], ["key", "block"])

    def down(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        for data in held["data"]:
            rows = lines_of(data)
            order = [r[0] for r in rows]
            out += [(key, int(rows[i][1])) for key in asked["key"] for i in around(order, key)]
        return pd.DataFrame(out, columns=["key", "block"]).astype({"block": "int64"})

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        for data in held["data"]:
            rows = [(k, int(p) if p else None, f, int(o), int(n)) for k, p, f, o, n in lines_of(data)]
            order = [r[0] for r in rows]
            for key in asked["key"]:
                out += rows[bisect_left(order, key) : bisect_right(order, key)]
        return pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "offset": "int64", "length": "int64"})

    placed = keys.mapInArrow(place, "key string, block long")
    for level in range(top, -1, -1):
        held = index.where(F.col("level") == level).select("block", "data").groupBy("block")
        step, schema = (down, "key string, block long") if level else (search, CAPTURE)
        placed = placed.groupBy("block").cogroup(held).applyInPandas(step, schema)
    return placed


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_captures(spark: SparkSession, found: DataFrame, path: str) -> DataFrame:
    """Read the byte ranges of captures back; a response whose payload doesn't have its digest is an error."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def checked(data: bytes) -> dict:
        got = parse_record(gzip.decompress(data))
        payload = got.pop("payload")
        if payload is not None and (len(payload) != got["payload_bytes"] or base64.b32encode(hashlib.sha1(payload).digest()).decode() != got["payload_digest"]):
            raise ValueError(f"page {got['page_id']}: the payload read back differs")
        return got

    def fn(batches):
        store, root = FileSystem.from_uri(path)
        name = stream = None
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length"))))
            at = 0
            while at < len(rows):
                file, begin, length = rows[at]
                end, to = begin + length, at + 1
                while to < len(rows) and rows[to][0] == file and 0 <= rows[to][1] - end <= GAP and rows[to][1] + rows[to][2] - begin <= MOST_READ:
                    end, to = rows[to][1] + rows[to][2], to + 1
                if file != name:
                    if stream:
                        stream.close()
                    name, stream = file, store.open_input_file(f"{root}/{file}")
                stream.seek(begin)
                data = memoryview(stream.read(end - begin))
                yield pa.RecordBatch.from_pylist([checked(data[o - begin : o - begin + n]) for _, o, n in rows[at:to]], schema=schema)
                at = to
        if stream:
            stream.close()

    count = found.agg(F.sum("length")).first()[0] or 0
    stretch = F.floor(F.col("offset") / STRETCH)
    dealt = found.select("file", "offset", "length").repartition(max(partitions_for(spark), min(count // STRETCH, MOST_PARTS)), "file", stretch)
    return dealt.sortWithinPartitions("file", "offset").mapInArrow(fn, RECORD)


def fetch(path: str, file: str, offset: int, length: int) -> dict:
    """One record, by a seek in its archive."""
    store, root = FileSystem.from_uri(path)
    with store.open_input_file(f"{root}/{file}") as stream:
        stream.seek(offset)
        return parse_record(gzip.decompress(stream.read(length)))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages to archives, index them, look every page's URL up and read its records back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, least_bytes)
    index = build_index(saved(captures(spark, path), "captures"))

    def keyed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in b.column("url").to_pylist()], pa.string())], ["key"])

    found = saved(lookup(index, pages.select(F.col("url").cast("string").alias("url")).mapInArrow(keyed, "key string")), "found")
    return read_captures(spark, found, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
