"""WARC archives with a two-level capture index.

Writing: equal payloads are found by digest; the one with the largest id is a response and
the others become revisits. Each task writes archives of compressed records (one gzip member
a record) to the shared folder and hands on where each record lies.

Index: captures are sorted by their reversed-host URL key, cut into blocks of lines, and the
blocks compressed; a sparse directory has one entry per block. A lookup binary-searches the
directory for the block and the block for its lines, and reads the record by its range.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import hinted, shared_dir, slices, written

#: Payloads shorter than this are stored again each time.
LEAST_BYTES = 1000
#: An archive is closed once it has this many bytes.
ARCHIVE_BYTES = 1 << 28
LEVEL = 4
#: Lines of an index block: this, or more where the directory would pass MOST_BLOCKS.
BLOCK_LINES, MOST_BLOCKS = 1000, 200_000
#: Characters of a key that the directory holds: with MOST_BLOCKS the bound of its size.
DIRECTORY_CHARS = 128
#: Wanted keys of one block that are searched at once.
ASKED = 10_000
#: Duplicate digests that are broadcast; more are joined as any table.
BROADCAST_DIGESTS = 200_000
#: Bytes of an archive that one reading task takes.
READ_BYTES = 4 << 20
#: Records that a reading task holds at one time.
PAGES = 256
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:pulsegrid:page:"
CRLF = b"\r\n"

CAPTURE = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
    ]
)
BLOCK = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("first", T.StringType()),
        T.StructField("last", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("data", T.BinaryType()),
    ]
)
RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.StringType()),
    ]
)


def surt(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then port, path and query; "" for null."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:  # not a URL: its text is its key
        return url.lower()
    tail = parts.path + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}{f':{port}' if port else ''}){tail}".lower()


def line_key(url: str | None, page_id: int | None) -> str:
    """Key of an index line: the URL key, then the page id in sortable form."""
    name = "-" if page_id is None else f"{page_id + 2**63:020d}"
    return re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02x}", surt(url)) + " " + name


def file_system(uri: str):
    """(pyarrow file system, path) of a folder or file that any process reaches by its URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI with its scheme."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return re.sub(r"^file:/+", "file:///", uri)


def classified(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Append payload (string), payload_bytes, payload_digest (lower-case hex SHA-1) and
    refers_to (null for responses) to page_id and url."""
    payload = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    pages = pages.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    pages = pages.withColumn("payload_digest", F.sha1(F.encode("payload", "UTF-8")))
    again = pages.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes")
    again = again.agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = hinted(written(again, "warc_again"), BROADCAST_DIGESTS)
    refers = F.when(F.col("page_id") != F.col("largest"), F.col("largest")).when(F.col("page_id").isNull(), F.col("largest"))
    return pages.join(again, ["payload_digest", "payload_bytes"], "left").withColumn("refers_to", refers).drop("largest")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed."""
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    block = http if refers_to is not None else http + payload
    name = page_id if page_id is not None else f"null:{uuid.uuid4()}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID}{name}>", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2


def parsed(data: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of a record;
    ValueError where a length or a digest does not hold."""
    head, rest = data.split(CRLF * 2, 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != CRLF * 2:
        raise ValueError(f"record {fields.get('WARC-Record-ID')} is cut or overlong")
    http, payload = rest[:size].split(CRLF * 2, 1)
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    number = lambda name: None if "null" in fields[name] else int(fields[name].removeprefix(f"<{ID}").rstrip(">"))
    return number("WARC-Record-ID"), length, digest, kind, number("WARC-Refers-To") if kind == "revisit" else None, payload.decode() if kind == "response" else None


def write(pages: DataFrame, folder: str, least: int = LEAST_BYTES) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) and return the captures.

    An archive's name is new in every attempt of a task, and captures come from successful
    attempts only, so what a lost or repeated attempt has written is never read.
    """
    rows = classified(pages, least).select("page_id", "url", "payload", "payload_digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        out, path, at = None, "", 0
        for batch in (part for whole in batches for part in slices(whole, "payload")):
            found = []
            for row in batch.to_pylist():
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    path, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{root}/{path}", compression=None)
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)  # 31: a gzip member
                data = packer.compress(record(row["page_id"], row["url"], row["payload"].encode(), row["payload_digest"], row["refers_to"])) + packer.flush()
                out.write(data)
                found.append((line_key(row["url"], row["page_id"]), row["page_id"], path, at, len(data)))
                at += len(data)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=CAPTURE.names)
        if out is not None:
            out.close()

    return written(rows.mapInArrow(run, CAPTURE), "captures")


def index(captures: DataFrame) -> DataFrame:
    """Blocks (block, first, last, n, data) of the captures sorted by key: compressed lines of
    key, file, offset and length. Holds one block's lines at a time. block is a number of the
    block's own: the lines of a key that many captures have may fill several blocks."""
    size = max(BLOCK_LINES, -(-captures.count() // MOST_BLOCKS))

    def made(block: int, lines: list[str]) -> pa.RecordBatch:
        first, last = (lines[i].split("\t", 1)[0] for i in (0, -1))
        data = zlib.compress("\n".join(lines).encode(), 6)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((block, first, last, len(lines), data), kinds, strict=True)], names=BLOCK.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, lines = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            for row in batch.to_pylist():
                lines.append(f"{row['key']}\t{row['file']}\t{row['offset']}\t{row['length']}")
                if len(lines) == size:
                    yield made(block, lines)
                    block, lines = block + 1, []
        if lines:
            yield made(block, lines)

    order = ["key", "file", "offset"]
    parts = max(1, captures.rdd.getNumPartitions())
    return written(captures.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, BLOCK), "blocks")


def directory(blocks: DataFrame) -> list[tuple[bytes, bytes, int]]:
    """The sparse directory: (first, last, block) of every block in order, keys cut to
    DIRECTORY_CHARS; of MOST_BLOCKS and one per partition at most."""
    ends = (F.substring(c, 1, DIRECTORY_CHARS).alias(c) for c in ("first", "last"))
    # Keys are ASCII but for characters of the URL: compared as UTF-8, as Spark sorts them.
    return sorted((r["first"].encode(), r["last"].encode(), r["block"]) for r in blocks.select(*ends, "block").collect())


def lookup(keys: DataFrame, blocks: DataFrame) -> DataFrame:
    """Captures (key, file, offset, length) of the wanted line keys (column key).

    Keys that no line has give no row; a key that several lines have gives each of them once,
    however many blocks they fill and however often the key is asked for.
    """
    spark = keys.sparkSession
    table = spark.sparkContext.broadcast(directory(blocks))
    wanted = T.StructType([T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(T.StringType()))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks that may hold each key. Keys come sorted, so those of a block together."""
        firsts, lasts, numbers = zip(*table.value) if table.value else ((), (), ())
        for batch in batches:
            asked: dict[int, list[str]] = {}
            for key in batch.column("key").to_pylist():
                cut = key[:DIRECTORY_CHARS].encode()
                for i in range(bisect.bisect_left(lasts, cut), bisect.bisect_right(firsts, cut)):
                    asked.setdefault(numbers[i], []).append(key)
            pairs = [(k, v[i : i + ASKED]) for k, v in asked.items() for i in range(0, len(v), ASKED)]
            if pairs:
                block, names = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(list(block), pa.int64()), pa.array(list(names), pa.list_(pa.string()))], names=wanted.names)

    lines = T.StructType([f for f in CAPTURE.fields if f.name != "page_id"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held = [x.split("\t") for x in zlib.decompress(row["data"]).decode().split("\n")]
                names = [x[0].encode() for x in held]
                found = []
                for key in map(str.encode, row["keys"]):
                    found += held[bisect.bisect_left(names, key) : bisect.bisect_right(names, key)]
                if found:
                    key, file, offset, length = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(list(key)), pa.array(list(file)), pa.array(list(map(int, offset))), pa.array(list(map(int, length)))], names=lines.names)

    sorted_keys = written(keys.select("key").distinct(), "asked").repartitionByRange("key").sortWithinPartitions("key")
    asked = sorted_keys.mapInArrow(find, wanted)
    return asked.join(blocks.select("block", "data"), "block").select("data", "keys").mapInArrow(search, lines)


def fetch(captures: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Read the records at (file, offset, length) by range, checked against their digests.

    The captures are small whatever their records weigh, so their partitions are numbered by
    the bytes of the records: adaptive execution would put them all into one task."""
    captures = written(captures, "wanted")
    parts = max(captures.sparkSession.sparkContext.defaultParallelism, (captures.agg(F.sum("length")).first()[0] or 0) // READ_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        name, source = None, None
        for batch in (whole.slice(i, PAGES) for whole in batches for i in range(0, whole.num_rows, PAGES)):
            found = []
            for row in batch.to_pylist():
                if row["file"] != name:
                    if source is not None:
                        source.close()
                    name, source = row["file"], system.open_input_file(f"{root}/{row['file']}")
                source.seek(row["offset"])
                values = parsed(zlib.decompress(source.read(row["length"]), 31))
                found.append(values if with_payload else (*values[:5], None))
            if found:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), kinds)], names=RECORD.names)
        if source is not None:
            source.close()

    piece = F.floor(F.col("offset") / READ_BYTES)
    return captures.withColumn("piece", piece).repartition(parts, "file", "piece").sortWithinPartitions("file", "offset").select("file", "offset", "length").mapInArrow(run, RECORD)


def keys_of(pages: DataFrame) -> DataFrame:
    """Line keys (column key) of page_id and url."""
    schema = T.StructType([T.StructField("key", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("url").to_pylist(), batch.column("page_id").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([line_key(u, p) for u, p in pairs], pa.string())], names=["key"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(run, schema)


def archive(pages: DataFrame, least: int = LEAST_BYTES) -> tuple[str, DataFrame]:
    """Write pages and their index to a new shared folder; (folder, blocks)."""
    spark = pages.sparkSession
    folder = qualified(spark, shared_dir(spark, "warc"))
    return folder, index(write(pages, folder, least))


def round_trip(pages: DataFrame, least: int = LEAST_BYTES, with_payload: bool = True) -> DataFrame:
    """Archive pages (page_id, url, html) and read every record back through the index:
    page_id, payload_bytes, payload_digest, record_type, refers_to, payload.

    A null html is an empty payload; a null url has an empty key; a null page_id comes back
    as null, and with a long payload that other pages have it revisits the largest id (if
    all their ids are null, each is a response). Rows that repeat a page_id each have a
    record, of equal type. An empty table gives an empty one. Payload is null for revisits.
    """
    folder, blocks = archive(pages, least)
    return fetch(lookup(keys_of(pages), blocks), folder, with_payload)


#: The same rows in DuckDB, for pages.
ROUND_TRIP_SQL = f"""
WITH page AS (
  SELECT page_id::BIGINT AS page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
equal AS (
  SELECT *, CASE WHEN payload_bytes >= {LEAST_BYTES} THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS largest
  FROM page)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM equal
"""
