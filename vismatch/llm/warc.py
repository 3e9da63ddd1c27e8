"""WARC archives: writing pages with revisit records for repeated payloads, and reading them back.

Format: WARC/1.1, one gzip member for each record; an archive begins with a warcinfo record and is closed when it holds
``archive_bytes``. Archives are kept as numbered chunks of bytes in a Parquet table, so that any store Spark writes to
will do and a lost executor only costs its task; ``export_archive`` joins the chunks of one archive to a plain .warc.gz,
``read_files`` reads such files. A chunk ends with a whole record, so chunks are read where they are stored, without an
exchange; that an archive lacks none and none is there twice is found on their numbers alone.

The reader is sequential within a chunk or a file: it inflates the stream step by step with zlib, takes one record for
each gzip member, cuts the block by Content-Length, and verifies the SHA-1 digests of block and payload. Records that are neither responses nor
revisits are passed over; one without a type is an error.

Payloads are dealt by digest and page id: which page others refer to is found on ids and digests alone, so equal payloads
do not meet in one task.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest page id is a response and the
others are revisits that refer to it. Record ids are made of archive and place, so each is unique. Defined cases: null html is an empty payload; a null page id is written without
the id header and read as null, and never chosen to be referred to unless all ids of the group are null, in which case
all of them are responses; rows that repeat the largest id are all responses; an empty table gives empty archives.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, shared_dir

CHUNK_BYTES = 4 << 20
ARCHIVE_BYTES = 256 << 20
_STEP = 1 << 16
_FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _member(head: list[str], block: bytes, level: int) -> bytes:
    """One record as a gzip member."""
    head = [*head, f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def _record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, level: int, name: str = "0/0", date: str = "1970-01-01T00:00:00Z") -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{date}/{name}')}>", f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{_base32(digest)}",
    ]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return _member(head, http + (payload if refers_to is None else b""), level)


def _archived(level: int, chunk_bytes: int, archive_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive, no, size, records, held = TaskContext.get().partitionId() << 32, 0, 0, 0, bytearray()

        def info() -> bytes:
            name = uuid.uuid5(uuid.NAMESPACE_URL, f"{date}/{archive}/info")
            return _member(["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n", level)

        def chunk() -> pa.RecordBatch:
            return pa.record_batch([pa.array([archive], pa.int64()), pa.array([no], pa.int32()), pa.array([bytes(held)], pa.binary())], names=["archive", "chunk", "data"])

        for batch in batches:
            for row in range(batch.num_rows):
                page, url, payload, digest, refers = (batch.column(c)[row].as_py() for c in ("page_id", "url", "payload", "digest", "refers_to"))
                if not records:
                    held += info()
                held += _record(page, url, payload, digest, refers, level, f"{archive}/{records}", date)
                records += 1
                full = size + len(held) >= archive_bytes
                if len(held) >= chunk_bytes or full:
                    yield chunk()
                    no, size, held = no + 1, size + len(held), bytearray()
                if full:
                    archive, no, size, records = archive + 1, 0, 0, 0
        if held:
            yield chunk()

    return run


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, level: int = 6, chunk_bytes: int = CHUNK_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html); returns the archives: archive, chunk, data."""
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    counted = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    repeated = counted.groupBy("digest").agg(F.max("page_id").alias("largest"), F.sum("n").alias("n")).filter("n > 1").select("digest", "largest")
    others = counted.join(repeated, "digest").filter(~F.col("page_id").eqNullSafe(F.col("largest")))
    others = others.select(F.col("digest").alias("_digest"), F.col("page_id").alias("_page"), F.col("largest").alias("refers_to"))
    joined = rows.join(others, (F.col("digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_page")), "left")
    date = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    records = joined.select("page_id", "url", "payload", "digest", "refers_to")
    return materialise(records.mapInArrow(_archived(level, chunk_bytes, archive_bytes, date), "archive long, chunk int, data binary"), path)


class WarcError(ValueError):
    """The stream breaks the format, or a digest does not agree."""


def inflate_members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The content of each gzip member; members may begin and end anywhere in the chunks."""
    inflate, out = None, bytearray()
    for chunk in chunks:
        for at in range(0, len(chunk), _STEP):
            data = chunk[at : at + _STEP]
            while data:
                if inflate is None:
                    inflate = zlib.decompressobj(31)
                try:
                    out += inflate.decompress(data)
                except zlib.error as e:
                    raise WarcError(f"gzip: {e}") from e
                data = inflate.unused_data
                if inflate.eof:
                    yield bytes(out)
                    inflate, out = None, bytearray()
    if inflate is not None:
        raise WarcError("the last gzip member is cut off")


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode("utf-8", "replace").split("\r\n")[1:])}


def parse_record(member: bytes) -> dict:
    """The fields of the report and the payload of a response or revisit; of other records just the type. Digests are
    verified."""
    raw, end, rest = member.partition(b"\r\n\r\n")
    if not end or not raw.startswith(b"WARC/1."):
        raise WarcError("no WARC header")
    head = _headers(raw)
    try:
        size = int(head["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("no content length") from e
    block, tail = rest[:size], rest[size:]
    if len(block) != size or tail != b"\r\n\r\n":
        raise WarcError("the record's length does not agree with its content length")
    if (want := head.get("warc-block-digest")) and want != f"sha1:{_base32(hashlib.sha1(block).digest())}":
        raise WarcError("block digest")
    kind = head.get("warc-type")
    if not kind:
        raise WarcError("no type")
    if kind not in ("response", "revisit"):
        return {"record_type": kind}
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and digest and digest != _base32(hashlib.sha1(payload).digest()):
        raise WarcError("payload digest")
    page = head.get("warc-page-id")
    refers = head.get("warc-refers-to-page-id")
    length = len(payload) if kind == "response" else int(_headers(http).get("content-length", 0))
    return {
        "page_id": int(page) if page else None, "payload_bytes": length, "payload_digest": digest, "record_type": kind,
        "refers_to": int(refers) if kind == "revisit" and refers else None, "url": head.get("warc-target-uri"), "payload": payload,
    }


def _rows(streams: Iterator[Iterator[bytes]], keep: tuple[str, ...], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The responses and revisits of archives, each a stream of bytes."""
    held: list[dict] = []
    for chunks in streams:
        for member in inflate_members(chunks):
            record = parse_record(member)
            if record["record_type"] not in ("response", "revisit"):
                continue
            held.append({k: v for k, v in record.items() if k in keep})
            if len(held) >= 500:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _read(keep: tuple[str, ...], schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(([x.as_py()] for batch in batches for x in batch.column("data")), keep, schema)

    return run


def _streamed(uri: str) -> Iterator[bytes]:
    """A file's bytes, a few at a time, from a store that pyarrow reads (local, HDFS, S3, GCS)."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if re.match("file:/[^/]", uri) else uri)
    with store.open_input_stream(path, compression=None) as file:
        while data := file.read(_STEP * 16):
            yield data


_ARROW = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "payload": pa.binary()}


def _kept(payloads: bool) -> tuple[tuple[str, ...], pa.Schema, str]:
    keep = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(("url", "payload") if payloads else ()))
    return keep, pa.schema([(k, _ARROW[k]) for k in keep]), _FIELDS + (", url string, payload binary" if payloads else "")


def _check_chunks(archives: DataFrame) -> None:
    """Raise unless each archive has its chunks from 0 to its last, each once. Only numbers are read, a row an archive is dealt."""
    found = archives.groupBy("archive").agg(F.count("*").alias("n"), F.count_distinct("chunk").alias("distinct"), F.min("chunk").alias("first"), F.max("chunk").alias("last"))
    whole = (F.col("first") == 0) & (F.col("n") == F.col("last") + 1) & (F.col("distinct") == F.col("n"))
    if wrong := found.filter(~F.coalesce(whole, F.lit(False))).select("archive").head(1):
        raise WarcError(f"archive {wrong[0][0]}: a chunk is missing or there twice")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of archives (archive, chunk, data) whose chunks hold whole records, as write_archives cuts them; each
    chunk is read by the task that scans it. An archive that lacks a chunk before its last is refused at once."""
    _check_chunks(archives)
    keep, schema, fields = _kept(payloads)
    return archives.select("data").mapInArrow(_read(keep, schema), fields)


def read_files(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the .warc.gz files of any size under path: Spark lists them, tasks read them as streams."""
    keep, schema, fields = _kept(payloads)
    files = spark.read.format("binaryFile").load(path).select("path").repartition("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows((_streamed(uri) for batch in batches for uri in batch.column("path").to_pylist()), keep, schema)

    return files.mapInArrow(run, fields)


def export_archive(archives: DataFrame, archive: int, file: str) -> None:
    """Join the chunks of one archive to a plain .warc.gz on the driver, a chunk at a time."""
    with open(file, "wb") as out:
        for row in archives.filter(F.col("archive") == archive).orderBy("chunk").toLocalIterator():
            out.write(row["data"])


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages as archives in the shared folder and return what the reader finds in them."""
    return read_archives(write_archives(pages, f"{shared_dir(pages.sparkSession)}/archives", min_bytes))
