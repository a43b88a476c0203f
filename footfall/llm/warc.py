"""WARC archives of pages: records, writing with revisits, reading back.

An archive is a run of gzip members, one for each record, so a record can be read by
its offset and length alone. Spark's own text writer writes the files, which gives its
commit protocol and any file system it knows: each row is a member without its last
byte, and that byte is the line separator. The last byte of a member is the top byte
of its content's length, zero below 16 MB; a longer record gets an empty member behind.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.common import payloads, written
from footfall.session import shared_dir

CAPTURED = "2024-01-01T00:00:00Z"
ROWS_PER_FILE = 5_000
ROWS_PER_BATCH = 1_000
FED = 1 << 16  # bytes unpacked at a time
READ_AHEAD = 1 << 22
_URN = "urn:page:"
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)
_ENTRY = "url_key string, page_id long, record_type string, payload_digest string, file string, offset long, length long"


def member(content: bytes) -> bytes:
    """A record as gzip; its last byte is zero."""
    packed = gzip.compress(content, 6, mtime=0)
    return packed if packed[-1] == 0 else packed + _EMPTY_MEMBER


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str) -> str:
    """Without characters that a header line or a URI can't hold."""
    return re.sub(r"[\x00-\x20\x7f<>\"{}|\\^`]", lambda c: "".join(f"%{b:02X}" for b in c[0].encode()), url)


def _urn(page_id: int | None) -> str:
    return f"<{_URN}{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str, payload: bytes, payload_digest: str, refers_to: int | None, date: str = CAPTURED) -> bytes:
    """A response record, or with ``refers_to`` a revisit of that page's response: its
    HTTP header alone, which still names the payload's length."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if refers_to is None else "revisit"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{payload_digest}",
    ]
    if refers_to is None:
        block += payload
        lines.append("Content-Type: application/http; msgtype=response")
    else:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_urn(refers_to)}", "Content-Type: application/http; msgtype=response",
        ]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(": ") for line in head.decode().split("\r\n")[1:])
    return {name.lower(): value for name, _, value in pairs}


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix(f"<{_URN}").removesuffix(">")
    return int(number) if number else None


def parsed(content: bytes) -> dict:
    """What a record says: page_id, url, record_type, refers_to, payload_bytes (of the full
    payload), payload_digest, and the payload itself (None for a revisit). A damaged
    record raises ValueError."""
    head, found, rest = content.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    if not found or not head.startswith(b"WARC/1.") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    out = {
        "page_id": _page(fields["warc-record-id"]), "url": fields["warc-target-uri"], "record_type": fields["warc-type"],
        "refers_to": _page(fields.get("warc-refers-to")), "payload_bytes": int(_fields(http)["content-length"]),
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"), "payload": payload,
    }
    if out["record_type"] == "revisit":
        return out | {"payload": None}
    if len(payload) != out["payload_bytes"] or digest(payload) != out["payload_digest"]:
        raise ValueError("a payload that doesn't match its digest")
    return out


def url_key(url: str) -> str:
    """Host labels reversed, then port, path and query: pages of a site sort together.
    It holds no white space."""
    host, slash, path = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", _uri(url).partition("#")[0]).partition("/")
    name, _, port = host.rpartition("@")[2].lower().partition(":")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")" + slash + path


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page, url, refers, payload in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "refers_to")), payloads(batch["html"])):
            out.append(member(record(page, url or "", payload, digest(payload), refers))[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])


def write_archives(pages: DataFrame, least_bytes: int = 0, rows_per_file: int = ROWS_PER_FILE) -> str:
    """Write a record for every row of ``pages`` (page_id, url, html); the folder's path.

    Of pages with equal payloads of at least ``least_bytes`` bytes, that with the
    smallest page_id is the response and the others revisit it. Null html is an empty
    payload, a null url an empty one. Rows that share the smallest page_id are all
    responses; rows without an id revisit a page that has one and else are responses.
    """
    path = shared_dir(pages.sparkSession, "warc")
    chosen = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    keyed = chosen.withColumn("payload_sha1", F.sha1(payload := F.coalesce("html", F.lit("")).cast("binary"))).withColumn("n", F.octet_length(payload))
    marked = written(keyed.select("page_id", "payload_sha1", "n"), "digests").where(F.col("n") >= least_bytes)
    first = marked.groupBy("payload_sha1", "n").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1")
    # an id alone doesn't tell a revisit: a page may come again with another payload
    revisits = (
        marked.join(first, ["payload_sha1", "n"]).where("refers_to is not null and not page_id <=> refers_to")
        .select(F.col("page_id").alias("page"), F.col("payload_sha1").alias("sha1"), "refers_to").distinct()
    )
    same = keyed.page_id.eqNullSafe(revisits.page) & (keyed.payload_sha1 == revisits.sha1)
    rows = keyed.join(revisits, same, "left").select("page_id", "url", "html", "refers_to").mapInArrow(_members, "member binary")
    write_members(rows, path, maxRecordsPerFile=rows_per_file)
    return path


def write_members(rows: DataFrame, path: str, **options: int) -> None:
    """Write a column ``member`` of members without their last byte, in the order of each
    partition, to files of its own."""
    text = rows.select(F.col("member").cast("string").alias("value"))
    text.write.mode("overwrite").options(lineSep="\0", **options).text(path)


def _spans(source: bytes | BinaryIO) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each record of an archive, read as a stream: no more
    than a record is held."""
    opened, at = io.BytesIO(source) if isinstance(source, bytes) else source, 0
    held = opened.read(FED)
    while held:
        start, content = at, b""
        while not content and held:  # an empty member is read with the record that follows
            stream, parts = zlib.decompressobj(wbits=31), []
            while not stream.eof:
                if not held:
                    raise ValueError("an archive that ends within a record")
                parts.append(stream.decompress(held))
                at += len(held) - len(stream.unused_data)
                held = stream.unused_data or opened.read(FED)
            content = b"".join(parts)
        if content:
            yield start, at - start, content


def _open(file: str):
    """A file that ranges can be read from, in any store that Arrow knows."""
    import pyarrow.fs

    uri = "file://" + file.removeprefix("file:") if re.match(r"file:/(?!/)", file) else file
    if "://" not in uri:
        return pyarrow.fs.LocalFileSystem().open_input_file(uri)
    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def each_member(spark: SparkSession, path: str, row: Callable[[str, int, int, bytes], tuple], fields: Sequence[pa.Field], schema: str) -> DataFrame:
    """``row`` (of file, offset, length, content) of all members in a folder. Files are
    listed by Spark and read as streams, so their size bounds no task's memory."""

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], names=[f.name for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                out = []
                with _open(file) as opened:
                    for offset, length, content in _spans(pa.BufferedInputStream(opened, READ_AHEAD)):
                        out.append(row(file, offset, length, content))
                        if len(out) == ROWS_PER_BATCH:
                            yield table(out)
                            out = []
                yield table(out)

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, schema)


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all records in a folder of archives, to build an index from:
    url_key, page_id, record_type, payload_digest, file, offset, length."""

    def entry(file: str, offset: int, length: int, content: bytes) -> tuple:
        r = parsed(content)
        return url_key(r["url"]), r["page_id"], r["record_type"], r["payload_digest"], file, offset, length

    fields = [
        pa.field("url_key", pa.string()), pa.field("page_id", pa.int64()), pa.field("record_type", pa.string()),
        pa.field("payload_digest", pa.string()), pa.field("file", pa.string()), pa.field("offset", pa.int64()), pa.field("length", pa.int64()),
    ]
    return each_member(spark, path, entry, fields, _ENTRY)


def by_file(ranges: DataFrame) -> DataFrame:
    """Rows with file and offset as they lie in the files, each file in one task. The number
    of tasks is given: the rows are far smaller than what they stand for, so by their size
    many files' ranges would be put together in one."""
    tasks = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(tasks, "file").sortWithinPartitions("file", "offset")


def read_records(entries: DataFrame) -> DataFrame:
    """The records at (file, offset, length): page_id, url, record_type, refers_to,
    payload_bytes, payload_digest, html (null for a revisit). Only these ranges are
    read, in the order they lie in a file."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "html"]
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, opened = None, None
        for batch in batches:
            out = []
            for file, offset, length in zip(*(batch[c].to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    if opened:
                        opened.close()
                    name, opened = file, _open(file)
                opened.seek(offset)
                r = parsed(gzip.decompress(opened.read(length)))
                html = None if r["payload"] is None else r["payload"].decode()
                out.append((r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], html))
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        if opened:
            opened.close()

    ranges = by_file(entries.select("file", "offset", "length"))
    return ranges.mapInArrow(
        run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, html string"
    )
