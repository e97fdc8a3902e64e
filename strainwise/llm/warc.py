"""WARC archives: a writer of one gzip member per record, and a splittable reader."""

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_limits, only, records, scratch_folder, stored

MAGIC = b"\x1f\x8b\x08"
AHEAD = 1 << 20  # bytes of one read request
CHUNK = 1 << 20
DATE = "2024-01-01T00:00:00Z"
MANIFEST = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("n_records", pa.int64())])
RECORD = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
                    ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()),
                    ("payload", pa.binary()), ("archive", pa.string()), ("offset", pa.int64())])


def _open(uri: str):
    """File system and path of a URI; a bare path is a mounted folder."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _header(value) -> str:
    return str(value or "").replace("\r", "%0D").replace("\n", "%0A")


def member(record_id: str, kind: str, uri: str | None, digest: str, refers_to: str | None, payload: bytes) -> bytes:
    """One WARC record as a gzip member. A revisit keeps the HTTP header and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}",
             f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_header(uri)}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{refers_to}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _write_task(folder: str, archive_bytes: int):
    """Append records to archives named after the task attempt; the manifest lists only finished ones."""

    def run(batches):
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        task, out, size, count, part = TaskContext.get(), None, 0, 0, 0

        def name():
            return f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{part:04d}.warc.gz"

        def close():
            out.close()
            return records([(f"{folder}/{name()}", size, count)], MANIFEST)

        for batch in batches:
            for id_, uri, html, digest, kind, refers in zip(*[c.to_pylist() for c in batch.columns]):
                data = member(id_, kind, uri, digest, refers, html or b"")
                if out is None:
                    out, size, count = fs.open_output_stream(f"{base}/{name()}", compression=None), 0, 0
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    yield close()
                    out, part = None, part + 1
        if out is not None:
            yield close()

    return run


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write ``record_id, uri, payload, digest, kind, refers_to`` rows; returns the stored manifest.

    Files of failed or repeated task attempts have other names and are not in the manifest.
    """
    rows = pages.select("record_id", "uri", "payload", "digest", "kind", "refers_to")
    return stored(rows.mapInArrow(_write_task(folder, archive_bytes), "path string, bytes long, n_records long"))


class _Source:
    """Reads ahead in a file opened for random access, so that members in a row share requests."""

    def __init__(self, handle, size):
        self.handle, self.size = handle, size
        self.start, self.held = 0, b""

    def at(self, offset: int, length: int) -> bytes:
        length = min(length, max(0, self.size - offset))
        if not self.start <= offset <= offset + length <= self.start + len(self.held):
            ahead = min(max(length, AHEAD), max(0, self.size - offset))
            self.start, self.held = offset, self.handle.read_at(ahead, offset)
        return self.held[offset - self.start:offset - self.start + length]


def _decode(source: _Source, offset: int):
    """The member at ``offset``: (raw record, end offset), or None if it is no whole gzip member."""
    unpacker, parts, place = zlib.decompressobj(31), [], offset
    try:
        while not unpacker.eof:
            data = source.at(place, 64 << 10)
            if not data:
                return None
            parts.append(unpacker.decompress(data))
            place += len(data)
            if parts and not b"".join(parts[:2])[:5] == b"WARC/"[:len(b"".join(parts[:2])[:5])]:
                return None  # the first bytes already show that this is no record
    except zlib.error:
        return None
    return b"".join(parts), place - len(unpacker.unused_data)


def parse(raw: bytes):
    """Named header fields and block of a record, or None if the header does not decode."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if "warc-type" not in fields or not fields.get("content-length", "").isdigit():
        return None
    length = int(fields["content-length"])
    return (fields, rest[:length]) if len(rest) >= length else None


def _first_member(source: _Source, start: int, stop: int):
    """Offset of the first valid record that starts in [start, stop), by its gzip magic."""
    place = start
    while place < stop:
        data = source.at(place, min(CHUNK, stop - place) + len(MAGIC) - 1)
        at = data.find(MAGIC)
        while at >= 0 and place + at < stop:
            got = _decode(source, place + at)
            if got and parse(got[0]):
                return place + at
            at = data.find(MAGIC, at + 1)
        place += CHUNK
    return None


def read_range(source: _Source, start: int, stop: int):
    """(offset, fields, block) of all records that start in [start, stop).

    Only the first one is searched for; the others follow each other without gaps. Where
    that chain breaks (damage), the search goes on behind the break.
    """
    offset = _first_member(source, start, stop)
    while offset is not None and offset < stop:
        got = _decode(source, offset)
        found = got and parse(got[0])
        if found:
            yield offset, *found
            offset = got[1]
        else:
            offset = _first_member(source, offset + 1, stop)


def _read_task(batches):
    for batch in batches:
        for path, size, start, stop in zip(*[c.to_pylist() for c in batch.columns]):
            fs, base = _open(path)
            rows, held = [], 0
            with fs.open_input_file(base) as handle:
                for offset, fields, block in read_range(_Source(handle, size), start, stop):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n")
                                   if x.lower().startswith(b"content-length:")), len(payload))
                    rows.append((fields.get("warc-record-id", "").strip("<>"), fields["warc-type"],
                                 fields.get("warc-target-uri"), fields.get("warc-payload-digest", "").removeprefix("sha1:"),
                                 fields.get("warc-refers-to", "").strip("<>") or None, length,
                                 None if fields["warc-type"] == "revisit" else payload, path, offset))
                    held += len(payload)
                    if held >= 4 << 20:
                        yield records(rows, RECORD)
                        rows, held = [], 0
            yield records(rows, RECORD)


def read_archives(manifest: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """All records of the archives in ``manifest`` (path, bytes), one task input per byte range."""
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes)))
    ranges = manifest.select("path", "bytes", start.alias("start"))
    ranges = ranges.withColumn("stop", F.least(F.col("start") + split_bytes, F.col("bytes")))
    # a range is a few numbers: deal them out one by one
    n = max(1, ranges.count())
    dealt = ranges.repartitionByRange(min(n, 100_000), "path", "start")
    return dealt.mapInArrow(_read_task, (
        "record_id string, record_type string, target_uri string, payload_digest string, refers_to string,"
        "payload_bytes long, payload binary, archive string, offset long"))


def _digest(batches):
    for batch in batches:
        payloads = batch.column(2)
        sums = [base64.b32encode(hashlib.sha1(payloads[i].as_py() or b"").digest()).decode()
                for i in range(batch.num_rows)]
        yield pa.record_batch([*batch.columns, pa.array(sums, pa.string())], names=[*batch.schema.names, "digest"])


def deduplicated_records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html",
                         min_bytes: int = 0) -> DataFrame:
    """Rows for ``write_archives``: response or revisit, and what a revisit refers to.

    Of payloads with one SHA-1 and length of at least ``min_bytes``, that with the
    smallest id is the response; smaller payloads are all responses. Rows sharing the
    smallest id are all responses. Null ids come last and are written as ``null``.
    """
    rows = only(pages, id=id_col, uri=uri_col, payload=html_col).select(
        F.col("id").cast("long"), "uri", F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.mapInArrow(_digest, "id long, uri string, payload binary, digest string")
    rows = rows.withColumn("length", F.length("payload"))
    # small rows only: the payloads are not shuffled to find the first of each digest
    first = rows.where(F.col("length") >= min_bytes).groupBy(F.col("digest").alias("d"), F.col("length").alias("l")).agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("d", "l", "first")
    joined = rows.join(first, (F.col("digest") == F.col("d")) & (F.col("length") == F.col("l")), "left")
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    response = F.col("d").isNull() | F.col("id").eqNullSafe(F.col("first"))
    return joined.select(urn(F.col("id")).alias("record_id"), "uri", "payload", "digest",
                         F.when(response, "response").otherwise("revisit").alias("kind"),
                         F.when(~response, urn(F.col("first"))).alias("refers_to"))


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None, split_bytes: int = 8 << 20,
               archive_bytes: int = 64 << 20, min_bytes: int = 0, **columns) -> DataFrame:
    """Write ``pages`` to WARC archives below the shared folder and read all records back.

    An empty table gives no archives and an empty result; other columns are ignored.
    """
    arrow_limits(spark)
    folder = folder or f"{scratch_folder(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(deduplicated_records(pages, min_bytes=min_bytes, **columns), folder, archive_bytes)
    return read_archives(manifest, split_bytes)
