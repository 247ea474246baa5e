"""WARC files: a writer, and a splittable reader over byte ranges.

``write_warc`` writes one gzip member per record, one file a task (a new one beyond ``max_bytes``).  Rows with equal payloads of at least
``least_bytes`` become one response and revisits that refer to it.

``read_warc`` cuts files into byte ranges.  A task looks for the gzip magic in its range, decodes what follows a match, and takes the match for a record only if it inflates to WARC headers of any length, and then to the
whole block they announce with the member's checksum right; any other match is data that looks like a magic and the search goes on behind it.  A record belongs
to the range in which it starts, so a task may read on behind its range, and every record is read once whatever the split size.
Beside one record and a read buffer a task holds nothing.

Limit: where a range starts inside a record that carries, uncompressed, another whole gzipped WARC record, that inner record is taken for
one of the file.  Writers that compress never produce that.

Defined cases: null html is an empty payload; a null url leaves out the target; control characters and spaces in a url are percent-encoded; a null page_id is
written as no id and read as null; rows that repeat the smallest page_id of equal payloads are all responses; empty tables give no
files and no rows; very long payloads are read whole.  Only page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplyscope.llm.common import fresh_dir, map_arrow, materialize
from supplyscope.llm.files import open_fs, replaced_file

MAGIC = b"\x1f\x8b\x08"
READ = 1 << 20
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs, as in RFC 4122
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}:{digest}')}>"


def _headers(pairs: list[tuple[str, str | None]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in pairs if v is not None).encode()


def _plain_uri(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """The bytes of one record: a response with its payload, or a revisit with the HTTP headers alone."""
    http = b"HTTP/1.1 200 OK\r\n" + _headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + b"\r\n"
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = b"WARC/1.1\r\n" + _headers([
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date),
        ("WARC-Target-URI", _plain_uri(url)), ("X-Page-Id", None if page_id is None else str(page_id)),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", record_id(refers_to, digest) if revisit else None), ("X-Refers-To-Page", str(refers_to) if revisit else None),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))])
    return head + b"\r\n" + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_warc(pages: DataFrame, uri: str | None = None, least_bytes: int = 100, date: str = "1970-01-01T00:00:00Z",
               max_bytes: int = 1 << 30, level: int = 6) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files below ``uri``; returns (path, n_records, n_bytes), one row a file."""
    spark: SparkSession = pages.sparkSession
    uri = uri or fresh_dir(spark, "warc")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
                        F.sha2(payload, 256).alias("digest"))
    narrow = materialize(rows.select("page_id", "digest", F.octet_length("payload").alias("n")).where(F.col("n") >= least_bytes)
                         .select("page_id", F.unhex("digest").alias("key")), "digests")
    first = narrow.groupBy("key").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = (narrow.join(first, "key").where(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull())
             .select(F.col("page_id").alias("again_id"), F.lower(F.hex("key")).alias("again_digest"), "refers_to").distinct())
    full = rows.join(again, rows["page_id"].eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, roll, batch, at = TaskContext.get().partitionId(), 0, None, 0
        batches = (b for b in batches if b.num_rows)
        batch = next(batches, None)
        while batch is not None:
            name = f"{uri}/part-{part:06d}-{roll:04d}.warc.gz"
            n = size = 0
            with replaced_file(name) as out:
                while batch is not None and size < max_bytes:
                    page_id, url, data, digest, refers_to = (batch.column(i)[at].as_py() for i in range(5))
                    member = _member(warc_record(page_id, url, data, digest, refers_to, date), level)
                    out.write(member)
                    n, size, at = n + 1, size + len(member), at + 1
                    if at == batch.num_rows:
                        batch, at = next(batches, None), 0
            roll += 1
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "n_records", "n_bytes"])

    return materialize(full.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-files")


class _Window:
    """A moving view of a file: the bytes from any position on, read ahead in blocks."""

    def __init__(self, handle, size: int):
        self.handle, self.size, self.at, self.data = handle, size, 0, b""

    def get(self, pos: int, n: int) -> bytes:
        if pos < self.at or pos + n > self.at + len(self.data):
            self.data, self.at = self.handle.read_at(min(max(n, READ), self.size - pos), pos) if pos < self.size else b"", pos
        return self.data[pos - self.at:pos - self.at + n]

    def find(self, what: bytes, pos: int, end: int) -> int:
        """The first position from ``pos`` on and before ``end`` where ``what`` starts, or -1."""
        while pos < end:
            part = self.get(pos, min(READ, end - pos + len(what) - 1))
            hit = part.find(what)
            if hit >= 0:
                return pos + hit
            pos += max(1, len(part) - len(what) + 1)
        return -1


#: The start of a header line: a name and a colon, or white space that continues the line before.
_HEADER = re.compile(rb"[!#-'*+.0-9A-Z^-z|~-]+[ \t]*:|[ \t]")


def _inflate(window: _Window, pos: int) -> tuple[bytes, int] | None:
    """The content and the end of the gzip member at ``pos`` if it is a WARC record; None if it isn't."""
    d, parts, at = zlib.decompressobj(31), [], pos
    head: bytearray | None = bytearray()  # what is inflated up to the blank line; None behind it
    checked = 0  # the start of the first header line that is not checked yet
    while not d.eof:
        piece = window.get(at, min(1 << 16, window.size - at))
        if not piece:
            return None
        try:
            parts.append(d.decompress(piece))
        except zlib.error:
            return None
        at += len(piece)
        if head is not None:
            head += parts[-1]
            if not head.startswith(b"WARC/1."[:len(head)]):
                return None
            while (end := head.find(b"\r\n", max(checked, len(head) - len(parts[-1]) - 1))) > checked:
                if checked and not _HEADER.match(head, checked, end):
                    return None
                checked = end + 2
            if end >= 0:  # an empty line
                head = None
            elif d.eof:
                return None
    return b"".join(parts), at - len(d.unused_data)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers (names in lower case) and block of a record; None unless the block has the announced length."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/1."):
        return None
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not length.isdigit() or len(rest) < int(length) or rest[int(length):] != b"\r\n\r\n":
        return None
    return headers, rest[:int(length)]


def records_in(window: _Window, start: int, end: int) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(start, end, headers, block) of the records that start in [start, end)."""
    pos = start
    while (pos := window.find(MAGIC, pos, end)) >= 0:
        member = _inflate(window, pos)
        record = parse_record(member[0]) if member else None
        if record is None:
            pos += 1
            continue
        yield pos, member[1], *record
        pos = member[1]


MOST_TASKS = 20_000  # beyond so many ranges a task reads several
SCHEMA = ("path string, start long, end long, record_type string, record_id string, target_uri string, page_id long, refers_to long, "
          "payload_bytes long, payload_digest string")


def read_warc(files: DataFrame, split_bytes: int = 8 << 20, with_payload: bool = False) -> DataFrame:
    """One row for each record of ``files`` (path, n_bytes), read by ranges of ``split_bytes``.

    payload_bytes and payload_digest (SHA-256, hex) are of the full payload: taken from the payload itself for a response, whose
    digest header must agree, and from the headers for a revisit.  With ``with_payload`` the payload comes too, null for a revisit.
    """
    ranges = files.where("n_bytes > 0").select("path", "n_bytes", F.explode(F.sequence(F.lit(0), F.col("n_bytes") - 1, F.lit(split_bytes))).alias("start"))
    # rows of a range are tiny: without a number adaptive execution would put all ranges into one task
    n_ranges = files.where("n_bytes > 0").agg(F.sum(F.ceil(F.col("n_bytes") / split_bytes))).first()[0] or 1
    spread = ranges.repartition(min(int(n_ranges), MOST_TASKS))
    names = [c.split()[0] for c in SCHEMA.split(", ")] + ["payload"] * with_payload

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for path, size, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
            rows = []
            fs, name = open_fs(path)
            with fs.open_input_file(name) as handle:
                for at, end, h, block in records_in(_Window(handle, size), start, min(size, start + split_bytes)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = h.get("warc-payload-digest", "").removeprefix("sha256:")
                    kind = h.get("warc-type", "")
                    if kind == "revisit":
                        length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                        n, payload = int(length[1]) if length else None, None
                    else:
                        n, own = len(payload), hashlib.sha256(payload).hexdigest()
                        if digest and digest != own:
                            raise ValueError(f"{path}:{at}: the payload does not have the digest {digest}")
                        digest = own
                    page, to = h.get("x-page-id"), h.get("x-refers-to-page")
                    rows.append((path, at, end, kind, h.get("warc-record-id"), h.get("warc-target-uri"), None if page is None else int(page),
                                 None if to is None else int(to), n, digest) + (payload,) * with_payload)
                    if len(rows) >= 256:
                        yield _batch(rows, names)
                        rows = []
            if rows:
                yield _batch(rows, names)

    return map_arrow(spread, SCHEMA + ", payload binary" * with_payload, run)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"start": pa.int64(), "end": pa.int64(), "page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows))], names=names)
