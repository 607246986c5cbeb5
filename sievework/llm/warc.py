"""WARC archives: writing with revisits and segments, reading with segment reassembly.

Writing: each page is a response record, or a revisit of the page with the
least page_id among those of equal payload. Payloads are framed as chunked HTTP
messages; a message of more than ``SEGMENT_BYTES`` is cut into a first record
and continuation records. Records go out through Spark's text writer, whose
line separator is the record separator of WARC, so commits, retries and any
file system work as for every Spark table; files are gzip-compressed as a whole.

Reading: Spark's text reader streams each file in pieces between record
separators, and a parser joins them to records, so memory is bounded by one
record, not by a file. Compressed files are read in order by one task each;
uncompressed ones, which Spark reads in splits, are put in order by file first.
Parsed records are stored once. Those of one message are grouped by their origin
identifier and ordered by segment number; the parts must be numbered from 1
without a gap and their bytes sum to the stated total length. Then the chunked
framing is decoded. A message never leaves its own group, so memory is bounded
by one message.

Defined results: a null payload is empty; a null url is left out and read back
as null; rows with equal page_id and payload are all responses; a null page_id
is never a page that others refer to; a message with a missing segment or wrong
length is returned with ``complete`` false and what payload there is; of
repeated segments one counts; a number in a header that is none is read as null,
as is one of more than 18 digits; a record without a valid Content-Length
reaches to the next record's first line, and is not whole; a block that ends
before its stated length is not whole, and what is between records is skipped; a
corrupt gzip stream raises, or with ``skip_corrupt`` ends its file; empty tables
give empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import few_files, pick, stored

SEPARATOR = "\r\n\r\n"
_SEPARATOR = SEPARATOR.encode()
SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
#: Payloads of fewer bytes never become revisits.
LEAST_REVISIT = 100
RECORDS_PER_FILE = 5000
_DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

RECORD = (
    "record_id string, type string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string, "
    "segment int, origin string, total long, whole boolean, block binary"
)
_RECORD_ARROW = pa.schema(
    [
        ("record_id", pa.string()),
        ("type", pa.string()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("segment", pa.int32()),
        ("origin", pa.string()),
        ("total", pa.int64()),
        ("whole", pa.bool_()),
        ("block", pa.binary()),
    ]
)


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """``payload`` in chunked transfer framing."""
    out = []
    for k in range(0, len(payload), size):
        piece = payload[k : k + size]
        out += [f"{len(piece):x}\r\n".encode(), piece, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> tuple[bytes, bool]:
    """The payload of a chunked body (extensions and trailers are skipped), and whether the framing was whole."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            return b"".join(out), False
        try:
            n = int(framed[at:end].split(b";")[0].strip() or b"x", 16)
        except ValueError:
            return b"".join(out), False
        if n == 0:
            return b"".join(out), True
        piece = framed[end + 2 : end + 2 + n]
        out.append(piece)
        at = end + 2 + n
        if len(piece) < n or framed[at : at + 2] != b"\r\n":
            return b"".join(out), False
        at += 2


def _urn(*parts: object) -> str:
    h = hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{name}: {value}" for name, value in headers if value is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block


def _uri(url: str | None) -> str | None:
    return None if url is None else quote(url, safe="/:?#[]@!$&'()*+,;=-._~%")


def page_records(
    key: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_to_url: str | None, segment_bytes: int
) -> list[bytes]:
    """The WARC records of one page, without separators."""
    own = _urn(key)
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", own),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", _uri(url)),
        ("WARC-Target-Quoted", None if url is None else quote(url, safe="")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Page-ID", page_id),
        ("WARC-Payload-Length", len(payload)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        where = [("WARC-Refers-To-Target-URI", _uri(refers_to_url)), ("WARC-Refers-To-Date", _DATE), ("WARC-Refers-To-Page-ID", refers_to)]
        return [_record([*head, profile, *where], _HTTP + b"\r\n")]
    message = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    pieces = [message[k : k + segment_bytes] for k in range(0, len(message), segment_bytes)]
    if len(pieces) == 1:
        return [_record(head, message)]
    out = [_record([*head, ("WARC-Segment-Number", 1)], pieces[0])]
    for number, piece in enumerate(pieces[1:], 2):
        last = len(message) if number == len(pieces) else None
        out.append(
            _record(
                [
                    ("WARC-Type", "continuation"),
                    ("WARC-Record-ID", _urn(key, number)),
                    ("WARC-Date", _DATE),
                    ("WARC-Segment-Origin-ID", own),
                    ("WARC-Segment-Number", number),
                    ("WARC-Segment-Total-Length", last),
                ],
                piece,
            )
        )
    return out


def _with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, and refers_to (null: a response) and refers_to_url of each page.

    Only (digest, page_id) rows are grouped; a payload that a third of all pages
    share is pre-aggregated to one row per task.
    """
    rows = pick(pages, page_id="page_id", url="url", html="html").select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    keys = rows.filter(F.octet_length("payload") >= LEAST_REVISIT).select("page_id", "digest", "url")
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    first = keys.groupBy("digest").agg(least.alias("least"), F.count("*").alias("n")).filter("n > 1 AND least IS NOT NULL")
    first = first.select("digest", F.col("least.page_id").alias("first"), F.col("least.url").alias("first_url"))
    revisits = (
        keys.join(first, "digest")
        .filter(~F.col("page_id").eqNullSafe(F.col("first")))
        .groupBy(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"))
        .agg(F.min("first").alias("refers_to"), F.min("first_url").alias("refers_to_url"))
    )
    same = F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("digest") == F.col("__digest"))
    return rows.join(revisits, same, "left").drop("__page", "__digest")


def write_archive(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """``pages`` (page_id, url, html) as gzip-compressed WARC files in the folder ``path``."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        number = 0
        for batch in batches:
            out = []
            for page_id, url, payload, digest, *refers_to in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                key = f"{task.partitionId() if task else 0}-{number}-{page_id}-{digest}"
                number += 1
                out += page_records(key, page_id, url, payload, digest, *refers_to, segment_bytes)
            yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])

    rows = _with_revisits(pages).select("page_id", "url", "payload", "digest", "refers_to", "refers_to_url")
    text = rows.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
    few_files(text).write.option("lineSep", SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


class Parser:
    """Records from the pieces of a WARC stream between record separators, in order."""

    def __init__(self) -> None:
        self.buffer = bytearray()
        self.started = False
        self.fields: dict | None = None  # of the record whose block is awaited
        self.length: int | None = None
        self.searched = 0

    def feed(self, piece: bytes) -> Iterator[dict]:
        """The records that end with ``piece``: header fields, ``block`` and ``whole``."""
        if self.started:
            self.buffer += _SEPARATOR
        self.started = True
        self.buffer += piece
        yield from self._records(False)

    def close(self) -> Iterator[dict]:
        """The records that end with the stream."""
        yield from self._records(True)

    def _records(self, end: bool) -> Iterator[dict]:
        while True:
            if self.fields is None:
                if not self._header(end):
                    return
            if self.length is None:  # up to the next first line
                at = self.buffer.find(_SEPARATOR + b"WARC/", self.searched)
                if at < 0 and not end:
                    self.searched = max(0, len(self.buffer) - 16)
                    return
                yield self._record(len(self.buffer) if at < 0 else at, False)
            elif len(self.buffer) >= self.length:
                yield self._record(self.length, True)
            elif end:
                yield self._record(len(self.buffer), False)
            else:
                return

    def _header(self, end: bool) -> bool:
        """Whether a header is in the buffer; it is taken out."""
        start = 0 if self.buffer.startswith(b"WARC/") else self.buffer.find(b"\nWARC/") + 1
        if not start and not self.buffer.startswith(b"WARC/"):
            del self.buffer[: max(0, len(self.buffer) - 8)]  # what is between records
            return False
        stop = self.buffer.find(_SEPARATOR, start)
        if stop < 0 and not end:
            return False
        lines = bytes(self.buffer[start : stop if stop >= 0 else len(self.buffer)]).decode("utf-8", "replace").splitlines()
        self.fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
        self.length = number(self.fields.get("content-length"))
        self.searched = 0
        del self.buffer[: stop + len(_SEPARATOR) if stop >= 0 else len(self.buffer)]
        return True

    def _record(self, length: int, whole: bool) -> dict:
        out = {**self.fields, "block": bytes(self.buffer[:length]), "whole": whole}
        del self.buffer[:length]
        self.fields = None
        return out


def number(value: str | None) -> int | None:
    """A whole number of at most 18 digits; else None."""
    return int(value) if value and value.isascii() and value.isdigit() and len(value) <= 18 else None


def _signed(value: str | None) -> int | None:
    if value and value.startswith("-"):
        positive = number(value[1:])
        return None if positive is None else -positive
    return number(value)


def _row(f: dict) -> tuple:
    quoted = f.get("warc-target-quoted")
    segment = number(f.get("warc-segment-number"))
    return (
        f.get("warc-record-id"),
        f.get("warc-type"),
        _signed(f.get("warc-page-id")),
        f.get("warc-target-uri") if quoted is None else unquote(quoted),
        _signed(f.get("warc-refers-to-page-id")),
        number(f.get("warc-payload-length")),
        (f.get("warc-payload-digest") or "").removeprefix("sha256:") or None,
        segment if segment is None or segment < 1 << 31 else None,
        f.get("warc-segment-origin-id"),
        number(f.get("warc-segment-total-length")),
        f["whole"],
        f["block"],
    )


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of pieces (file, value), file by file."""
    now, parser = None, Parser()
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for file, value in zip(batch.column("file").to_pylist(), batch.column("value"), strict=True):
            found = []
            if file != now:
                found += parser.close()
                now, parser = file, Parser()
            found += parser.feed(value.as_py() or b"")
            rows += map(_row, found)
            held += sum(len(f["block"]) for f in found)
            if held > 4 << 20:
                yield _batch(rows, _RECORD_ARROW)
                rows, held = [], 0
    rows += map(_row, parser.close())
    yield _batch(rows, _RECORD_ARROW)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def read_records(spark: SparkSession, path: str, skip_corrupt: bool = False) -> DataFrame:
    """All records of the WARC files in ``path``, one row each; ``whole``: the block is as long as stated."""
    read = spark.read.option("lineSep", SEPARATOR).option("ignoreCorruptFiles", str(skip_corrupt).lower())
    pieces = read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("value")
    )
    packed = F.lower("file").endswith(".gz")
    plain = pieces.filter(~packed).withColumn("n", F.monotonically_increasing_id())
    ordered = plain.repartition("file").sortWithinPartitions("file", "at", "n")
    return pieces.filter(packed).select("file", "value").mapInArrow(_parse, RECORD).unionByName(ordered.select("file", "value").mapInArrow(_parse, RECORD))


def reassemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit: its segments joined in order, the payload decoded from its framing.

    Returns record_id, type, page_id, url, refers_to, payload_bytes and
    payload_digest (as the record states them), payload (null for a revisit)
    and ``complete``: no segment missing or cut off, total length right, framing
    whole, and the payload as long as stated. Records are stored, so that archives are parsed once.
    """
    records = stored(records, "records")
    whole = records.filter("segment IS NULL").select(
        "record_id", "type", "page_id", "url", "refers_to", "payload_bytes", "payload_digest", F.array("block").alias("blocks"), F.col("whole").alias("joined")
    )
    parts = records.filter("segment IS NOT NULL").withColumn("origin", F.coalesce("origin", "record_id"))
    first = lambda name: F.max(F.when(F.col("segment") == 1, F.col(name))).alias(name)
    grouped = (
        parts.dropDuplicates(["origin", "segment"])
        .groupBy("origin")
        .agg(
            *[first(n) for n in ("type", "page_id", "url", "refers_to", "payload_bytes", "payload_digest")],
            F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("pieces"),
            F.max("total").alias("total"),
            F.max("segment").alias("last"),
            F.bool_and("whole").alias("whole"),
        )
    )
    length = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p["block"]))
    blocks = F.transform("pieces", lambda p: p["block"])
    joined = grouped.select(
        F.col("origin").alias("record_id"), "type", "page_id", "url", "refers_to", "payload_bytes", "payload_digest",
        blocks.alias("blocks"),
        F.coalesce((F.size("pieces") == F.col("last")) & (length == F.col("total")) & F.col("whole"), F.lit(False)).alias("joined"),
    )
    messages = whole.unionByName(joined).filter("type IS NULL OR type IN ('response', 'revisit')")
    return messages.mapInArrow(
        _decode,
        "record_id string, type string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string, "
        "payload binary, complete boolean",
    )


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads, complete = [], []
        for kind, stated, blocks, joined in zip(
            *[batch.column(n).to_pylist() for n in ("type", "payload_bytes", "blocks", "joined")], strict=True
        ):
            if kind == "revisit":
                payloads.append(None)
                complete.append(joined)
                continue
            head, _, body = b"".join(b or b"" for b in blocks).partition(b"\r\n\r\n")
            ok = True
            if b"transfer-encoding: chunked" in head.lower():
                body, ok = unchunked(body)
            payloads.append(body)
            complete.append(joined and ok and stated in (None, len(body)))
        kept = [batch.column(n) for n in ("record_id", "type", "page_id", "url", "refers_to", "payload_bytes", "payload_digest")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(payloads, pa.binary()), pa.array(complete, pa.bool_())],
            names=[
                "record_id", "type", "page_id", "url", "refers_to", "payload_bytes", "payload_digest", "payload", "complete",
            ],
        )
