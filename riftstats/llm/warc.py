"""WARC archives: writing pages, reading them back and reassembling segments.

A page becomes an HTTP response in chunked transfer framing. A block beyond
SEGMENT_BYTES is cut into a first record and `continuation` records that carry
the origin's id, their number and, on the last, the total length. Of pages with
equal payloads of at least MIN_BYTES the one with the smallest id is written as
`response`, the others as `revisit` without a payload.

Spark's text writer puts the archives in the shared folder (committed per task,
so a lost executor leaves nothing half written) and Spark's text reader cuts
them at the record marker. The marker never stands inside a block: a chunk ends
within any "WARC/1.1" of a payload and header values have it escaped; every
block is checked against its Content-Length. Single-segment records are decoded
where they are read; only the parts of segmented ones are shuffled, by origin.

A response's record id is made of its page's id and its digest, so that every
WARC-Refers-To of a revisit names a record of the archives; revisits and
continuations are numbered by task. The reader takes archives of text records,
as the writer makes them; whole files are compressed, not single records.

Cases: a null payload is empty; an empty or short payload is always a response;
repeated rows of the response's id are responses too (equal records with one id),
other repeats revisit it;
rows with a null id are never the response of others: they are responses if
alone with their payload or if all ids of the group are null, else revisits; a
very long payload is read in segments and only its own parts meet in a group;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, join_by_key, map_batches, shared_dir

SEGMENT_BYTES, CHUNK_BYTES, MIN_BYTES = 32 << 10, 8 << 10, 100
MARK = "WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of one archive file before compression: a record holds a segment at most.
FILE_BYTES = 512 << 20


def cut_points(data: bytes, step: int) -> Iterator[tuple[int, int]]:
    """Pieces of about `step` bytes that end between UTF-8 characters."""
    lo = 0
    while lo < len(data):
        hi = min(lo + step, len(data))
        while hi < len(data) and data[hi] & 0xC0 == 0x80:
            hi -= 1
        yield lo, hi
        lo = hi


def chunked(payload: bytes) -> bytes:
    """Chunked transfer framing; a chunk ends inside each WARC/1.1."""
    out = []
    parts = payload.split(b"WARC/1.1")
    pieces = [(b"/1.1" if i else b"") + p + (b"WARC" if i + 1 < len(parts) else b"") for i, p in enumerate(parts)]
    for piece in pieces:
        for lo, hi in cut_points(piece, CHUNK_BYTES):
            out += [b"%x\r\n" % (hi - lo), piece[lo:hi], b"\r\n"]
    out.append(b"0\r\n\r\n")
    return b"".join(out)


def unchunked(framed: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(framed[end + 2 : end + 2 + size])
        at = end + 2 + size
        if framed[at : at + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        at += 2


def safe(value: str) -> str:
    return quote(value, safe=":/?#[]@!$&'()*+,;=%~").replace("WARC/", "%57ARC/")


def header(pairs: list[tuple[str, str | int]]) -> str:
    return MARK + "".join(f"{k}: {v}\r\n" for k, v in pairs) + "\r\n"


def record_id(page_id: int | None, digest: str, own: str) -> str:
    """Id of a page's response; one without a page id goes by its number."""
    return f"<urn:page:{own if page_id is None else page_id}:{digest}>"


def records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, own: str, date: str) -> Iterator[str]:
    """The records of one page, each without the closing END. own: a number that
    no other page of the archives has; date: WARC-Date of all records."""
    kind = "revisit" if refers_to is not None else "response"
    origin = f"<urn:page:{own}>" if kind == "revisit" else record_id(page_id, digest, own)
    head = [("WARC-Record-ID", origin), ("WARC-Type", kind), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if page_id is not None:
        head.append(("X-Page-Id", page_id))
    if url:
        head.append(("WARC-Target-URI", safe(url)))
    if kind == "revisit":
        block = f"HTTP/1.1 200 OK\r\nContent-Length: {len(payload)}\r\n\r\n"
        yield header([*head, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest, own)), ("Content-Length", len(block))]) + block
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    cuts = list(cut_points(block, SEGMENT_BYTES))
    for n, (lo, hi) in enumerate(cuts, 1):
        part = head if n == 1 else [("WARC-Record-ID", f"<urn:page:{own}:{n}>"), ("WARC-Type", "continuation"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", origin)]
        if len(cuts) > 1:
            part = [*part, ("WARC-Segment-Number", n)]
        if n == len(cuts) > 1:
            part = [*part, ("WARC-Segment-Total-Length", len(block))]
        yield header([*part, ("Content-Length", hi - lo)]) + block[lo:hi].decode("utf-8")


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to of every page. Only digests that
    repeat are joined to the pages, and the most frequent of them are sent out:
    payloads are shuffled only where repeats are too many for that, and then no
    payload is common."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= MIN_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    return join_by_key(rows, cut(first), "digest", "n", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write(pages: DataFrame, path: str, date: datetime | None = None) -> None:
    """Writes the archives of all pages to the folder `path`."""
    when = (date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            lines, held = [], 0
            for page_id, url, payload, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n += 1
                for text in records(page_id, url, payload, digest, refers, f"{page_id}-{task}-{n}", when):
                    lines.append(text)
                    held += len(text)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
                        lines, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    map_batches(planned(pages), run, "value string").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_BYTES // SEGMENT_BYTES).mode("errorifexists").text(path)


class Broken(ValueError):
    """A record that doesn't hold what its headers say."""


def parse(text: str) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record as the reader cuts it."""
    head, _, rest = text.partition(END)
    fields = dict(line.split(": ", 1) for line in head.split("\r\n") if line)
    size = int(fields["Content-Length"])
    raw = rest.encode("utf-8")
    if len(raw) < size or raw[size:] not in (b"", END.encode()):
        raise Broken(f"block of {len(raw)} bytes, Content-Length {size}")
    return fields, raw[:size]


def decoded(fields: dict[str, str], block: bytes) -> tuple[int | None, str, int | None, int, str, bytes | None]:
    """(page_id, record_type, refers_to, payload_bytes, payload_digest, payload)
    of a whole record; the payload of a response is held against its digest."""
    number = lambda v: int(v.removeprefix("<urn:page:").split(":")[0])
    page_id = int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    head, _, body = block.partition(b"\r\n\r\n")
    if fields["WARC-Type"] == "revisit":
        size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        return page_id, "revisit", number(fields["WARC-Refers-To"]), size, digest, None
    payload = unchunked(body) if b"Transfer-Encoding: chunked" in head else body
    if hashlib.sha256(payload).hexdigest() != digest:
        raise Broken("payload differs from its digest")
    return page_id, "response", None, len(payload), digest, payload


OUT = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _rows(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest and the
    payload (null on revisits, or for all if not asked for)."""
    lines = spark.read.option("lineSep", MARK).text(path).where("value != ''")
    segmented = F.contains(F.substring_index("value", END, 1), F.lit("WARC-Segment-"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [decoded(*parse(t)) for t in b.column(0).to_pylist()]
            yield _rows([r if payloads else (*r[:5], None) for r in rows])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parse(t) for t in b.column(0).to_pylist()]
            origin = [f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"]) for f, _ in got]
            total = [int(f["WARC-Segment-Total-Length"]) if "WARC-Segment-Total-Length" in f else None for f, _ in got]
            yield pa.RecordBatch.from_arrays([pa.array(origin), pa.array([int(f["WARC-Segment-Number"]) for f, _ in got], pa.int32()), pa.array(total, pa.int64()), pa.array([list(f.items()) for f, _ in got], pa.map_(pa.string(), pa.string())), pa.array([x for _, x in got], pa.binary())], names=["origin", "number", "total", "fields", "block"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for segments, total in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                segments.sort(key=lambda s: s["number"])
                if [s["number"] for s in segments] != list(range(1, len(segments) + 1)):
                    raise Broken("a segment is missing")
                block = b"".join(s["block"] for s in segments)
                if len(block) != total:
                    raise Broken(f"segments of {len(block)} bytes, total length {total}")
                row = decoded(dict(segments[0]["fields"]), block)
                rows.append(row if payloads else (*row[:5], None))
            yield _rows(rows)

    single = map_batches(lines.where(~segmented), whole, OUT)
    split = map_batches(lines.where(segmented), parts, "origin string, number int, total long, fields map<string,string>, block binary")
    grouped = split.groupBy("origin").agg(F.collect_list(F.struct("number", "fields", "block")).alias("segments"), F.max("total").alias("total"))
    return single.unionByName(map_batches(grouped.select("segments", "total"), joined, OUT))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """The header fields of every record, as a map."""
    lines = spark.read.option("lineSep", MARK).text(path).where("value != ''")
    return lines.select(F.str_to_map(F.substring_index("value", END, 1), F.lit("\r\n"), F.lit(": ")).alias("fields"))


def round_trip(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back."""
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    return read(pages.sparkSession, path, payloads)
