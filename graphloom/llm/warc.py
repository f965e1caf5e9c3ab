"""Operator 6: WARC archives, with segmented records reassembled on reading.

Writing makes one record for each page: `response` with an HTTP message, or
`revisit` for a page whose payload of at least `min_bytes` another page with a
smaller id has too. Bodies beyond `chunk_at` bytes use chunked transfer framing,
and blocks beyond `segment` bytes are cut into a first record and `continuation`
records, as ISO 28500 has it. Records leave tasks as rows and Spark's text writer
puts them into gzip files, with the blank lines that end a record as its line
separator: so archives go to any file system that Spark can open, and a task that is
run again leaves its files once, by Spark's committer.

Which pages are revisits is found on ids and digests alone. Payloads are not
shuffled while the revisits are few enough to broadcast (they are counted first);
beyond, they are joined by page id and digest, which no repeated payload makes
uneven.

Reading parses archives in parallel and as streams, groups continuation records by
the id of their first record, orders them by segment number, verifies that none is
missing and that lengths add up to the stated total, and decodes the transfer
framing. Only segmented records are shuffled.

Defined results: null html is an empty payload; rows that repeat a page id and
payload are equally the smallest, so each is a response; a null page id sorts
last among equals and is kept; an empty table gives no record and no row; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fresh_path, if_small, settle

#: Bytes of records, before compression, that an archive holds on average at most.
ARCHIVE = 64 << 20
SEGMENT = 32 << 10
CHUNK_AT = 4 << 10
CHUNK = 2 << 10
#: Revisits up to which their table is broadcast; beyond, a shuffled join.
BROADCAST_ROWS = 200_000
_END = b"\r\n\r\n"


class WarcError(ValueError):
    """An archive that breaks the format."""


# -- framing ----------------------------------------------------------------


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """body in chunked transfer framing."""
    out = []
    for at in range(0, len(body), size):
        part = body[at : at + size]
        out += [f"{len(part):x}\r\n".encode(), part, b"\r\n"]
    return b"".join(out) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise WarcError("chunk size missing")
        size = int(data[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2
        out.append(data[at : at + size])
        if len(out[-1]) != size or data[at + size : at + size + 2] != b"\r\n":
            raise WarcError("chunk cut short")
        at += size + 2


def http_message(payload: bytes, chunk_at: int = CHUNK_AT) -> bytes:
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if len(payload) > chunk_at:
        return (head + "Transfer-Encoding: chunked\r\n\r\n").encode() + chunked(payload)
    return (head + f"Content-Length: {len(payload)}\r\n\r\n").encode() + payload


def http_payload(block: bytes) -> bytes:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise WarcError("HTTP header has no end")
    fields = [x.split(b":", 1) for x in head.split(b"\r\n")[1:]]
    named = {k.strip().lower(): v.strip() for k, v in fields}
    return dechunked(body) if named.get(b"transfer-encoding", b"").lower() == b"chunked" else body


def record(kind: str, record_id: str, block: bytes, more: dict[str, object]) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": "1970-01-01T00:00:00Z", **more, "Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_records(page_id: int | None, payload: bytes, refers_to: int | None, tag: str, segment: int = SEGMENT, chunk_at: int = CHUNK_AT) -> Iterator[bytes]:
    """The records of one page; tag makes the record ids of repeated page ids differ."""
    origin = f"urn:page:{'' if page_id is None else page_id}:{tag}"
    target = {"WARC-Target-URI": f"urn:page:{'' if page_id is None else page_id}"}
    digest = {"WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}"}
    if refers_to is not None:
        profile = {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Target-URI": f"urn:page:{refers_to}"}
        yield record("revisit", origin, b"", target | digest | profile)
        return
    block = http_message(payload, chunk_at)
    if len(block) <= segment:
        yield record("response", origin, block, target | digest)
        return
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    yield record("response", origin, parts[0], target | digest | {"WARC-Segment-Number": 1})
    for k, part in enumerate(parts[1:], 2):
        last = {"WARC-Segment-Total-Length": len(block)} if k == len(parts) else {}
        yield record("continuation", f"{origin}:{k}", part, target | {"WARC-Segment-Origin-ID": f"<{origin}>", "WARC-Segment-Number": k} | last)


def records_of(data: bytes, step: int = 64 << 10) -> Iterator[bytes]:
    """The records of a gzip file of one or more members; a few of them are in memory at a time."""
    held, view, at = bytearray(), memoryview(data), 0
    while at < len(view):
        inflate = zlib.decompressobj(wbits=31)
        while not inflate.eof:
            if at >= len(view):
                raise WarcError("archive ends within a record")
            part = view[at : at + step]
            at += len(part)
            held += inflate.decompress(part)
            while (size := _record_size(held)) and size <= len(held):
                yield bytes(held[:size])
                del held[:size]
        at -= len(inflate.unused_data)
    if held:
        raise WarcError("archive ends within a record")


def _record_size(held: bytearray) -> int:
    """Bytes of the record that held begins with; 0 while its header is not complete."""
    head = held.find(_END)
    if head < 0:
        return 0
    for line in held[:head].split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return head + len(_END) + int(value) + len(_END)
    raise WarcError("record without a length")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise WarcError("not a WARC record")
    named = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    size = int(named["content-length"])
    if rest[size:] != _END:
        raise WarcError("record length differs from its header")
    return named, rest[:size]


# -- writing ----------------------------------------------------------------


def payload_digests(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    data = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha2(data, 256).alias("digest"), F.octet_length(data).cast("long").alias("n"))


def revisits_of(narrow: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, digest, first) of the pages that repeat the payload of a smaller id; narrow: (page_id, digest, n)."""
    long = narrow.filter(F.col("n") >= min_bytes)
    repeated = settle(long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1 and first is not null").select("digest", "first"))
    again = long.join(if_small(repeated, BROADCAST_ROWS), "digest").filter(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    return settle(again.select("page_id", "digest", "first").distinct())


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", html_col: str = "html", min_bytes: int = 100, segment: int = SEGMENT, chunk_at: int = CHUNK_AT, archive: int = ARCHIVE) -> None:
    """Write pages as gzip files of WARC records under path, in any file system that Spark can open."""
    narrow = settle(payload_digests(pages, id_col, html_col))
    again = revisits_of(narrow, min_bytes)
    mean = narrow.agg(F.avg("n")).first()[0] or 0
    data = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), data.alias("payload"), F.when(F.octet_length(data) >= min_bytes, F.sha2(data, 256)).alias("digest"))
    named = again.select(F.col("page_id").alias("of_page"), F.col("digest").alias("of_digest"), F.col("first").alias("refers_to"))
    met = rows["page_id"].eqNullSafe(F.col("of_page")) & (F.col("digest") == F.col("of_digest"))
    rows = rows.join(if_small(named, BROADCAST_ROWS), met, "left").select("page_id", "payload", "refers_to")

    def each(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            out, size = [], 0
            for page_id, payload, refers_to in zip(*b.columns, strict=True):
                n += 1
                for r in page_records(page_id.as_py(), payload.as_py(), refers_to.as_py(), f"{part}-{n}", segment, chunk_at):
                    out.append(r[: -len(_END)])
                    size += len(r)
                if size >= 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    # the cast keeps the bytes as they are
    made = rows.mapInArrow(each, "record binary").select(F.col("record").cast("string").alias("value"))
    per_file = max(1, archive // (int(mean) + 500))
    made.write.option("lineSep", _END.decode()).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", per_file).text(path)


# -- reading ----------------------------------------------------------------

_PARSED = "kind string, page_id long, origin string, segment int, total long, refers_to long, digest string, payload_bytes long, block binary"


def _parse_archives(batches):
    names = [x.split()[0] for x in _PARSED.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in _PARSED.split(", ")]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
    number = lambda uri: int(x) if (x := uri.rsplit(":", 1)[1]) else None
    for b in batches:
        for data in b.column(0).to_pylist():
            rows = []
            for raw in records_of(data):
                head, block = parse(raw)
                kind, page = head["warc-type"], number(head["warc-target-uri"])
                digest = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
                if kind == "revisit":
                    rows.append((kind, page, None, None, None, number(head["warc-refers-to-target-uri"]), digest, None, None))
                elif "warc-segment-number" in head:
                    origin = head.get("warc-segment-origin-id") or head["warc-record-id"]
                    total = head.get("warc-segment-total-length")
                    rows.append((kind, page, origin, int(head["warc-segment-number"]), None if total is None else int(total), None, digest, None, block))
                else:
                    rows.append((kind, page, None, None, None, None, digest, *_payload(block, digest), None))
                if len(rows) >= 256:
                    yield pack(rows)
                    rows = []
            if rows:
                yield pack(rows)


def _payload(block: bytes, digest: str | None) -> tuple[int]:
    payload = http_payload(block)
    if digest is not None and hashlib.sha256(payload).hexdigest() != digest:
        raise WarcError("payload differs from its digest")
    return (len(payload),)


def join_segments(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of a record from (number, total length, part), in any order."""
    ordered = sorted(segments, key=lambda x: x[0])
    if [x[0] for x in ordered] != list(range(1, len(ordered) + 1)):
        raise WarcError("a segment is missing or repeated")
    block = b"".join(x[2] for x in ordered)
    if ordered[-1][1] != len(block):
        raise WarcError("segments do not add up to the total length")
    return block


def _reassemble(batches):
    for b in batches:
        rows = b.to_pylist()
        out = []
        for r in rows:
            block = join_segments([(s["segment"], s["total"], s["block"]) for s in r["segments"]])
            out.append(_payload(block, r["digest"])[0])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], ["page_id", "digest", "payload_bytes"])


def read_archives(spark, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the archives under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    # kept once: payloads are digested already, only blocks of segmented records are in it
    parsed = settle(files.mapInArrow(_parse_archives, _PARSED))
    parts = parsed.filter("segment is not null")
    # the parts of one record are one page's own bytes
    whole = parts.groupBy("origin").agg(F.max("page_id").alias("page_id"), F.max("digest").alias("digest"), F.collect_list(F.struct("segment", "total", "block")).alias("segments"))
    joined = whole.select("page_id", "digest", "segments").mapInArrow(_reassemble, "page_id long, digest string, payload_bytes long")
    none = F.lit(None).cast("long")
    single = parsed.filter("segment is null and kind = 'response'").select("page_id", "payload_bytes", "digest", F.lit("response").alias("record_type"), none.alias("refers_to"))
    large = joined.select("page_id", "payload_bytes", "digest", F.lit("response"), none)
    responses = single.union(large)
    revisits = parsed.filter("kind = 'revisit'").select("page_id", "digest", "refers_to")
    # a revisit's payload is its response's
    sizes = responses.groupBy(F.col("digest").alias("of_digest")).agg(F.max("payload_bytes").alias("payload_bytes"))
    resolved = revisits.join(sizes, F.col("digest") == F.col("of_digest")).select("page_id", "payload_bytes", "digest", F.lit("revisit"), "refers_to")
    out = responses.union(resolved)
    return out.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", **options) -> DataFrame:
    """Write pages as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, id_col, html_col, **options)
    return read_archives(spark, path)
