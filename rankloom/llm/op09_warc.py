"""WARC archives with segmented records, and their reassembly.

Writing: one record for each page. The first page of equal payloads is a ``response``, the others are ``revisit``
records that refer to it. A response is an HTTP message with chunked transfer coding; a block longer than
``segment_bytes`` goes on in ``continuation`` records. Each record is a gzip member of its own, as in ``.warc.gz``
files. Archives are rows of bytes in a Parquet table of the shared folder, so that a lost executor leaves no
half-written archive; segmented records have archives of their own.

Reading: records are parsed from the archives. Whole ones are decoded at once. Segments are grouped by their origin's
identifier, ordered by segment number and checked against the total length, then the chunked framing is decoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import common as C

SEGMENT_BYTES, ARCHIVE_BYTES, CHUNK = 16 << 10, 4 << 20, 4096
#: Bytes of an archive that the decoder is given at once, and the effort of the encoder (1 to 9).
_READ, _EFFORT = 1 << 14, 4
DATE = "2024-01-01T00:00:00Z"
_CRLF = b"\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """HTTP/1.1 chunked transfer coding."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The payload of a chunked message body; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = data.index(_CRLF, at)
        n = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            return b"".join(out)
        if data[at + n : at + n + 2] != _CRLF:
            raise ValueError("a chunk has another length than its head says")
        out.append(data[at : at + n])
        at += n + 2


def record(kind: str, name: str, block: bytes, **fields: str) -> bytes:
    """One WARC/1.1 record; underscores in field names stand for hyphens."""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    head += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The fields (lower-case names) and the block of one record."""
    end = data.find(b"\r\n\r\n")
    lines = data[: max(end, 0)].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record where one should begin")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if len(data) != end + n + 8 or data[-4:] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut off")
    return fields, data[end + 4 : end + 4 + n]


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, one gzip member each."""
    view, at = memoryview(data), 0
    while at < len(view):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            given = view[at : at + _READ]
            if not given:
                raise ValueError("an archive is cut off")
            parts.append(member.decompress(given))
            at += len(given) - len(member.unused_data)
        yield parse_record(b"".join(parts))


def _safe(url: str | None) -> str | None:
    """A URL that fits a header line."""
    return None if url is None else "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url)


def page_records(name: str, page: int | None, url: str | None, payload: bytes, refers: int | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response with its continuations."""
    own = {"WARC_Target_URI": _safe(url) or None, "WARC_Payload_Digest": f"sha1:{digest(payload)}", "Page_ID": None if page is None else str(page)}
    if refers is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield record("revisit", name, block, **own, WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", WARC_Refers_To=f"<urn:page:{refers}>")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        yield record("response", name, block, **own)
        return
    cuts = range(0, len(block), segment_bytes)
    for k, a in enumerate(cuts, 1):
        part = block[a : a + segment_bytes]
        if k == 1:
            yield record("response", name, part, **own, WARC_Segment_Number="1")
        else:
            yield record("continuation", f"{name}:{k}", part, WARC_Segment_Origin_ID=f"<{name}>", WARC_Segment_Number=str(k), WARC_Segment_Total_Length=str(len(block)) if k == len(cuts) else None)


def _write(segment_bytes: int, archive_bytes: int):
    def run(batches):
        part, number, place = TaskContext.get().partitionId(), 0, 0
        held: dict[bool, list[bytes]] = {False: [], True: []}
        size = {False: 0, True: 0}

        def archive(segmented: bool) -> pa.RecordBatch:
            nonlocal place
            data = b"".join(held[segmented])
            held[segmented], size[segmented] = [], 0
            place += 1
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{place:06d}.warc.gz"]), pa.array([segmented]), C.binary([data])], ["archive", "segmented", "data"])

        for batch in batches:
            for page, url, html, first in zip(*(batch.column(x) for x in ("page_id", "url", "html", "first")), strict=True):
                page = page.as_py()
                name = f"urn:page:{'none' if page is None else page}:{part}-{number}"
                number += 1
                own = [gzip.compress(x, _EFFORT, mtime=0) for x in page_records(name, page, url.as_py(), html.as_py(), first.as_py(), segment_bytes)]
                segmented = len(own) > 1
                held[segmented] += own
                size[segmented] += sum(map(len, own))
                if size[segmented] >= archive_bytes:
                    yield archive(segmented)
        for segmented in (False, True):
            if held[segmented]:
                yield archive(segmented)

    return run


def write_archives(pages: DataFrame, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> tuple[DataFrame, str]:
    """Archives of all pages, as rows (archive, segmented, data) of a table in the shared folder."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html"))
    keyed = rows.withColumns({"_sha": F.sha1("html"), "_mix": F.xxhash64("html"), "_size": F.octet_length("html")})
    # copies only: a payload of its own needs no partner; partial aggregation keeps a hot payload small
    same = keyed.where(F.col("_size") >= min_bytes).groupBy("_sha", "_mix", "_size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    joined = keyed.join(same, ["_sha", "_mix", "_size"], "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return C.save(joined.select("page_id", "url", "html", refers.alias("first")).mapInArrow(_write(segment_bytes, archive_bytes), "archive string, segmented boolean, data binary"), "warc")


_PARTS = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()), ("kind", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("block", pa.binary())])
_PAGES = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _page(fields: dict[str, str], block: bytes, keep_payload: bool) -> tuple:
    """What a record says of its page, its payload checked against its digest."""
    kind, found = fields["warc-type"], (fields.get("warc-payload-digest") or "").removeprefix("sha1:")
    head, _, body = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(_CRLF)[1:])}
    payload, refers = None, fields.get("warc-refers-to")
    if kind == "revisit":
        n = int(http[b"content-length"])
    else:
        payload = unchunked(body) if http.get(b"transfer-encoding") == b"chunked" else body
        n = len(payload)
        if digest(payload) != found:
            raise ValueError(f"{fields['warc-record-id']}: another payload than was digested")
    return _number(fields.get("page-id")), n, found, kind, _number(refers and refers.strip("<>").removeprefix("urn:page:")), payload if keep_payload else None


def _whole(keep_payload: bool):
    """The pages of records without segments, decoded where they are parsed."""

    def run(batches):
        for batch in batches:
            for data in batch.column("data"):
                yield _batch([_page(f, block, keep_payload) for f, block in records(data.as_py()) if "warc-segment-number" not in f], _PAGES)

    return run


def _segments(batches):
    """The segments of each archive as rows."""
    for batch in batches:
        for data in batch.column("data"):
            out = []
            for f, block in records(data.as_py()):
                if "warc-segment-number" in f:
                    more = f["warc-type"] == "continuation"
                    out.append((
                        f["warc-segment-origin-id" if more else "warc-record-id"].strip("<>"), int(f["warc-segment-number"]), _number(f.get("warc-segment-total-length")),
                        _number(f.get("page-id")), f["warc-type"], f.get("warc-payload-digest"), None, block))
            yield _batch(out, _PARTS)


def _join_segments(keep_payload: bool):
    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                numbers = [x["number"] for x in row["parts"]]
                if numbers != list(range(1, len(numbers) + 1)):
                    raise ValueError(f"{row['origin']}: segments {numbers}")
                block = b"".join(x["block"] for x in row["parts"])
                if row["total"] != len(block):
                    raise ValueError(f"{row['origin']}: {len(block)} bytes of {row['total']}")
                fields = {"warc-type": row["kind"], "warc-record-id": row["origin"], "warc-payload-digest": row["digest"]}
                _, *rest = _page(fields, block, keep_payload)
                out.append((row["page_id"], *rest))
            yield _batch(out, _PAGES)

    return run


def read_archives(archives: DataFrame, keep_payload: bool = False) -> DataFrame:
    """The pages of archives (archive, segmented, data); ``segmented`` may be false only where no record is.

    Segments alone are shuffled, and a group is one record, so it has at most that record's bytes.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to and, on request, payload (null for revisits).
    """
    shape = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    whole = archives.select("data").mapInArrow(_whole(keep_payload), shape)
    parts = archives.where(F.coalesce("segmented", F.lit(True))).select("data").mapInArrow(
        _segments, "origin string, number int, total long, page_id long, kind string, digest string, refers_to long, block binary")
    grouped = parts.groupBy("origin").agg(
        F.max("total").alias("total"), F.max("page_id").alias("page_id"), F.max(F.when(F.col("kind") != "continuation", F.col("kind"))).alias("kind"), F.max("digest").alias("digest"),
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"))
    out = whole.unionByName(grouped.mapInArrow(_join_segments(keep_payload), shape))
    return out if keep_payload else out.drop("payload")


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write all pages to archives and read them back.

    Null html is an empty payload; a null page_id stays null and, among equal payloads, refers to the smallest id;
    rows that repeat both page_id and payload are a response each; an empty table gives an empty result; other
    columns are ignored. A missing segment, a wrong total or a digest that differs fails the job.
    """
    archives, _ = write_archives(pages, min_bytes, segment_bytes)
    return read_archives(archives)


def op9_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(C.read(spark, sf_dir, "pages"))


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (
  SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first_id,
         list_transform(range(0, 160), lambda i: (CASE substr(hex, (i // 4 + 1)::BIGINT, 1) WHEN 'a' THEN 10 WHEN 'b' THEN 11 WHEN 'c' THEN 12
           WHEN 'd' THEN 13 WHEN 'e' THEN 14 WHEN 'f' THEN 15 ELSE ascii(substr(hex, (i // 4 + 1)::BIGINT, 1)) - 48 END >> (3 - i % 4)::INT) & 1) AS bits
  FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (1 + 16 * bits[5 * k + 1] + 8 * bits[5 * k + 2] + 4 * bits[5 * k + 3] + 2 * bits[5 * k + 4] + bits[5 * k + 5])::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM b
"""
