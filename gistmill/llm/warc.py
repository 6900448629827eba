"""WARC archives: writing pages, and putting segmented records together again.

Archives are text files of Spark's own writer whose line separator is the blank
line that ends a record, so they go to any store that Spark can write, and come
back through Spark's reader as pieces that joined by that separator are the
file's bytes. Records longer than ``segment_bytes`` are cut into continuation
records; only these are shuffled when read, by the identifier of the record
they continue. Bodies have chunked transfer framing.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

BREAK = b"\r\n\r\n"
SEGMENT_BYTES = 16 * 1024
CHUNK_BYTES = 4 * 1024
RECORDS_PER_FILE = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + BREAK


def base32(sha1_hex: Column) -> Column:
    """Base32 of a SHA-1 in hex: eight digits for each ten, 40 bits at a time."""
    parts = [
        F.lpad(F.conv(F.substring(sha1_hex, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)
    ]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


# --- bytes --------------------------------------------------------------------


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = []
    for a in range(0, len(payload), size):
        part = payload[a : a + size]
        out += [b"%X\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0", BREAK])


def unchunked(body: bytes) -> bytes | None:
    """Payload of a chunked body; None if the framing is broken. Chunk
    extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        if size < 0:
            return None
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def decoded(block: bytes) -> bytes | None:
    """Payload of an HTTP response."""
    head, found, body = block.partition(BREAK)
    if not found:
        return None
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers if v is not None], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + BREAK + block


def _cuts(block: bytes, size: int) -> list[bytes]:
    """Pieces of at most ``size`` bytes, cut between UTF-8 characters."""
    out, a = [], 0
    while len(block) - a > size:
        b = a + size
        while b > a + 1 and block[b] & 0xC0 == 0x80:
            b -= 1
        out.append(block[a:b])
        a = b
    return [*out, block[a:]]


def records(page: str, url: str | None, payload: bytes, digest: str, refers: str | None, segment: int) -> list[bytes]:
    """The records of a page: one, or one and its continuations."""
    name = f"<urn:page:{page}:{digest}>"
    uri = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    common = [
        ("WARC-Record-ID", name),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers is not None:
        more = [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers}:{digest}>")]
        return [_record([("WARC-Type", "revisit"), *common, *more], HTTP)]
    block = HTTP + chunked(payload)
    pieces = _cuts(block, segment)
    if len(pieces) == 1:
        return [_record([("WARC-Type", "response"), *common], block)]
    out = [_record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", "1")], pieces[0])]
    for n, piece in enumerate(pieces[1:], 2):
        headers = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"<urn:page:{page}:{digest}:{n}>"),
            ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("WARC-Segment-Origin-ID", name),
            ("WARC-Segment-Number", str(n)),
            ("WARC-Segment-Total-Length", str(len(block)) if n == len(pieces) else None),
        ]
        out.append(_record(headers, piece))
    return out


# --- writing ------------------------------------------------------------------


def _to_records(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, url, payload, sha1, refers in zip(
                *[batch.column(c).to_pylist() for c in ("page", "url", "payload", "sha1", "refers")], strict=True
            ):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                out += records(page, url, payload, digest, refers, segment)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return run


def write_archives(
    pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, revisit_from: int = 0
) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) under ``path``.

    Of rows with equal payloads of at least ``revisit_from`` bytes the one with
    the largest page_id is a response, the others are revisits that refer to
    it; shorter ones are all responses. Null html is an empty payload, a null
    url has no target header, a null page_id comes before all others. Rows equal
    in page_id and payload get records with equal identifiers, all responses if
    one of them is. Other columns are not read.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    known = pages.select(F.col("page_id").cast("bigint"), "url", payload.alias("payload"))
    known = known.withColumn("sha1", F.sha1("payload"))
    last = known.groupBy("sha1").agg(F.max("page_id").alias("last"))
    # pages need no sort: the other side has a short row per payload
    rows = known.join(last.hint("shuffle_hash"), "sha1")
    again = (F.length("payload") >= revisit_from) & ~F.col("page_id").eqNullSafe(F.col("last"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    made = rows.select(
        text("page_id").alias("page"), "url", "payload", "sha1", F.when(again, text("last")).alias("refers")
    ).mapInArrow(_to_records(segment_bytes), "value binary")
    writer = made.select(F.col("value").cast("string")).write
    writer.option("lineSep", BREAK.decode()).option("compression", "gzip").option(
        "maxRecordsPerFile", RECORDS_PER_FILE
    ).text(path)


# --- reading ------------------------------------------------------------------

PARSED = (
    "record_id string, type string, uri string, digest string, refers_to string, "
    "origin string, segment int, total bigint, block binary"
)


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _stream(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple]:
    """Records of files that come in pieces; keeps one record at a time."""
    file, held, head, end = None, bytearray(), None, 0
    for name, piece in pieces:
        if name != file:
            file, held, head = name, bytearray(), None
        held += piece + BREAK
        while True:
            if head is None:
                at = held.find(BREAK)
                if at < 0:
                    break
                head = _headers(bytes(held[:at]))
                start = at + len(BREAK)
                end = start + int(head["content-length"])
            if len(held) < end + len(BREAK):
                break
            block = bytes(held[start:end])
            del held[: end + len(BREAK)]
            number, total = head.get("warc-segment-number"), head.get("warc-segment-total-length")
            yield (
                head.get("warc-record-id"),
                head.get("warc-type"),
                head.get("warc-target-uri"),
                (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
                head.get("warc-refers-to"),
                head.get("warc-segment-origin-id"),
                None if number is None else int(number),
                None if total is None else int(total),
                block,
            )
            head = None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in PARSED.split(", ")]

    def pieces():
        for batch in batches:
            yield from zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True)

    def made(rows):
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    rows, size = [], 0
    for row in _stream(pieces()):
        rows.append(row)
        size += len(row[-1])
        if len(rows) >= 2000 or size > 1 << 23:
            yield made(rows)
            rows, size = [], 0
    if rows:
        yield made(rows)


@F.arrow_udf(BinaryType())
def _payload(blocks: pa.Array) -> pa.Array:
    return pa.array([None if b is None else decoded(b) for b in blocks.to_pylist()], pa.binary())


def parse_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record as it stands in the files (columns ``PARSED``)."""
    lines = spark.read.option("lineSep", BREAK.decode()).text(path)
    pieces = lines.select(F.input_file_name().alias("file"), F.col("value").cast("binary"))
    return pieces.mapInArrow(_parse, PARSED)


def reassemble(parsed: DataFrame) -> DataFrame:
    """Segments of a record put together: rows of ``record_id, uri, digest,
    block``, as many as there are first segments of that identifier; ``block``
    is null where segments are missing or the total length is not theirs."""
    segments = parsed.where("segment is not null")
    first = F.col("segment") == 1
    whole = (
        segments.groupBy(F.coalesce("origin", "record_id").alias("record_id"))
        .agg(
            F.sort_array(F.collect_set(F.struct("segment", "block"))).alias("parts"),
            F.max("total").alias("total"),
            F.max(F.when(first, F.col("uri"))).alias("uri"),
            F.max(F.when(first, F.col("digest"))).alias("digest"),
            F.count_if(first).alias("times"),
        )
        .where("times > 0")
    )
    blocks = F.transform("parts", lambda p: p["block"])
    joined = F.aggregate(blocks, F.lit(b""), lambda a, b: F.concat(a, b))
    numbers = F.transform("parts", lambda p: p["segment"])
    sound = (numbers == F.sequence(F.lit(1), F.size("parts"))) & (F.length(joined) == F.col("total"))
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))
    return whole.withColumn("again", again).select(
        "record_id", "uri", "digest", F.when(sound, joined).alias("block")
    )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, uri, type, record_id, refers_to, digest, payload, ok)`` per page.

    Segments are put together, chunked framing is undone. A revisit has no
    payload of its own. ``ok`` is false where segments are missing, the total
    length or the framing is wrong, or the payload has another digest.
    """
    parsed = parse_archives(spark, path)
    columns = ["record_id", "uri", "type", "refers_to", "digest", "block"]
    whole = parsed.where("segment is null").select(*columns)
    parts = reassemble(parsed).withColumns({"type": F.lit("response"), "refers_to": F.lit(None).cast("string")})
    found = whole.unionByName(parts.select(*columns))
    own = F.when(F.col("type") == "response", F.col("block"))
    found = found.withColumn("payload", _payload(own))
    same = base32(F.sha1("payload")) == F.col("digest")
    page = F.regexp_extract("record_id", r"^<urn:page:(-?\d+):", 1)
    return found.select(
        F.when(page != "", page).cast("bigint").alias("page_id"),
        "uri",
        "type",
        "record_id",
        "refers_to",
        "digest",
        "payload",
        ((F.col("type") == "revisit") | F.coalesce(same, F.lit(False))).alias("ok"),
    )
