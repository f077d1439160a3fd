"""WARC archives: writing with segmentation and revisits, reading with segment reassembly.

Archives are written and read by Spark's own text source, so they lie wherever Spark can write. A record ends with two
line ends, and those are the text source's separator: joined by it, the rows of a file are the file's bytes again, and a
parser that goes by Content-Length cuts them into records while it holds no more than one.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch

END = b"\r\n\r\n"
VERSION = b"WARC/1.1"
#: Bytes of a record's block above which it is segmented, and of a chunk of the transfer framing.
SEGMENT, CHUNK = 32_768, 8_192
#: Payloads of fewer bytes are never written as revisits.
LEAST = 100
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # for URLs; fixed value of RFC 4122
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunk(body: bytes) -> bytes:
    """The content of chunked framing, with chunk extensions and trailers passed over; ValueError if it is cut short or broken."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        digits = body[at:line].split(b";")[0].strip()
        if not re.fullmatch(b"[0-9A-Fa-f]+", digits):
            raise ValueError("a chunk has no size")
        size = int(digits, 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """What an HTTP response carries: after its header, and out of its framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return dechunk(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def record(fields: Iterable[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return b"%b\r\n%bContent-Length: %d\r\n\r\n%b" % (VERSION, head, len(block), block)


def record_id(key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, str(key))}>"


def records(key: object, name: object, url: str, payload: bytes, digest: str, revisits: object = None, segment: int = SEGMENT, chunk: int = CHUNK) -> Iterator[bytes]:
    """The records of one capture: a revisit of the record named ``revisits``, or a response, in segments if it is long."""
    own = record_id(key)
    uri = " ".join((url or "").split()) or "about:blank"
    common = [("WARC-Target-URI", uri), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}"), *([] if name is None else [("X-Capture-Key", name)])]
    if revisits is not None:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(revisits))], b"")
        return
    block = HTTP + chunked(payload, chunk)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    for n, part in enumerate(parts, 1):
        if n == 1:
            fields = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("Content-Type", "application/http;msgtype=response")]
        else:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(f"{key}#{n}")), ("WARC-Target-URI", uri), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own)]
        if len(parts) > 1:
            fields.append(("WARC-Segment-Number", n))
            if n == len(parts) and n > 1:
                fields.append(("WARC-Segment-Total-Length", len(block)))
        yield record(fields, part)


class Parser:
    """Cuts a stream of bytes into (fields, block, status); what is not yet complete stays.

    status: whole; malformed, for bytes where a record should begin that are none, up to the next that does, and for a record
    without a length; truncated, for a record that the stream's end cuts short. Nothing raises, and no bytes are lost.
    """

    def __init__(self):
        self.held: list[bytes] = []
        self.size, self.need = 0, 0
        self.head: dict[str, str] | None = None
        self.junk: list[bytes] = []

    def begin(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes, str]]:
        """Take the bytes before a blank line as a record's head, or as none."""
        lines = piece.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            self.junk.append(piece)
            return
        yield from self.dump()
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if head.get("content-length", "").isascii() and head.get("content-length", "").isdigit():
            self.head, self.need = head, int(head["content-length"])
        else:
            yield head, b"", "malformed"

    def dump(self) -> Iterator[tuple[dict[str, str], bytes, str]]:
        if self.junk:
            yield {}, END.join(self.junk), "malformed"
            self.junk = []

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes, str]]:
        self.held.append(data)
        self.size += len(data)
        while self.size and self.size >= self.need:
            data = b"".join(self.held)
            if self.head is None:
                data = data.lstrip(b"\r\n")
                at = data.find(END)
                if at >= 0:
                    yield from self.begin(data[:at])
                    data = data[at + len(END) :]
                self.held, self.size = [data] if data else [], len(data)
                if at < 0:
                    return
                if self.head is None or self.need > self.size:
                    continue
            block, rest = data[: self.need], data[self.need :]
            head, self.head = self.head, None
            self.held, self.size, self.need = [rest] if rest else [], len(rest), 0
            yield head, block, "whole"

    def close(self) -> Iterator[tuple[dict[str, str], bytes, str]]:
        rest = b"".join(self.held)
        if self.head is None and rest.strip(b"\r\n"):
            self.junk.append(rest)
        yield from self.dump()
        if self.head is not None:
            yield self.head, rest, "truncated"
        self.__init__()


def write_warc(df: DataFrame, path: str, key: str, url: str, payload: str, segment: int = SEGMENT, chunk: int = CHUNK, least: int = LEAST) -> None:
    """Write a record for each row of ``df`` to archives (.gz) in the folder ``path``.

    payload: text, written in UTF-8, or bytes; null is empty. Of rows with equal payloads of ``least`` bytes or more, the
    one with the smallest key is a response and the others are revisits of it; of rows that also have equal keys one is the
    response, and null keys come after all others. Rows are numbered and stored first, so that a row that is made anew keeps
    its number. Digests of a pair or more of rows are found by a pre-aggregated shuffle of (digest, key, number), and joined
    from a table, so a payload that a third of all rows have is split over tasks. An empty table gives empty archives.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "warc")
    content = F.coalesce(df[payload].cast("binary"), F.lit(b""))
    rows = df.select(df[key].cast("long").alias("key"), df[url].cast("string").alias("url"), content.alias("payload"), F.sha2(content, 256).alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.keep(rows, "rows")
    long = rows.where(F.length("payload") >= least).select("digest", F.struct(F.col("key").isNull(), "key", "row").alias("who"))
    firsts = scratch.keep(long.groupBy("digest").agg(F.min("who").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"), "firsts")
    joined = rows.join(firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))
    ready = joined.select("key", "row", "url", "digest", F.when(revisit, F.concat_ws("/", F.coalesce(F.col("first.key").cast("string"), F.lit("None")), "first.row")).alias("refers"), F.when(~F.coalesce(revisit, F.lit(False)), F.col("payload")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                made = [r for x in batch.slice(at, 64).to_pylist() for r in records(f"{x['key']}/{x['row']}", x["key"], x["url"], x["payload"] or b"", x["digest"], x["refers"], segment, chunk)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    lines = ready.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines = lines.where("value is not null")
    lines.write.option("compression", "gzip").option("lineSep", END.decode()).option("zlib.compress.level", "BEST_SPEED").mode("overwrite").text(path)
    scratch.drop("rows")


RECORD = "kind string, id string, key bigint, origin string, seg int, total bigint, refers string, uri string, digest string, block binary, status string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the gzip archives at ``path`` (a file, folder or pattern): kind, id, key, origin, seg, total, refers,
    uri, digest, block and status. Archives may be gzipped as a whole or by record; neither is split, so each is one task's
    stream. status: whole, malformed or truncated, as :class:`Parser` has them; fields that a record lacks are null, and a
    number that can't be read makes its record malformed."""
    lines = spark.read.option("lineSep", END.decode()).text(path).select(F.col("value").cast("binary").alias("value"), F.input_file_name().alias("file"))
    arrow = pa.schema([("kind", pa.string()), ("id", pa.string()), ("key", pa.int64()), ("origin", pa.string()), ("seg", pa.int32()), ("total", pa.int64()), ("refers", pa.string()), ("uri", pa.string()), ("digest", pa.string()), ("block", pa.binary()), ("status", pa.string())])

    def row(head: dict[str, str], block: bytes, status: str) -> dict:
        def number(k: str) -> int | None:
            nonlocal status
            if (v := head.get(k)) is None:
                return None
            if re.fullmatch("-?[0-9]{1,18}", v):
                return int(v)
            status = "malformed"
            return None

        return {
            "kind": head.get("warc-type"),
            "id": head.get("warc-record-id"),
            "key": number("x-capture-key"),
            "origin": head.get("warc-segment-origin-id"),
            "seg": number("warc-segment-number"),
            "total": number("warc-segment-total-length"),
            "refers": head.get("warc-refers-to"),
            "uri": head.get("warc-target-uri"),
            "digest": head.get("warc-payload-digest", "").removeprefix("sha256:") or None,
            "block": block,
            "status": status,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, last, made, size = Parser(), None, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for value, file in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ended = parser.close() if file != last else ()
                    for found in (*ended, *parser.feed(value + END)):
                        made.append(row(*found))
                        size += len(found[1])
                    last = file
                if size > 4_000_000 or len(made) > 1000:
                    yield pa.RecordBatch.from_pylist(made, arrow)
                    made, size = [], 0
        made += [row(*found) for found in parser.close()]
        if made:
            yield pa.RecordBatch.from_pylist(made, arrow)

    return lines.mapInArrow(run, RECORD)


def reassemble(found: DataFrame) -> DataFrame:
    """Records with segments joined: (id, key, uri, digest, block, status) of every response, and of bytes that are no record.

    Only records that have a segment number are shuffled, by the record that they continue. status: whole; or missing,
    where a number between 1 and the last, or the last segment, is not there or not whole; or length, where the total
    differs from the announced one; or that of the record itself. Repeated copies of a segment count once. A broken
    record's block is null.
    """
    fine = F.col("status") == "whole"
    alone = found.where("kind is null or kind = 'response' and (seg is null or id is null and origin is null)")
    alone = alone.select("id", "key", "uri", "digest", F.when(fine & F.col("kind").isNotNull(), F.col("block")).alias("block"), F.when(F.col("kind").isNull(), F.lit("malformed")).otherwise(F.col("status")).alias("status"))
    parts = found.where("seg is not null and kind in ('response', 'continuation') and (id is not null or origin is not null)")
    parts = parts.select(F.coalesce("origin", "id").alias("id"), "key", "uri", "digest", F.when(fine, F.col("seg")).alias("seg"), "total", "block")

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seg", kind="stable").drop_duplicates("seg")
        first, totals, whole = group.iloc[0], group["total"].dropna(), group[group["seg"].notna()]
        block, status = None, "missing"
        if list(whole["seg"]) == list(range(1, len(whole) + 1)) and len(totals):
            block = b"".join(whole["block"])
            status = "whole" if len(block) == int(totals.iloc[-1]) else "length"
        return pd.DataFrame({"id": [first["id"]], "key": [first["key"]], "uri": [first["uri"]], "digest": [first["digest"]], "block": [block if status == "whole" else None], "status": [status]})

    joined = parts.groupBy("id").applyInPandas(join, "id string, key bigint, uri string, digest string, block binary, status string")
    return alone.unionByName(joined)


def payloads(responses: DataFrame) -> DataFrame:
    """(id, key, uri, digest, payload_bytes, payload, payload_digest, status) of responses; the digest computed from the payload.
    Where the block is missing, or its framing is broken (status framing), the payload and what follows from it are null."""

    def payload(block: bytes | None) -> bytes | None:
        try:
            return None if block is None else payload_of(block)
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                held = part.column(4).to_pylist()
                out = [payload(b) for b in held]
                status = ["framing" if p is None and b is not None else x for p, b, x in zip(out, held, part.column(5).to_pylist(), strict=True)]
                arrays = [*part.columns[:4], pa.array([None if p is None else len(p) for p in out], pa.int64()), pa.array(out, pa.binary()), pa.array([None if p is None else hashlib.sha256(p).hexdigest() for p in out], pa.string()), pa.array(status, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "key", "uri", "digest", "payload_bytes", "payload", "payload_digest", "status"])

    return responses.select("id", "key", "uri", "digest", "block", "status").mapInArrow(run, "id string, key bigint, uri string, digest string, payload_bytes bigint, payload binary, payload_digest string, status string")


def captures(found: DataFrame) -> DataFrame:
    """A row per capture in ``found``: key, payload_bytes, payload_digest, record_type, refers_to (the key of the response that a
    revisit refers to, else null) and status. A revisit has its response's payload and status; where that is not there, the
    payload's columns are null and the status is unresolved. A broken response has a row with nulls and its status, and so
    have bytes that are no record, whose key and record_type are null too. Responses are kept as a table first, so that
    revisits of one response are split over tasks; of responses that repeat an id, revisits take one."""
    scratch = Scratch(found.sparkSession, "captures")
    own = payloads(reassemble(found)).select("id", "key", "payload_bytes", "payload_digest", "status")
    responses = scratch.keep(own, "responses")
    revisits = scratch.keep(found.where("kind = 'revisit'").select("key", "refers"), "revisits")
    targets = responses.where("id is not null").groupBy(F.col("id").alias("refers")).agg(F.min(F.struct("key", "payload_bytes", "payload_digest", "status")).alias("r"))
    again = revisits.join(targets, "refers", "left").select("key", "r.payload_bytes", "r.payload_digest", F.lit("revisit").alias("record_type"), F.col("r.key").alias("refers_to"), F.coalesce("r.status", F.lit("unresolved")).alias("status"))
    kind = F.when(~((F.col("status") == "malformed") & F.col("id").isNull()), F.lit("response"))
    return responses.select("key", "payload_bytes", "payload_digest", kind.alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"), "status").unionByName(again)
