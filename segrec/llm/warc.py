"""WARC archives: writing, and reading with reassembly of segmented records.

``write`` stores one response record for each row, or a revisit record for a row whose payload, of at
least ``least_bytes``, equals that of a row with a larger id. A record's block is an HTTP response;
payloads of ``chunked_from`` bytes and more are sent in chunked transfer framing, and blocks longer
than ``segment_bytes`` are cut into a first record with ``WARC-Segment-Number: 1`` and continuation
records that name it in ``WARC-Segment-Origin-ID``; the last one tells ``WARC-Segment-Total-Length``.
Archives begin with a ``warcinfo`` record and hold at most about ``ARCHIVE_BYTES``. They are written by
Spark's text writer (a line is an archive), so they can lie wherever Spark can write.

``read`` parses the archives, groups continuation records by origin, orders them by segment number,
verifies that none is missing and that the lengths add up, and decodes the chunked framing. Only
segmented records are shuffled. A record that doesn't verify is returned with an ``error`` and null
payload, never dropped: segments that are missing, broken framing, headers without a type, an identifier or
a length or with numbers that are none, bytes that begin no record. Reading goes on at the next record that
begins after an empty line; an archive whose compression is cut off gives what can be read, the last record
with an error.

Nulls: a null payload is empty; a null id writes no id header and reads back as null. Rows that tie on
payload and largest id are all responses. Repeated rows are written and read as often as they come. An
empty table gives an empty archive and an empty result. Payload bytes may be of any kind and length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_BYTES = 1000
SEGMENT_BYTES = 16 << 10
CHUNKED_FROM = 4 << 10
CHUNK_BYTES = 2 << 10
#: Bytes of an archive before compression; reading holds one archive at a time.
ARCHIVE_BYTES = 16 << 20
END = b"\r\n\r\n"
_RECORD = "record_id string, origin_id string, segment int, total bigint, page_id string, url string, record_type string, refers_to string, digest string, block binary, error string"


def _cut(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)] or [b""]


def _chunked(payload: bytes, size: int) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(x), x) for x in _cut(payload, size) if x) + b"0\r\n\r\n"


def _record(kind: str, record_id: str, block: bytes, **headers: object) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:sha1:{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + END + block


def _line(url: str | None) -> str | None:
    return None if url is None else "".join(url.splitlines())


def _records(row: dict, record_id: str, segment_bytes: int, chunked_from: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one row: a response, with its continuations, or a revisit."""
    about = {"WARC_Target_URI": _line(row["url"]), "WARC_Payload_Digest": f"sha1:{row['digest']}", "X_Page_ID": row["id"], "Content_Type": "application/http;msgtype=response"}
    if row["refers_to"] is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d" % row["bytes"] + END
        yield _record("revisit", record_id, block, **about, X_Refers_To_Page_ID=row["refers_to"], WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        return
    payload = row["payload"]
    if len(payload) >= chunked_from:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked" + END + _chunked(payload, chunk_bytes)
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d" % len(payload) + END + payload
    parts = _cut(block, segment_bytes)
    yield _record("response", record_id, parts[0], **about, WARC_Segment_Number=1 if len(parts) > 1 else None)
    for k, part in enumerate(parts[1:], 2):
        own = hashlib.sha1(f"{record_id}/{k}".encode()).hexdigest()
        yield _record("continuation", own, part, WARC_Segment_Origin_ID=f"<urn:sha1:{record_id}>", WARC_Segment_Number=k, WARC_Segment_Total_Length=len(block) if k == len(parts) else None)


def _writer(segment_bytes: int, chunked_from: int, chunk_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, archives = TaskContext.get().partitionId(), 0, 0
        out: list[bytes] = []
        held = 0

        def archive() -> pa.RecordBatch:
            nonlocal out, held, archives
            archives += 1
            info = _record("warcinfo", hashlib.sha1(f"{task}//{archives}".encode()).hexdigest(), b"format: WARC File Format 1.1\r\n", Content_Type="application/warc-fields")
            data = END.join([info, *out])
            out, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["record"])

        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                for row in batch.slice(low, 64).to_pylist():
                    n += 1
                    record_id = hashlib.sha1(f"{task}/{n}/{row['id']}/{row['digest']}".encode()).hexdigest()
                    for record in _records(row, record_id, segment_bytes, chunked_from, chunk_bytes):
                        out.append(record)
                        held += len(record)
                        if held >= ARCHIVE_BYTES:
                            yield archive()
        if out:
            yield archive()

    return write


def write(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES, segment_bytes: int = SEGMENT_BYTES, chunked_from: int = CHUNKED_FROM, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write the rows of ``df`` as WARC archives under ``path``."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "same": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("bigint")})
    groups = rows.where(F.col("bytes") >= least_bytes).groupBy("same").agg(F.max("id").alias("keeper"), F.count("*").alias("n"))
    groups = groups.where("n > 1").select(F.col("same").alias("of"), "keeper")
    # what is too short to be revisited stays out of the shuffle
    alone = rows.where(F.col("bytes") < least_bytes).withColumn("refers_to", F.lit(None).cast(rows.schema["id"].dataType))
    told = rows.where(F.col("bytes") >= least_bytes).join(groups, F.col("same") == F.col("of"), "left")
    told = told.withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("keeper")), F.col("keeper")))
    columns = [F.col("id").cast("string"), "url", "payload", "digest", "bytes", F.col("refers_to").cast("string")]
    payloads = told.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    records = payloads.select(*columns).union(alone.select(*columns)).mapInArrow(_writer(segment_bytes, chunked_from, chunk_bytes), "record binary")
    # the cast keeps the bytes as they are
    records.select(F.col("record").cast("string")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(headers, block, error) of each record of an archive; header names in lower case."""
    at = 0
    while at < len(data):
        end = data.find(END, at)
        lines = data[at : len(data) if end < 0 else end].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, length, error = end + len(END), headers.get("content-length", ""), None
        if not lines[0].startswith("WARC/"):
            headers, error = {}, f"no record starts at byte {at}"
        elif end < 0:
            error = "the headers don't end"
        elif not (length.isascii() and length.isdigit() and len(length) < 19):
            error = "no content length"
        elif start + int(length) > len(data):
            error = "the block is cut off"
        if error is None:
            at = start + int(length)
            block = data[start:at]
            at += len(END) if data[at : at + len(END)] == END else 0
        else:
            following = data.find(END + b"WARC/", at + 1)
            following = len(data) if following < 0 else following
            block, at = data[start if 0 < start - len(END) < following else at : following], following + len(END)
        yield headers, block, error


def _unpacked(data: bytes) -> tuple[bytes, str | None]:
    """An archive's bytes, gzip members undone, and what is wrong with their end."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error as wrong:
            return b"".join(out), f"the archive's compression is broken: {wrong}"
        if not member.eof:
            return b"".join(out), "the archive is cut off"
        data = member.unused_data
    return b"".join([*out, data]), None


def _number(text: str | None) -> int | None:
    if text is None:
        return None
    if not (text.isascii() and text.isdigit() and len(text) < 19):
        raise ValueError(f"{text!r} is no number")
    return int(text)


def _row(h: dict[str, str], block: bytes, error: str | None) -> tuple:
    """A record as a row; one that can't take part in a reassembly has an error and no origin."""
    try:
        number, total = _number(h.get("warc-segment-number")), _number(h.get("warc-segment-total-length"))
        if number is not None and number > 2**31 - 1:
            raise ValueError("no such segment number")
    except ValueError as wrong:
        number, total, error = None, None, error or f"segment header: {wrong}"
    lost = [name for name in ("warc-type", "warc-record-id") if not h.get(name)]
    error = error or (f"no {lost[0]}" if lost else None)
    origin = (h.get("warc-segment-origin-id") or (h["warc-record-id"] if number else None)) if error is None else None
    if error is None and h["warc-type"] == "continuation" and not (origin and number):
        origin, error = None, "a continuation without origin or number"
    about = h.get("x-page-id"), h.get("warc-target-uri"), h.get("warc-type"), h.get("x-refers-to-page-id"), h.get("warc-payload-digest", "").removeprefix("sha1:")
    return h.get("warc-record-id"), origin, number, total, *about, None if error else block, error


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [f.split() for f in _RECORD.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in fields])
    for batch in batches:
        for archive in batch.column(0):
            data, broken = _unpacked(archive.as_py())
            rows, held = [], 0
            if broken and not data:
                rows.append(_row({}, b"", broken))
            for h, block, error in parse(data):
                if error is None and h.get("warc-type") == "warcinfo":
                    continue
                rows.append(_row(h, block, error and (broken or error)))
                held += len(block)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)


def _joined(rows: pd.DataFrame) -> pd.DataFrame:
    """One record of all its segments."""
    rows = rows.sort_values("segment")
    whole, numbers = b"".join(rows["block"]), rows["segment"].tolist()
    totals = rows["total"].dropna()
    first = rows.iloc[:1].copy()
    if numbers != list(range(1, len(rows) + 1)):
        first["error"], first["block"] = "segments are missing or repeated", None
    elif len(totals) != 1 or int(totals.iloc[0]) != len(whole):
        first["error"], first["block"] = "the segments' lengths don't add up", None
    else:
        first["block"] = [whole]
    return first


def dechunk(body: bytes) -> bytes:
    """What a body in chunked transfer framing holds."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        chunk = body[end + 2 : end + 2 + size]
        if len(chunk) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(chunk)
        at = end + 4 + size


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            sizes, payloads, errors = [], [], []
            for block, error, kind in zip(*(part.column(part.schema.get_field_index(c)) for c in ("block", "error", "record_type")), strict=True):
                size, payload, error = None, None, error.as_py()
                if error is None:
                    head, _, body = block.as_py().partition(END)
                    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
                    try:
                        payload = None if kind.as_py() == "revisit" else dechunk(body) if fields.get(b"transfer-encoding") == b"chunked" else body
                        size = len(payload) if payload is not None else int(fields[b"content-length"])
                    except (ValueError, KeyError) as wrong:
                        error, size, payload = f"the block can't be read: {wrong}", None, None
                sizes.append(size)
                payloads.append(payload)
                errors.append(error)
            kept = [part.column(part.schema.get_field_index(c)) for c in ("page_id", "url", "record_type", "refers_to", "digest")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes, pa.int64()), pa.array(payloads, pa.binary()), pa.array(errors, pa.string())], names=["page_id", "url", "record_type", "refers_to", "digest", "payload_bytes", "payload", "error"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows (page_id, url, record_type, refers_to, digest, payload_bytes, payload, error) of the archives under ``path``; a revisit has no payload."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    records = files.mapInArrow(_archives, _RECORD)
    # one pass over the archives: records in one piece stay where they are, segments meet by origin
    whole = records.where("origin_id IS NULL")
    segments = records.where("origin_id IS NOT NULL").groupBy("origin_id").applyInPandas(_joined, _RECORD)
    return whole.unionByName(segments).mapInArrow(_bodies, "page_id string, url string, record_type string, refers_to string, digest string, payload_bytes bigint, payload binary, error string")
