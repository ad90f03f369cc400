"""Legacy ARC archives converted to WARC, with duplicates as revisits; WARC writing and reading.

An ARC file starts with a version block that says which fields its header lines have (version 1:
5 fields, version 2: 10 fields); each record is one header line and as many bytes as its last field
declares. The converter makes of each record what a WARC record needs and ARC lacks: an
identifier, an ISO timestamp, a record type and digests.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import KeyFilter, Scratch, bounded, col, scratch_path, slices, spread_join

#: Fields of a header line by ARC version, as its version block names them (fixed values).
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Bytes after which a new ARC file is begun, and those of compressed records after which a WARC file is.
ARC_BYTES, WARC_BYTES = 4 << 20, 32 << 20
#: An empty gzip member, as the text that ends a line of Spark's text sink in the charset of bytes.
_NO_MEMBER = gzip.compress(b"", mtime=0).decode("latin-1")
#: The HTTP header by which a record carries the id of the row that it was made of.
ID_HEADER = b"X-Source-Id"

RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("warc_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("warc_date", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("http_header", T.BinaryType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def arc_version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 archive\n{ARC_FIELDS[version]}\n".encode()
    dots = [] if version == 1 else ["200", "-", "-", "0", name]
    return " ".join([f"filedesc://{name}", "0.0.0.0", date, "text/plain", *dots, str(len(body))]).encode() + b"\n" + body + b"\n"


def arc_record(url: str, date: str, body: bytes, version: int, offset: int, name: str) -> bytes:
    middle = [] if version == 1 else ["200", digest(body), "-", str(offset), name]
    return " ".join([url, "0.0.0.0", date, "text/html", *middle, str(len(body))]).encode() + b"\n" + body + b"\n"


def http_response(source_id, payload: bytes) -> bytes:
    own = b"" if source_id is None else b"%s: %s\r\n" % (ID_HEADER, str(source_id).encode())
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n%s" % (own, len(payload), payload)


def pack_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20000101000000") -> DataFrame:
    """``(path, content)``: ARC files, versions 1 and 2 in turn, that hold the rows of ``pages``.

    The columns are those of Spark's ``binaryFile`` source, so ``convert_arc`` reads either. Null
    html is an empty payload, a null url is ``about:blank``; a null id leaves out the id header.
    Repeated rows are records of their own, other columns are ignored; an empty table gives no file.
    """
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])

    def run(batches):
        from pyspark import TaskContext

        part, files = TaskContext.get().partitionId(), 0
        for batch in slices(batches, 512):
            ids, urls, bodies = (c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2).cast(pa.binary())))
            at = 0
            while at < len(ids):
                name, version = f"{part:05d}-{files:05d}.arc", 1 + files % 2
                out = bytearray(arc_version_block(name, version, date))
                while at < len(ids) and len(out) < ARC_BYTES:
                    url = "".join(f"%{ord(c):02X}" if c.isspace() else c for c in (urls[at] or "about:blank"))
                    out += arc_record(url, date, http_response(ids[at], bodies[at] or b""), version, len(out), name)
                    at += 1
                files += 1
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([bytes(out)], pa.binary())], names=["path", "content"])

    return bounded(pages.select(col(id_col).alias("id"), col(url_col).alias("url"), col(html_col).alias("html"))).mapInArrow(run, schema)


def iso_date(digits: str) -> str:
    """``YYYYMMDDhhmmss``, or a shorter form of it, as WARC writes it."""
    full = (digits + "00000101000000"[len(digits) :])[:14]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its blank line, and payload; blocks that are no HTTP have no header."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block[: end + 4], block[end + 4 :]) if end >= 0 else (block, b"")


def header_value(header: bytes, name: bytes) -> str | None:
    for line in header.split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name.lower():
            return value.strip().decode("utf-8", "replace")
    return None


def read_arc(path: str, data: bytes) -> Iterator[dict]:
    """The records of an ARC file; what breaks the format gives a last row with ``error``."""
    at, version = 0, None
    name = path.rsplit("/", 1)[-1]
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)

    def bad(why: str) -> dict:
        return dict.fromkeys(RECORD.names) | {"warc_type": "error", "error": f"{name} at {at}: {why}"}

    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            yield bad("header line without end")
            return
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        first = version is None
        if first:
            if not line.startswith("filedesc://"):
                yield bad("no version block")
                return
            text = data[end + 1 : end + 3].decode("latin-1").strip()
            version = int(text) if text.isdigit() and int(text) in ARC_FIELDS else None
            if version is None:
                yield bad(f"version {text!r} is unknown")
                return
        # a URL may hold spaces, so fields count from the end
        fields = line.rsplit(" ", ARC_FIELDS[version].count(" "))
        if len(fields) <= ARC_FIELDS[version].count(" ") or not fields[-1].isdigit() or not fields[2].isdigit():
            yield bad("header line doesn't fit its version")
            return
        length = int(fields[-1])
        block = data[end + 1 : end + 1 + length]
        if len(block) < length:
            yield bad(f"{length} bytes are declared, {len(block)} are there")
            return
        header, payload = split_http(block)
        yield {
            "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{fields[0]}|{fields[2]}|{name}|{at}')}>",
            "warc_type": "warcinfo" if first else "response" if header else "resource",
            "target_uri": fields[0],
            "warc_date": iso_date(fields[2]),
            "content_type": "application/http; msgtype=response" if header else fields[3],
            "source_id": header_value(header, ID_HEADER) if header else None,
            "payload_bytes": len(payload),
            "payload_digest": digest(payload),
            "error": None,
            "http_header": header,
            "payload": payload,
        }
        at = end + 1 + length


def _arrow_rows(rows: Iterator[dict], schema: T.StructType, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, held, size = to_arrow_schema(schema), [], 0
    for row in rows:
        held.append(row)
        size += 500 + len(row.get("payload") or b"")
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, arrow)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, arrow)


def convert_arc(files: DataFrame, payload: bool = True) -> DataFrame:
    """What the ARC files of ``files (path, content)`` hold, as fields of WARC records.

    One row a record, version blocks as ``warcinfo``; broken files give a row with ``error``.
    Without ``payload`` the two binary columns are left out.
    """
    schema = RECORD if payload else T.StructType(RECORD.fields[:-2])

    def run(batches):
        def rows():
            for batch in batches:
                for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    for row in read_arc(path or "", data.as_py() or b""):
                        yield row if payload else {k: row[k] for k in schema.names}

        yield from _arrow_rows(rows(), schema)

    return bounded(files.select("path", "content")).mapInArrow(run, schema)


def mark_revisits(records: DataFrame, min_bytes: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """``records``, a written table of ``convert_arc``, with ``refers_id`` and ``refers_record``: of equal
    payloads of at least ``min_bytes``, the record with the smallest source id is the one that others
    revisit. Revisits come without payload. Version blocks and errors are left out.

    Ids compare as numbers where they are such; null ids come last, and where all are null nothing
    is a revisit. Repeated rows of the smallest id are all responses. Columns that are not those of
    ``convert_arc`` are left out; an empty table gives no rows.

    What is a revisit is found without payloads. Payloads stay where they are, but for the few that
    two filters of bounded size can't tell from those of revisits.
    """
    save = (scratch or Scratch(records.sparkSession, "revisits")).written
    rows = records.select(*RECORD.names).where("error IS NULL AND warc_type <> 'warcinfo'")
    order = F.struct(F.col("source_id").isNull().alias("none"), F.expr("try_cast(source_id AS bigint)").alias("number"), F.col("source_id").alias("id"), F.col("record_id").alias("record"))
    long_enough = rows.where((F.col("warc_type") == "response") & (F.col("payload_bytes") >= min_bytes))
    firsts = long_enough.groupBy("payload_digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1 AND first.id IS NOT NULL")
    firsts = save(firsts.select("payload_digest", F.col("first.id").alias("refers_id"), F.col("first.record").alias("refers_record")), "firsts")
    heads = KeyFilter(firsts, F.col("payload_digest"), save).maybe(rows.drop("payload").where(F.col("payload_bytes") >= min_bytes), F.col("payload_digest"), "shared")
    heads = save(heads.where("shared").drop("shared"), "heads")
    revisits = spread_join(heads, firsts, "payload_digest", F.col("record_id")).where(~F.col("source_id").eqNullSafe(F.col("refers_id")))
    revisits = save(revisits.withColumn("payload", F.lit(None).cast("binary")).select(*RECORD.names, "refers_id", "refers_record"), "revisits")
    maybe = KeyFilter(revisits, F.col("record_id"), save)
    # records that the first filter takes for revisits, but are none
    others = save(maybe.maybe(rows.select("record_id"), F.col("record_id"), "taken").where("taken").join(revisits.select("record_id"), "record_id", "left_anti").select("record_id"), "others")
    told = KeyFilter(others, F.col("record_id"), save).maybe(maybe.maybe(rows, F.col("record_id"), "taken"), F.col("record_id"), "other")
    back = told.where("taken AND other").join(others.distinct(), "record_id", "left_semi")
    none = F.lit(None).cast("string")
    kept = told.where("NOT taken").select(*RECORD.names).unionByName(back.select(*RECORD.names))
    return kept.select(*RECORD.names, none.alias("refers_id"), none.alias("refers_record")).unionByName(revisits)


def warc_record(row: dict) -> bytes:
    """A record without its two closing line ends; of a revisit, the block is the HTTP header alone."""
    revisit = row["refers_record"] is not None
    block = row["http_header"] + (b"" if revisit else row["payload"])
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else row['warc_type']}",
        f"WARC-Record-ID: {row['record_id']}",
        f"WARC-Date: {row['warc_date']}",
        f"WARC-Target-URI: {row['target_uri']}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"Content-Type: {row['content_type']}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {row['refers_record']}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Source-Id: {row['refers_id']}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block


def warcinfo_record() -> bytes:
    body = b"format: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'warcinfo')}>\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body


def write_warc(records: DataFrame, path: str, file_bytes: int = WARC_BYTES) -> None:
    """Writes the rows of ``mark_revisits`` as WARC files, each with a warcinfo record first and each
    record a gzip member of its own, so that readers may seek to one.

    A file is closed once its records have ``file_bytes``, so only one longer record makes it longer
    by more than that. Spark's text sink writes the bytes as they are, a line a file, and an empty gzip
    member after it; its commit protocol sees to it that a lost task leaves no half file. Repeated
    rows are written as often as they are there; other columns are ignored; an empty table gives an
    empty folder.
    """

    def run(batches):
        def member(record: bytes) -> bytes:
            return gzip.compress(record + b"\r\n\r\n", 6, mtime=0)

        def file(out: bytearray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([bytes(out)], pa.binary())], names=["value"])

        out = bytearray()
        for batch in slices(batches, 64):
            for row in batch.to_pylist():
                out += (b"" if out else member(warcinfo_record())) + member(warc_record(row))
                if len(out) >= file_bytes:
                    yield file(out)
                    out = bytearray()
        if out:
            yield file(out)

    made = bounded(records.select(*RECORD.names, "refers_id", "refers_record")).mapInArrow(run, T.StructType([T.StructField("value", T.BinaryType())]))
    made.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", _NO_MEMBER).option("maxRecordsPerFile", 1).text(path)


READ = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("warc_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("warc_date", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("refers_id", T.StringType()),
        T.StructField("refers_record", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def parse_warc(stream) -> Iterator[dict]:
    """The records of one WARC stream, by their declared lengths; never more than one in memory."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        head = line
        while (line := stream.readline()).strip():
            head += line
        length = int(header_value(head, b"Content-Length") or 0)
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"{length} bytes are declared, {len(block)} are there")
        kind, value = header_value(head, b"WARC-Type"), lambda name, h=head: header_value(h, name)
        http, payload = split_http(block)
        row = dict.fromkeys(READ.names) | {"record_id": value(b"WARC-Record-ID"), "warc_type": kind, "target_uri": value(b"WARC-Target-URI"), "warc_date": value(b"WARC-Date"), "source_id": header_value(http, ID_HEADER)}
        if kind == "revisit":
            declared = value(b"WARC-Payload-Digest") or ""
            yield row | {"refers_id": value(b"X-Refers-To-Source-Id"), "refers_record": value(b"WARC-Refers-To"), "payload_bytes": int(header_value(http, b"Content-Length") or 0), "payload_digest": declared.removeprefix("sha1:")}
        else:
            yield row | {"payload_bytes": len(payload), "payload_digest": digest(payload), "payload": payload}


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all WARC files below ``path``, gzipped or not; digests of payloads that are
    there are computed anew, those of revisits are the declared ones."""
    schema = READ if payload else T.StructType(READ.fields[:-1])

    def run(batches):
        def rows():
            for batch in batches:
                for data in batch.column(0):
                    raw = data.as_buffer()
                    gz = bytes(raw[:2]) == b"\x1f\x8b"
                    for row in parse_warc(gzip.GzipFile(fileobj=io.BytesIO(raw)) if gz else io.BytesIO(raw)):
                        yield row if payload else {k: row[k] for k in schema.names}

        yield from _arrow_rows(rows(), schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return bounded(files.select("content")).mapInArrow(run, schema)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, path: str | None = None, file_bytes: int = WARC_BYTES) -> DataFrame:
    """Pages through ARC files into WARC files at ``path`` (by default in the shared folder), and the
    records as read back from there.

    Each row gives a record, repeated ones and those with null id, url or html too; other columns
    are ignored, whatever their names; an empty table gives no records.
    """
    spark = pages.sparkSession
    path, scratch = path or scratch_path(spark, "warc"), Scratch(spark, "arc")
    records = scratch.written(convert_arc(pack_arc(pages, id_col, url_col, html_col)), "records")
    write_warc(mark_revisits(records, min_bytes, scratch), path, file_bytes)
    scratch.drop()
    return read_warc(spark, path, payload=False)
