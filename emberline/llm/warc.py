"""Web archives: records written per page, and captures put together again from the records of all files.

Every page becomes three records in one file of the shared folder: the request, the response (or, for a payload that another page holds as its
response, a revisit without payload), and metadata. Request and metadata name the response in ``WARC-Concurrent-To``. Files are sets of gzip members, one per
record. Reading needs no order: records are parsed file by file, and requests and metadata are joined to the principal record by the
identifier they name, wherever they lie; metadata may also name the request. One nested row per capture comes out.

Defined results: a null or empty payload is empty, and a response; a null address is an empty one; a null id can revisit and be a response;
rows with one id and one payload are captures of their own; an empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.llm.common import AtomicFile, cut, importable, open_input, reliable_cut, scratch_path, small

REVISIT_BYTES = 1000
FILE_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- writing ---------------------------------------------------------------------------------------------------------------

def record_types(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """page_id, url, html, digest (hex), refers_to: the response's id for those that revisit it, else null."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1("html"))
    large = rows.filter(F.octet_length("html") >= REVISIT_BYTES)
    # One row per payload that occurs more than once; the aggregation combines before the shuffle, so a hot payload is no hot task.
    held = large.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).filter("n > 1 and holder is not null")
    held = small(reliable_cut(held.select("digest", "holder"), "payloads"))
    return rows.join(held, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder")).alias("refers_to")
    )


def record_id(kind: str, page_id, digest: str) -> str:
    h = hashlib.md5(f"{kind}:{page_id}:{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def header_safe(text: str) -> str:
    """Control characters would end a header line; they are percent-coded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", text)


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields], f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + pack.flush()


def capture_records(page_id, url: str, html: bytes, digest: str, refers_to) -> Iterator[bytes]:
    url = header_safe(url)
    coded = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    own = record_id("response", page_id, digest)
    common = [("WARC-Target-URI", url), ("WARC-Date", DATE)]
    host, _, path = url.partition("://")[2].partition("/")
    request = f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    yield record(
        "request", [("WARC-Record-ID", record_id("request", page_id, digest)), ("WARC-Concurrent-To", own), *common,
                    ("Content-Type", "application/http; msgtype=request")], request,
    )
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", coded), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        yield record("response", fields, head + html)
    else:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id("response", refers_to, digest))]
        yield record("revisit", fields, head)
    about = f"page-id: {'' if page_id is None else page_id}\r\nrefers-to-page: {'' if refers_to is None else refers_to}\r\n".encode()
    yield record(
        "metadata", [("WARC-Record-ID", record_id("metadata", page_id, digest)), ("WARC-Concurrent-To", own), *common,
                     ("Content-Type", "application/warc-fields")], about,
    )


def write_archives(typed: DataFrame, folder: str) -> DataFrame:
    """Files below ``folder`` from the rows of ``record_types``; returns their manifest (path, n_captures)."""
    schema = pa.schema([("path", pa.string()), ("n_captures", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, n, rows = None, 0, []
        for batch in batches:
            for part in cut(batch):
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in part.columns)):
                    file = file or AtomicFile(folder, "pages", ".warc.gz")
                    for data in capture_records(page_id, url, html.encode("utf-8"), digest, refers_to):
                        file.write(data)
                    n += 1
                    if file.at >= FILE_BYTES:
                        file.close()
                        rows.append((file.path, n))
                        file, n = None, 0
        if file:
            file.close()
            rows.append((file.path, n))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

    return importable(typed).mapInArrow(task, "path string, n_captures long")


# --- reading ---------------------------------------------------------------------------------------------------------------

def members(source, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unpack, parts, data = zlib.decompressobj(31), [], source.read(size)
    while data:
        parts.append(unpack.decompress(data))
        data = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
        data = data or source.read(size)
    if parts:
        raise ValueError("the last record is cut off")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return headers, rest[: int(headers["content-length"])]


RECORD = (
    "type string, record_id string, concurrent_to string, target_uri string, refers_to_id string, http_head string, "
    "payload_bytes long, payload_digest string, fields map<string,string>"
)


def as_row(headers: dict[str, str], block: bytes, keep_payload: bool) -> dict:
    kind = headers.get("warc-type")
    row = {
        "type": kind, "record_id": headers.get("warc-record-id"), "concurrent_to": headers.get("warc-concurrent-to"),
        "target_uri": headers.get("warc-target-uri"), "refers_to_id": headers.get("warc-refers-to"), "http_head": None,
        "payload_bytes": None, "payload_digest": None, "fields": [],
    }
    if kind in ("request", "response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        row["http_head"] = head.decode("utf-8", "replace")
        if kind == "response":
            row |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}
        elif kind == "revisit":
            # The head and the digest are those of the full payload, which is not here.
            length = re.search(r"(?im)^content-length:\s*(\d+)", row["http_head"])
            coded = headers.get("warc-payload-digest", "sha1:").partition(":")[2]
            row |= {"payload_bytes": int(length[1]) if length else None, "payload_digest": base64.b32decode(coded).hex()}
        if keep_payload:
            row["payload"] = payload if kind == "response" else None
    elif kind == "metadata":
        lines = (line.partition(":") for line in block.decode("utf-8", "replace").splitlines())
        row["fields"] = list({k.strip(): v.strip() for k, sep, v in lines if sep}.items())
    return row


def read_records(spark: SparkSession, manifest: DataFrame, keep_payload: bool = False) -> DataFrame:
    """A row per record of the manifest's files. A file is one task; record after record is in memory."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    text = RECORD + (", payload binary" if keep_payload else "")
    schema = to_arrow_schema(_parse_datatype_string(text))
    names = schema.names

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], schema.field(n).type) for n in names], schema=schema)

        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source = open_input(path)
                for data in members(source):
                    rows.append(as_row(*parse(data), keep_payload))
                    held += len(data)
                    if len(rows) >= 3000 or held >= 64 << 20:
                        yield out(rows)
                        rows, held = [], 0
                source.close()
        yield out(rows)

    files = manifest.select("path")
    return importable(files.repartition(max(1, files.count()), "path")).mapInArrow(task, text)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit record: the record itself, its request, its metadata fields. ``records`` should be a stored
    table, as it is read several times."""
    principal = records.filter(F.col("type").isin("response", "revisit"))
    requests = records.filter("type = 'request'")
    # Of several requests to one response the one with the least identifier; identifiers repeat only if pages do.
    request = requests.groupBy(F.col("concurrent_to").alias("r_id")).agg(
        F.min_by(F.struct("record_id", "http_head"), "record_id").alias("request")
    )
    by_request = requests.select(F.col("record_id").alias("q_id"), F.col("concurrent_to").alias("q_to")).distinct()
    metadata = (
        records.filter("type = 'metadata'")
        .join(by_request, F.col("concurrent_to") == F.col("q_id"), "left")
        .groupBy(F.coalesce("q_to", "concurrent_to").alias("m_id"))
        .agg(F.min_by(F.struct("record_id", "fields"), "record_id").alias("metadata"))
    )
    response = F.struct(*[F.col(c) for c in principal.columns if c not in ("concurrent_to", "fields")]).alias("response")
    return (
        principal.join(request, F.col("record_id") == F.col("r_id"), "left")
        .join(metadata, F.col("record_id") == F.col("m_id"), "left")
        .select(F.col("record_id").alias("capture_id"), "target_uri", response, "request", "metadata")
    )


def op9_transactions(spark, sf_dir: str) -> DataFrame:
    typed = record_types(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    manifest = reliable_cut(write_archives(typed, scratch_path(spark, "warc")), "warc-files")
    # Stored once: the joins below then know its true size, and no archive is parsed twice.
    records = reliable_cut(read_records(spark, manifest), "records")
    field = lambda name: F.expr(f"nullif(metadata.fields['{name}'], '')").cast("long")
    return assemble(records).select(
        field("page-id").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        field("refers-to-page").alias("refers_to"),
        F.col("request.http_head").alias("request_head"),
    )
