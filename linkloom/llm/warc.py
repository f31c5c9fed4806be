"""WARC archives of pages, and the assembly of their transactions.

Writing: each page gives a request, a response or revisit, and a metadata record; the first and last
name the second in WARC-Concurrent-To. Records go out through Spark's text writer, one gzip file a
task, each record closed by the blank lines that the format asks for. Reading: files are walked record
by record along Content-Length, and the three records of a capture are joined to one nested row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.scratch import fresh_path, materialise

LEAST_SHARED_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_BYTES = 16 << 20
_CRLF = "\r\n"
_RECORD = (
    "kind string, record_id string, concurrent_to string, refers_to string, target_uri string, page_id long, "
    "payload_digest string, payload_bytes long, payload binary"
)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts]))
    return F.concat(
        F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4),
        F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"),
    )


def assign_types(pages: DataFrame, least_bytes: int = LEAST_SHARED_BYTES) -> DataFrame:
    """(page_id, url, html, digest, bytes, occurrence, first_id) for each row of ``pages``.

    ``first_id`` is the smallest page_id with the same payload of at least ``least_bytes``, else the
    row's own. Payloads meet by digest, as numbers alone; a payload that a third of all pages share is
    counted where it lies before anything is shuffled. The html moves once, by page_id.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "bytes": F.octet_length("html").cast("long")})
    ids = rows.select("page_id", "digest", "bytes").distinct()
    firsts = ids.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    shared = materialise(firsts.filter("n > 1").select("digest", "first_id"), "shared")
    roles = materialise(ids.join(shared, "digest").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "first_id"), "roles")
    by_id = Window.partitionBy("page_id", "digest").orderBy("url")
    joined = rows.join(roles, (F.col("page_id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return joined.select(
        "page_id", "url", "html", "digest", "bytes", F.row_number().over(by_id).alias("occurrence"), F.coalesce("first_id", "page_id").alias("first_id")
    )


def _header(value: Column) -> Column:
    """A header value: line ends can't stand in one, so they, and percent signs, are percent-encoded."""
    out = F.coalesce(value, F.lit(""))
    for mark, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        out = F.replace(out, F.lit(mark), F.lit(code))
    return out


def _record(kind: Column | str, record_id: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit(f"WARC/1.1{_CRLF}WARC-Type: "), kind, F.lit(f"{_CRLF}WARC-Record-ID: "), record_id, F.lit(f"{_CRLF}WARC-Date: {DATE}{_CRLF}")]
    for name, value in fields:
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))).otherwise(F.lit("")))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(_CRLF + _CRLF), block)


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_SHARED_BYTES) -> None:
    """Writes the records of ``pages`` (page_id, url, html) as gzip WARC files under ``path``.

    A null html is an empty payload, a null url an empty target. Rows that share a payload of at least
    ``least_bytes`` with a smaller page_id become revisits with no body. Rows of one page_id and payload
    are of one kind, told apart by their occurrence. Other columns aren't read.
    """
    rows = assign_types(pages, least_bytes)
    own = _uuid(F.lit("capture"), F.col("page_id"), F.col("digest"), F.col("occurrence"))
    revisit = F.coalesce(F.col("first_id") != F.col("page_id"), F.col("page_id").isNull() & F.col("first_id").isNotNull())
    first = _uuid(F.lit("capture"), F.col("first_id"), F.col("digest"), F.lit(1))
    uri = _header(F.col("url"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}{_CRLF}"), F.when(revisit, "").otherwise(F.col("html")))
    capture = _record(
        F.when(revisit, "revisit").otherwise("response"), own,
        [
            ("WARC-Target-URI", uri), ("Content-Type", F.lit("application/http;msgtype=response")), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
            ("WARC-Refers-To", F.when(revisit, first)), ("WARC-Profile", F.when(revisit, PROFILE)),
        ], http,
    )
    request = _record(
        "request", _uuid(F.lit("request"), F.col("page_id"), F.col("digest"), F.col("occurrence")),
        [("WARC-Target-URI", uri), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{_CRLF}{_CRLF}")),
    )
    metadata = _record(
        "metadata", _uuid(F.lit("metadata"), F.col("page_id"), F.col("digest"), F.col("occurrence")),
        [("WARC-Target-URI", uri), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(_CRLF)),
    )
    records = rows.select(F.explode(F.array(request, capture, metadata)).alias("value"))
    records.write.option("lineSep", _CRLF + _CRLF).option("compression", "gzip").text(path)


def _inflate(content: bytes) -> Iterator[bytes]:
    """The decompressed content in pieces of bounded size, whether it is one gzip member or many."""
    left = content
    while left:
        stream = zlib.decompressobj(31)
        while not stream.eof:
            piece = stream.decompress(left, 1 << 20)
            left = stream.unconsumed_tail
            if piece:
                yield piece
            if not piece and not left:
                break
        left = stream.unused_data if stream.eof else b""


def walk(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, along Content-Length."""
    held = bytearray()

    def fill(until) -> bool:
        while not until():
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        while fill(lambda: len(held) > 0) and held[0] in b"\r\n":
            del held[:1]
        if not held:
            return
        if not fill(lambda: b"\r\n\r\n" in held):
            raise ValueError("a record's headers have no end")
        top = held.index(b"\r\n\r\n")
        lines = held[:top].decode("utf-8", "surrogatepass").split("\r\n")
        headers = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines[1:])}
        size = int(headers["content-length"])
        if not fill(lambda: len(held) >= top + 4 + size):
            raise ValueError("a record's block has no end")
        yield headers, bytes(held[top + 4 : top + 4 + size])
        del held[: top + 4 + size]


def read_records(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record of archives given as (content); responses with digest, length and payload."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, weight = [], 0
                for headers, block in walk(_inflate(content)):
                    kind, payload, digest, length, page_id = headers["warc-type"], None, None, None, None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest, length = hashlib.sha256(payload).hexdigest(), len(payload)
                        if headers["warc-payload-digest"] != f"sha256:{digest}":
                            raise ValueError(f"the payload of {headers['warc-record-id']} isn't what its digest says")
                        payload = payload if with_payload else None
                    elif kind == "revisit":
                        digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    elif kind == "metadata":
                        value = block.decode().removeprefix("page-id: ").strip()
                        page_id = int(value) if value else None
                    ids = (headers["warc-record-id"], headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"))
                    rows.append((kind, *ids, page_id, digest, length, payload))
                    weight += len(payload or b"")
                    if weight > BATCH_BYTES or len(rows) >= 5000:
                        yield _frame(rows)
                        rows, weight = [], 0
                yield _frame(rows)

    return files.select("content").mapInPandas(read, _RECORD)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[f.split()[0] for f in _RECORD.split(", ")], dtype=object)
    return out.astype({"page_id": "Int64", "payload_bytes": "Int64"})


def read_captures(path: str, spark: SparkSession, with_payload: bool = True) -> DataFrame:
    """One row per capture of the archives under ``path``: request, capture and metadata as nested columns.

    The three records are joined through the concurrent-to ids. A revisit takes its length from the
    response it refers to; ``refers_to_page`` names that page. Payloads are read and joined last, and
    only if asked for.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    records = materialise(read_records(files, with_payload=False).drop("payload"), "records")
    side = lambda *kinds: records.filter(F.col("kind").isin(*kinds))
    request = side("request").select(F.col("concurrent_to").alias("record_id"), F.struct("record_id", "target_uri").alias("request"))
    metadata = side("metadata").select(F.col("concurrent_to").alias("record_id"), F.struct("record_id", "page_id").alias("metadata"))
    own = ["record_id", "kind", "refers_to", "target_uri", "payload_digest", "payload_bytes"]
    joined = side("response", "revisit").select(*own).join(request, "record_id").join(metadata, "record_id")
    origins = joined.filter("kind = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("metadata.page_id").alias("refers_to_page"), F.col("payload_bytes").alias("first_bytes")
    )
    # only revisits refer to a record, so only they meet the responses
    first = joined.filter("kind = 'response'").withColumn("refers_to_page", F.lit(None).cast(origins.schema["refers_to_page"].dataType))
    again = joined.filter("kind <> 'response'").join(origins, "refers_to", "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "first_bytes"))
    whole = first.unionByName(again.drop("first_bytes"))
    if with_payload:
        payloads = read_records(files).filter("kind = 'response'").select("record_id", "payload")
        whole = whole.join(payloads, "record_id", "left")
        own = [*own, "payload"]
    return whole.select(F.col("metadata.page_id").alias("page_id"), "request", F.struct(*own).alias("capture"), "metadata", "refers_to_page")


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), read back from archives of ``pages``."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_archives(pages, path)
    return read_captures(path, spark, with_payload=False).select(
        "page_id",
        F.col("capture.payload_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.kind").alias("record_type"),
        F.col("refers_to_page").alias("refers_to"),
    )
