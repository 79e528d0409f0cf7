"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is three records: a request and a metadata record that name their response through
WARC-Concurrent-To, and a response with the payload or a revisit that refers to an earlier response with
an equal payload. Archives are written by Spark's text sink with gzip (a record ends with CR LF CR LF, its
line separator), so any store that Spark can write will do, and are read back from whole files of bounded
size by the records' own lengths; blocks may hold anything, separators and headers included.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.common import stored
from keyloom.llm.text import task

#: Payloads of fewer bytes are always kept.
REVISIT_BYTES = 1000
#: Bytes of consecutive records that are written as one piece, unless a single record is longer, and pieces
#: of a file at most: files are read whole, so their size has to have a bound that is no number of records.
PIECE, FILE_PIECES = 4 << 20, 16
#: Bytes that are decompressed at once.
INFLATE = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _uuid(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(f"{kind}:"), key).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1\r\n")]
    for name, value in headers:
        lines.append(F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))))
    size = F.octet_length(block).cast("string")
    return F.concat(*lines, F.lit("Content-Length: "), size, F.lit("\r\n\r\n"), block)


def captures(pages: DataFrame) -> DataFrame:
    """Per row of pages: key, page_id, url, payload, digest, and refers_key of a revisit.

    Of rows with equal payloads of REVISIT_BYTES or more, that of the largest page_id is the response.
    key tells repeated rows apart: it numbers equal (page_id, payload)."""
    known = F.coalesce(F.col("page_id").cast("long").cast("string"), F.lit("null"))
    base = pages.select(
        known.alias("pid"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("payload")
    )
    small = base.select(
        "pid", "page_id", F.sha1(F.col("payload").cast("binary")).alias("digest"), F.octet_length("payload").alias("size")
    )
    # Numbering and the join below deal pages by the same key, so payloads are shuffled once.
    numbered = F.row_number().over(Window.partitionBy("pid", "digest").orderBy(F.col("url").asc_nulls_first()))
    key = F.concat_ws("|", "pid", "digest", F.col("copy").cast("string"))
    first = small.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(F.max("page_id").alias("response_page"))
    marked = small.select("pid", "digest", "size").distinct().join(first, ["digest", "size"], "left")
    keyed = base.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("copy", numbered).withColumn("key", key)
    out = keyed.join(marked.select("pid", "digest", "response_page"), ["pid", "digest"], "left")
    own = F.col("response_page").isNull() | (F.col("response_page").eqNullSafe(F.col("page_id")) & (F.col("copy") == 1))
    refers = F.concat_ws("|", F.col("response_page").cast("string"), "digest", F.lit("1"))
    return out.select("key", "page_id", "url", "payload", "digest", F.when(~own, refers).alias("refers_key"))


def write(rows: DataFrame, path: str) -> None:
    """Write captures to archives at path."""
    clean = F.regexp_replace(F.col("url"), "[\\x00-\\x20\\x7F]", "_")
    uri = F.coalesce(clean, F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    response, request, metadata = (_uuid(kind, F.col("key")) for kind in ("response", "request", "metadata"))
    revisit = F.col("refers_key").isNotNull()
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit("\r\n\r\n"),
    )
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    common = lambda kind, rid: [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri)]
    captured = _record(
        [
            *common(F.when(revisit, "revisit").otherwise("response"), response),
            ("WARC-Payload-Digest", digest),
            ("WARC-Refers-To", F.when(revisit, _uuid("response", F.col("refers_key")))),
            ("WARC-Profile", F.when(revisit, PROFILE)),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.concat(head, F.when(revisit, "").otherwise(F.col("payload"))),
    )
    asked = _record(
        [*common(F.lit("request"), request), ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\n\r\n")),
    )
    fields = F.concat(
        F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\nurl: "), F.coalesce(clean, F.lit("")), F.lit("\r\n")
    )
    noted = _record(
        [*common(F.lit("metadata"), metadata), ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/warc-fields"))], fields
    )
    records = rows.select(F.explode(F.array(asked, captured, noted)).alias("value")).mapInArrow(_pieces, "value string")
    records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_PIECES).option("compression", "gzip").text(path)


@task
def _pieces(batches):
    """Records joined to pieces of about PIECE bytes."""
    held, size = [], 0
    for batch in batches:
        for record in batch.column("value").cast(pa.large_binary()).to_pylist():
            held.append(record)
            size += len(record)
            if size >= PIECE:
                yield pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(held)]).cast(pa.string())], ["value"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(held)]).cast(pa.string())], ["value"])


_SCHEMA = (
    "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, "
    "http_length long, page_id long, payload binary, headers string"
)


class _Inflated:
    """The bytes of a gzip file, decompressed as they are asked for."""

    def __init__(self, packed: memoryview):
        self.packed, self.at, self.data, self.begin = packed, 0, bytearray(), 0
        self.inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.begin > 4 * INFLATE:
            del self.data[: self.begin]
            self.begin = 0
        while True:
            if self.inflate.eof and (rest := len(self.inflate.unused_data)) + len(self.packed) - self.at:
                self.at -= rest  # another member follows
                self.inflate = zlib.decompressobj(31)
            tail = self.inflate.unconsumed_tail
            if not tail:
                tail = self.packed[self.at : self.at + INFLATE]
                self.at += len(tail)
            if not tail:
                return False
            got = self.inflate.decompress(tail, 4 * INFLATE)
            if got:
                self.data += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the next mark, which is passed over; None at the end."""
        seen = self.begin
        while (end := self.data.find(mark, seen)) < 0:
            seen = max(self.begin, len(self.data) - len(mark) + 1)
            before = self.begin
            if not self._more():
                if len(self.data) > self.begin:
                    raise ValueError("a record without an end")
                return None
            seen -= before - self.begin
        out = bytes(self.data[self.begin : end])
        self.begin = end + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.data) - self.begin < n:
            if not self._more():
                raise ValueError("a record ends early")
        out = bytes(self.data[self.begin : self.begin + n])
        self.begin += n
        return out


@task
def _parse(batches):
    names = [f.split()[0] for f in _SCHEMA.split(", ")]
    for batch in batches:
        for content in batch.column("content"):
            rows: dict[str, list] = {n: [] for n in names}
            data, size = _Inflated(memoryview(content.as_buffer())), 0
            while (head := data.until(b"\r\n\r\n")) is not None:
                lines = head.decode().split("\r\n")
                if lines[0] != "WARC/1.1":
                    raise ValueError(f"no record but {lines[0][:40]!r}")
                h = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
                block = data.take(int(h["content-length"]))
                if data.take(4) != b"\r\n\r\n":
                    raise ValueError(f"record {h.get('warc-record-id')} ends wrongly")
                kind, payload, length, page = h["warc-type"], None, None, None
                if kind in ("response", "revisit"):
                    top, _, payload = block.partition(b"\r\n\r\n")
                    length = int(top.lower().split(b"content-length:")[1].split(b"\r\n")[0])
                elif kind == "metadata":
                    value = block.split(b"\r\n")[0].split(b": ", 1)[1]
                    page = int(value) if value else None
                row = (kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h["warc-target-uri"],
                       h.get("warc-payload-digest"), length, page, payload, "\r\n".join(lines))
                for n, v in zip(names, row):
                    rows[n].append(v)
                size += len(block)
                if size > 4 << 20:
                    yield _batch(rows)
                    rows, size = {n: [] for n in names}, 0
            yield _batch(rows)


def _batch(rows: dict[str, list]) -> pa.RecordBatch:
    kinds = {"http_length": pa.int64(), "page_id": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.string())) for k, v in rows.items()], list(rows))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives at path; a damaged one is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path)
    return files.select("content").mapInArrow(_parse, _SCHEMA)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, response (or revisit) and metadata joined through
    WARC-Concurrent-To; a response without the others still makes a row, and of several requests or
    metadata records that of the least id counts. refers_to is the page whose response a revisit names.

    Archives are parsed twice: once for what has no payload, kept as a table of small rows, and once for
    the payloads, which are shuffled once, by record id. Revisits of one response meet its page in that
    small table, so a response that many name moves no payload."""
    small = stored(records.select("record_type", "record_id", "concurrent_to", "refers_to", "page_id", "headers"))
    pick = lambda kind, fields: small.where(F.col("record_type") == kind).groupBy(F.col("concurrent_to").alias("record_id")).agg(
        F.min(F.struct(*fields)).alias(kind)
    )
    pages = small.where("record_type = 'metadata'").groupBy(F.col("concurrent_to").alias("refers_to")).agg(F.min("page_id").alias("refers_page"))
    named = small.where("refers_to is not null").select("record_id", "refers_to")
    refers = named.join(pages, "refers_to").select("record_id", "refers_page")
    joined = records.where("record_type in ('response', 'revisit')").drop("page_id", "concurrent_to", "refers_to")
    for part in (pick("request", ["record_id", "headers"]), pick("metadata", ["record_id", "page_id", "headers"]), refers):
        joined = joined.join(part, "record_id", "left")
    response = F.struct("record_id", "record_type", "target_uri", "payload_digest", "http_length", "payload", "headers")
    return joined.select(F.col("metadata.page_id").alias("page_id"), "request", response.alias("response"), "metadata", F.col("refers_page").alias("refers_to"))


def archive(pages: DataFrame, path: str) -> DataFrame:
    """Write pages as captures to path, read the archives back, and assemble them: one row per page.

    Null html is an empty payload; a null url gets a URN; controls and blanks in a url become "_"; null
    page_ids stay null, and equal payloads of which no page_id is known are all responses; repeated rows are
    captures of their own, the first being the response. Other columns are not read; an empty table gives
    no rows."""
    write(captures(pages), path)
    return transactions(read(pages.sparkSession, path))
