"""WARC archives as a chunked record table.

A payload is never one value on the way to or from the archive: it is rows of (record, chunk number,
piece), and a record longer than one chunk is a segmented WARC record: the first segment, then
``continuation`` records that name it. Each archive is a text table whose row separator is the
two line ends that close a WARC record, so Spark's own writer makes it and tasks write in parallel.
Readers take an archive record by record and carry a running SHA-1 from chunk to chunk.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curul.llm.common import Scratch, query, table

END = "\r\n"
CHUNK = 1 << 18
ARCHIVE_BYTES = 16 << 20

# Fixed: the digits of base 32 as Spark writes them and as RFC 4648 does.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """Base 32 of a 40-digit hexadecimal SHA-1: four groups of 40 bits, eight digits each."""
    groups = [F.lpad(F.upper(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32)), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), DIGITS, BASE32)


def records(pages: DataFrame) -> DataFrame:
    """One row per page: identity, size, digest and whether the record is a response or a revisit.

    Among records with equal payloads the smallest page_id is the response. Copies are counted per
    digest before the shuffle, so a payload that a third of the pages share is one row by then.
    Defined cases: null html is an empty payload; a null page_id never becomes the target of a
    revisit unless all of its group are null, and then every one is a response; rows that repeat a
    page_id and a payload are all responses, each with a record identity of its own.
    """
    rows = pages.select(
        F.col("page_id"),
        F.col("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("payload"),
        # Stable while a source file is read in the same pieces; only tells repeated rows apart.
        F.monotonically_increasing_id().alias("row"),
    ).withColumns({"bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1(F.encode("payload", "UTF-8"))})
    return rows


def with_roles(rows: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds ``target``: the page_id of the response for each record that may be a revisit.

    Only (page_id, digest) pairs are shuffled to find it, and only digests that occur twice come back.
    """
    shared = (
        rows.where(F.col("bytes") >= least_bytes)
        .groupBy("sha1", "bytes")
        .agg(F.min("page_id").alias("target"), F.count("*").alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    return rows.join(shared, ["sha1", "bytes"], "left")


def _header(kind: Column, *fields: tuple[str, Column]) -> Column:
    lines = [F.lit("WARC/1.0"), F.concat(F.lit("WARC-Type: "), kind)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]  # a null value leaves its line out
    return F.concat(F.concat_ws(END, *lines), F.lit(END + END))


def lines(rows: DataFrame, chunk: int = CHUNK, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The archive's records as text rows, a payload's chunks as segments.

    A chunk holds ``chunk`` characters. Record fields that hold line ends lose them (a url could).
    """
    pieces = F.greatest(F.lit(1), F.ceil(F.length("payload") / F.lit(chunk))).cast("int")
    revisit = F.col("target").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("target"))
    parts = rows.withColumn("revisit", revisit).select(
        "*", F.explode(F.when(F.col("revisit"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), pieces - 1))).alias("part"), pieces.alias("parts")
    )
    body = F.when(F.col("revisit"), F.lit("")).otherwise(F.substring("payload", F.col("part") * chunk + 1, F.lit(chunk)))
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"), F.col("row").cast("string"), F.lit(">"))
    first, many = F.col("part") == 0, (F.col("parts") > 1) & ~F.col("revisit")
    digest = F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))
    kind = F.when(~first, "continuation").when(F.col("revisit"), "revisit").otherwise("response")
    head = _header(
        kind,
        ("WARC-Record-ID", F.when(first, name).otherwise(F.concat(F.substring_index(name, ">", 1), F.lit(":"), F.col("part").cast("string"), F.lit(">")))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.when(first, F.regexp_replace("url", "[\r\n]+", " "))),
        ("WARC-Payload-Digest", F.when(first, digest)),
        ("WARC-Refers-To", F.when(first & F.col("revisit"), F.concat(F.lit("<urn:page:"), F.col("target").cast("string"), F.lit(">")))),
        ("WARC-Profile", F.when(first & F.col("revisit"), F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        ("WARC-Segment-Number", F.when(many, (F.col("part") + 1).cast("string"))),
        ("WARC-Segment-Origin-ID", F.when(~first, name)),
        ("WARC-Segment-Total-Length", F.when(many & (F.col("part") == F.col("parts") - 1), F.col("bytes").cast("string"))),
        ("X-Payload-Length", F.when(F.col("revisit"), F.col("bytes").cast("string"))),
        ("Content-Length", F.octet_length(F.col("body")).cast("string")),
    )
    return parts.withColumn("body", body).select(F.concat(head, F.col("body")).alias("value"))


def write(rows: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Gzip-compressed archives of about ``archive_bytes`` of records each, as many per task as it has records for.

    Records are written where the join for their roles left them: payloads are shuffled once.
    """
    sizes = rows.agg(F.sum(F.col("bytes") + 500), F.count("*")).first()
    each = max(1, (sizes[0] or 0) // max(1, sizes[1]))
    out = lines(rows).write.option("lineSep", END + END).option("compression", "gzip")
    out.option("maxRecordsPerFile", max(1, archive_bytes // each)).text(path)


CHUNK_TYPE = pa.schema(
    [("record", pa.string()), ("part", pa.int32()), ("kind", pa.string()), ("digest", pa.string()), ("refers", pa.string()), ("total", pa.int64()), ("many", pa.bool_()), ("body", pa.binary())]
)
CHUNK_DDL = "record string, part int, kind string, digest string, refers string, total long, many boolean, body binary"


def parse(archive: bytes) -> Iterator[tuple]:
    """(record, part, kind, digest, refers, total, many, body) of each record, by its Content-Length."""
    view, at = memoryview(archive), 0
    while at < len(archive):
        stop = archive.index(b"\r\n\r\n", at)
        version, *fields = archive[at:stop].decode("utf-8").split(END)
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v for k, _, v in (f.partition(": ") for f in fields)}
        begin, size = stop + 4, int(head["content-length"])
        body = view[begin : begin + size]
        if len(body) != size or archive[begin + size : begin + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        at = begin + size + 4
        segment = int(head.get("warc-segment-number", "1"))
        total = head.get("warc-segment-total-length") or head.get("x-payload-length")
        yield (
            head.get("warc-segment-origin-id") or head["warc-record-id"], segment - 1, head["warc-type"], head.get("warc-payload-digest"),
            head.get("warc-refers-to"), int(total) if total else None, "warc-segment-number" in head, body,
        )


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """The record table of the archives below ``path``: one row per record segment."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows, size = [], 0
                for row in parse(gzip.decompress(archive.as_py())):
                    rows.append(row)
                    size += len(row[-1])
                    if size > 4 << 20 or len(rows) >= 5000:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, CHUNK_DDL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows, strict=True)]
    columns[-1] = [bytes(b) for b in columns[-1]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CHUNK_TYPE, strict=True)], schema=CHUNK_TYPE)


def _base32(digest) -> str:
    return base64.b32encode(digest).decode()


PAYLOAD_TYPE = pa.schema([("record", pa.string()), ("kind", pa.string()), ("named", pa.string()), ("refers", pa.string()), ("bytes", pa.int64()), ("digest", pa.string())])
PAYLOAD_DDL = "record string, kind string, named string, refers string, bytes long, digest string"


def payloads(table_of_chunks: DataFrame) -> DataFrame:
    """One row per record: its length and the SHA-1 that its chunks add up to.

    Records of one segment are digested where they are. Segmented ones are shuffled by record and
    come in order of their chunk number; the state kept is one running digest, never a payload.
    Revisits have no payload of their own and give the digest and length in their header.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for record, kind, named, refers, total, body in zip(*(batch.column(n).to_pylist() for n in ("record", "kind", "digest", "refers", "total", "body")), strict=True):
                named = named.removeprefix("sha1:")
                if kind == "revisit":
                    out.append((record, kind, named, refers, total, named))
                else:
                    out.append((record, kind, named, refers, len(body), _base32(hashlib.sha1(body).digest())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), PAYLOAD_TYPE, strict=True)], schema=PAYLOAD_TYPE)

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None  # record, next part, named digest, length so far, running digest, announced length

        def closed() -> pa.RecordBatch:
            if now[5] != now[3]:
                raise ValueError(f"{now[0]}: {now[3]} bytes of {now[5]}")
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip((now[0], "response", now[2], None, now[3], _base32(now[4].digest())), PAYLOAD_TYPE, strict=True)], schema=PAYLOAD_TYPE
            )

        for batch in batches:
            for record, part, named, total, body in zip(*(batch.column(n) for n in ("record", "part", "digest", "total", "body")), strict=True):
                if now is None or now[0] != record.as_py():
                    if now is not None:
                        yield closed()
                    now = [record.as_py(), 0, named.as_py().removeprefix("sha1:"), 0, hashlib.sha1(), None]
                if part.as_py() != now[1]:
                    raise ValueError(f"{now[0]}: segment {now[1] + 1} is missing")
                piece = body.as_buffer()
                now[4].update(piece)
                now[1], now[3], now[5] = now[1] + 1, now[3] + piece.size, total.as_py() if total.is_valid else now[5]
        if now is not None:
            yield closed()

    single = table_of_chunks.where("not many").mapInArrow(whole, PAYLOAD_DDL)
    long = table_of_chunks.where("many").repartition("record").sortWithinPartitions("record", "part").mapInArrow(running, PAYLOAD_DDL)
    return single.union(long)


def page_of(name: Column) -> Column:
    return F.regexp_extract(name, "^<urn:page:(-?[0-9]+)[:>]", 1).try_cast("long")


def archived(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write every page as WARC records, read the archives back and report what they hold.

    The digest reported is the one computed from the bytes read; a record whose bytes do not give
    the digest in its header is an error. The archives stay until the report is complete.
    """
    scratch = Scratch(spark)
    write(with_roles(records(pages), least_bytes), f"{scratch.root}/archives")
    found = payloads(chunks(spark, f"{scratch.root}/archives"))
    report = scratch.kept(
        found.select(
            page_of(F.col("record")).alias("page_id"),
            F.col("bytes").alias("payload_bytes"),
            F.when(F.col("named") == F.col("digest"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("damaged: "), "record"))).alias("payload_digest"),
            F.col("kind").alias("record_type"),
            page_of(F.col("refers")).alias("refers_to"),
        )
    )
    scratch.drop()
    return report


def _sql_base32(digest: str) -> str:
    groups = " || ".join(f"to_base(('0x' || substr({digest}, {1 + 10 * i}, 10))::BIGINT, 32, 8)" for i in range(4))
    return f"translate({groups}, '{DIGITS}', '{BASE32}')"


@query(
    f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
     r AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS target FROM p)
SELECT page_id, payload_bytes, {_sql_base32("h")} AS payload_digest,
       CASE WHEN page_id = target THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = target THEN NULL ELSE target END AS refers_to
FROM r"""
)
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    """WARC archives of all pages, written and read back."""
    return archived(spark, table(spark, folder, "pages"))
