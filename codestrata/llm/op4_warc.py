"""WARC archives: a Spark writer with revisit records, and a PySpark Python data source that reads them.

Writing: a record per page. Among pages with equal payloads of at least ``SMALLEST_REVISIT`` bytes the largest id is a
``response``; the others are ``revisit`` records without a payload that name it. Payloads are compared by SHA-1 on
narrow rows; html meets its verdict by page id, never by digest, so a payload shared by thousands skews nothing. Files
come from Spark's text writer, whose row separator is the record separator, so its commit protocol covers lost tasks.

Reading (format ``warc``): files are packed into partitions by size; predicates on record type, target uri, record id
and digest are pushed down; a record's header is parsed first, and the payload of a record that fails a predicate, or
of any record when ``payload`` is off, is skipped (by seeking in plain files) and never built.

Nulls and edge cases: a null html is an empty payload; a null url leaves its header out; a row with a null id is a
response of its own and never named by others. Rows repeated in full share their verdict. Payloads may be empty or hold
the separator or WARC headers (lengths decide, not contents). Extra columns are ignored. An empty table gives no rows."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from codestrata.llm.common import partitions, scratch, table

SMALLEST_REVISIT = 1000
PARTITION_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
ID = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = ("record_type string, record_id string, target_uri string, payload_digest string, payload_length long,"
          " refers_to string, payload binary")
# Column of the schema -> the header it is read from.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri",
           "payload_digest": "warc-payload-digest", "payload_length": "x-payload-length", "refers_to": "warc-refers-to"}
PUSHED = {"record_type", "record_id", "target_uri", "payload_digest", "refers_to"}


def plan_records(pages: DataFrame, smallest: int = SMALLEST_REVISIT) -> DataFrame:
    """(page_id, url, html, digest, length, refers_to): what each record will say; refers_to is null for responses."""
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    narrow = pages.select("page_id", F.sha1(raw).alias("digest"), F.octet_length(raw).alias("length")).where(
        (F.col("length") >= smallest) & F.col("page_id").isNotNull())
    # how many ids a payload has: only shared payloads go on
    shared = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("_least")).where("_least < refers_to")
    revisits = narrow.join(shared, "digest").where("page_id < refers_to").select(
        F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to").distinct()
    whole = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"), F.sha1(raw).alias("digest"),
                         F.octet_length(raw).cast("long").alias("length"))
    return whole.join(revisits, (F.col("page_id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").drop("_id", "_digest")


def write_warc(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """Writes one archive file per partition."""
    plan = plan_records(pages)
    revisit = F.col("refers_to").isNotNull()

    def line(name: str, value) -> Column:
        # a null value leaves the line out; line breaks inside a value would end it
        return F.coalesce(F.concat(F.lit(name + ": "), F.regexp_replace(value, "[\\r\\n]+", "%0A"), F.lit("\r\n")), F.lit(""))

    def urn(page) -> Column:
        return F.concat(F.lit(f"<{ID}"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))

    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("length").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("length").cast("string"))), F.lit("\r\n"))
    record = F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    plan.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def _filesystem(path: str):
    """A file system PyArrow can open and the path inside it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def read_header(stream) -> dict[str, str] | None:
    """The next record's header fields, lower-cased names; None at the end."""
    first = stream.readline()
    while first in (b"\r\n", b"\n"):
        first = stream.readline()
    if not first:
        return None
    if not first.startswith(b"WARC/"):
        raise ValueError(f"no WARC record where one should begin: {first[:60]!r}")
    fields = {}
    while (raw := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = raw.decode("utf-8").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def _value(column: str, fields: dict[str, str]):
    raw = fields.get(HEADERS[column])
    if raw is None:
        return None
    if column in ("record_id", "refers_to"):
        return raw.strip("<>")
    if column == "payload_digest":
        return raw.partition(":")[2]
    return int(raw) if column == "payload_length" else raw


def records(stream, seekable: bool, wanted: list[tuple[str, frozenset | None]], payload: bool) -> Iterator[tuple]:
    """Records of one archive as tuples of the schema; headers decide (values, or None for any) before payloads are touched."""

    def fits(value, values: frozenset | None) -> bool:
        return value is not None if values is None else value in values

    while (fields := read_header(stream)) is not None:
        length = int(fields.get("content-length", 0))
        keep = all(fits(_value(column, fields), values) for column, values in wanted)
        if keep and payload:
            body = stream.read(length)
            if len(body) != length:
                raise ValueError(f"record {fields.get('warc-record-id')} ends early")
        else:
            body = None
            if seekable:
                stream.seek(length, 1)
            else:
                left = length
                while left:
                    left -= len(stream.read(min(left, 1 << 20))) or left
        if keep:
            yield (*[_value(c, fields) for c in HEADERS], body)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.wanted: list[tuple[str, frozenset | None]] = []

    def pushFilters(self, filters: list[Filter]):
        """Equality, IN and not-null on header columns are ours; the rest goes back to Spark."""
        for f in filters:
            column = ".".join(f.attribute) if isinstance(f, EqualTo | In | IsNotNull) else None
            if column in PUSHED:
                self.wanted.append((column, None if isinstance(f, IsNotNull) else frozenset([f.value] if isinstance(f, EqualTo) else f.value)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _filesystem(self.path)
        files = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True))
                 if f.is_file and not f.base_name.startswith(("_", "."))]
        packed, current, size = [], [], 0
        for f in sorted(files, key=lambda f: f.path):
            if current and size + f.size > self.bytes:
                packed.append(_Files(current))
                current, size = [], 0
            current.append(f.path)
            size += f.size
        return [*packed, _Files(current)]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(self.path)
        types = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
        names = [*HEADERS, "payload"]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for path in partition.paths:
            with system.open_input_file(path) as raw:
                packed = path.endswith(".gz")
                stream, rows, size = gzip.GzipFile(fileobj=raw) if packed else io.BufferedReader(raw, 1 << 20), [], 0
                for row in records(stream, not packed, self.wanted, self.payload):
                    rows.append(row)
                    size += 200 + len(row[-1] or b"")
                    if size >= 8 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)``; options payload (true), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as its record says after a round trip; a response's size and digest are taken from the payload read."""
    path = scratch(spark, "warc")
    write_warc(table(spark, folder, "pages"), path)
    got = read_warc(spark, path)
    response = F.col("record_type") == "response"

    def page(urn: str) -> Column:
        return F.expr(f"try_cast(substr({urn}, {len(ID) + 1}) as long)")

    return got.select(
        page("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS d, coalesce(html, '') AS h FROM pages),
 g AS (SELECT page_id, n, d, CASE WHEN n >= 1000 AND page_id IS NOT NULL THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS top FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN page_id < top THEN top END AS refers_to FROM g
"""
