"""Conversion of legacy ARC archives to WARC, with revisit records for repeated payloads.

An ARC file starts with a version block that says which fields the header line of a record has
(version 1: five, version 2: ten); each record is that line and as many bytes as it declares. The
converter parses files of either version, and files in which version blocks follow each other, and
makes WARC 1.0 records: identifiers derived from the record and its place in its archive (so that
they are unique, and a repeated run over the same files gives the same), dates from the 14-digit ones,
the type, and SHA-1 digests in base 32.

Of records with equal payloads of at least ``LEAST_REVISIT`` bytes the one with the largest page id
stays a response; the others become revisits that name it. Records are gathered into archives of
``FILE_SIZE`` characters (a longer record is an archive of its own), one row each, and Spark's text writer puts
each row into a file of its own, compressed as a whole, with the record's end as line separator. They
are read as whole files, one record after the other by declared lengths, so a task holds one archive
at a time.

Defined cases: a null payload is empty; a null url becomes "-" and blanks in urls are escaped, as is
the colon of a url that begins like a version block; equal rows are records of their own, and all that
have the largest page id are responses; a record without page id can only be a response if no other
has one; an empty table makes archives without records; other columns are not read.
"""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, table

LEAST_REVISIT = 1000
#: Characters of records in one archive, before compression.
FILE_SIZE = 16 << 20
#: Hadoop's name of the compression level; archives are a little larger and written in half the time.
ZLIB_LEVEL = "THREE"
#: Capture time of records whose source has none.
DATE = "19970101000000"
# Fixed texts of the two formats.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ARC_RECORD = T.StructType([
    T.StructField("version", T.IntegerType()),
    T.StructField("archive", T.StringType()),
    T.StructField("offset", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("ip", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("page_id", T.LongType()),
    T.StructField("head", T.BinaryType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("sha1", T.StringType()),
    T.StructField("digest", T.StringType()),
])
WARC_RECORD = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("record_id", T.StringType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()),
    T.StructField("refers_to", T.LongType()),
    T.StructField("payload", T.BinaryType()),
])


def _packed(rows: DataFrame, end: str, name: str, begin: Callable[[int, int], str], entry: Callable[[dict, int, int], str]) -> str:
    """Write archives and give their folder: ``entry`` makes a record of a row, ``begin`` what an archive starts with; both know the numbers of partition and archive."""
    import pyarrow as pa

    names = rows.columns

    def run(batches):
        some, size, part, file = [], 0, 0, 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([end.join(some)])], names=["value"])
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i].as_py() for k, c in enumerate(names)}
                part = row["part"]
                text = entry(row, part, file)
                if some and size + len(text) > FILE_SIZE:
                    yield flush()
                    some, size, file = [], 0, file + 1
                    text = entry(row, part, file)
                if not some:
                    some.append(begin(part, file))
                some.append(text)
                size += len(text)
        if some:
            yield flush()

    path = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    options = {"lineSep": end, "compression": "gzip", "zlib.compress.level": ZLIB_LEVEL, "maxRecordsPerFile": 1}
    rows.mapInArrow(run, "value string").write.options(**options).text(path)
    return path


def _files(spark: SparkSession, path: str, parse, schema: T.StructType) -> DataFrame:
    """Records of the files under ``path``; ``parse`` yields dictionaries from the bytes of one."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for row in parse(gzip.decompress(batch.column(0)[i].as_py())):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if size > 8 << 20 or len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, schema)


def write_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> str:
    """Archives of the pages as HTTP responses; files of versions 1 and 2 in turn. Gives their folder."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    page = F.when(F.col(id_col).isNotNull(), F.concat(F.lit("X-Page-Id: "), F.col(id_col).cast("string"), F.lit("\r\n"))).otherwise(F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"), page, F.lit("Content-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    url = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url_col), F.lit("-")), r"\s", "%20"), r"(?i)^(filedesc):", "$1%3A")
    rows = pages.select(F.when(url == "", "-").otherwise(url).alias("url"), F.concat(head, payload).alias("block"), F.octet_length(F.concat(head, payload)).alias("length"), F.spark_partition_id().alias("part"))
    archive = lambda part, file: f"pages-{part}-{file}.arc"
    version = lambda part, file: 1 + (part + file) % 2

    def begin(part: int, file: int) -> str:
        v, name = version(part, file), archive(part, file)
        block = f"{v} 0 ledgerloom\n{ARC_FIELDS[v]}\n"
        return f"filedesc://{name} 0.0.0.0 {DATE} text/plain " + ("" if v == 1 else f"200 - - 0 {name} ") + f"{len(block)}\n{block}"

    def entry(row: dict, part: int, file: int) -> str:
        more = "" if version(part, file) == 1 else f"200 - - 0 {archive(part, file)} "
        return f"{row['url']} 0.0.0.0 {DATE} text/html {more}{row['length']}\n{row['block']}"

    return _packed(rows, "\n", "arc", begin, entry)


def _version_block(line: str, block: bytes) -> tuple[str, int, list[str]] | None:
    """The archive's name, version and field names, if this is a version block."""
    head = block.decode("utf-8", "replace").split("\n")
    if line.startswith("filedesc://") and len(head) > 1 and re.match(r"[12] \d+ ", head[0]) and head[1].startswith("URL "):
        return line[len("filedesc://") :].split(" ")[0], int(head[0][0]), head[1].split(" ")
    return None


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of one ARC file."""
    import base64
    import hashlib

    at, fields, version, archive = 0, [], 0, ""
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        offset, at = at, (end if end >= 0 else len(data)) + 1
        if not line.strip():
            continue
        parts = line.split(" ")
        size = int(parts[-1])
        block = data[at : at + size]
        if len(block) < size:
            raise ValueError(f"a record declares {size} bytes where {len(block)} are left")
        at += size
        if first := _version_block(line, block):
            archive, version, fields = first
            continue
        if len(parts) != len(fields):
            raise ValueError(f"a header line has {len(parts)} fields, version {version} has {len(fields)}")
        own = dict(zip(fields, parts, strict=True))
        cut = block.find(b"\r\n\r\n")
        head, payload = (block[: cut + 4], block[cut + 4 :]) if block.startswith(b"HTTP/") and cut >= 0 else (b"", block)
        page = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
        sha1 = hashlib.sha1(payload)
        yield {
            "version": version, "archive": archive, "offset": offset, "url": own["URL"], "ip": own["IP-address"], "date": own["Archive-date"], "content_type": own["Content-type"], "page_id": int(page[1]) if page else None,
            "head": head, "payload": payload, "sha1": sha1.hexdigest(), "digest": base64.b32encode(sha1.digest()).decode(),
        }


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, parse_arc, ARC_RECORD)


def _record_id() -> Column:
    h = F.sha1(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "sha1", "archive", F.col("offset").cast("string")).cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def convert(records: DataFrame) -> DataFrame:
    """WARC records of ARC records: record_id, record_type, refers_to and the record's bytes as ``value``."""
    records = records.withColumn("record_id", _record_id())
    long = records.where((F.length("payload") >= LEAST_REVISIT) & F.col("page_id").isNotNull())
    keeper = long.groupBy("sha1").agg(F.max(F.struct("page_id", "record_id")).alias("kept")).select("sha1", F.col("kept.page_id").alias("keeper"), F.col("kept.record_id").alias("keeper_id"))
    typed = records.join(keeper, "sha1", "left")
    is_revisit = F.col("keeper").isNotNull() & (F.length("payload") >= LEAST_REVISIT) & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    typed = typed.withColumn("record_type", F.when(is_revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(is_revisit, F.col("keeper")))
    block = F.when(is_revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    d = F.col("date")
    date = F.concat(F.substring(d, 1, 4), F.lit("-"), F.substring(d, 5, 2), F.lit("-"), F.substring(d, 7, 2), F.lit("T"), F.substring(d, 9, 2), F.lit(":"), F.substring(d, 11, 2), F.lit(":"), F.substring(d, 13, 2), F.lit("Z"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    refers = F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.col("keeper_id")), line("X-Refers-To-Page", F.col("keeper").cast("string")))
    head = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", date),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(is_revisit, refers).otherwise(F.lit("")),
        F.when(F.length("head") > 0, F.lit("Content-Type: application/http; msgtype=response\r\n")).otherwise(line("Content-Type", F.col("content_type"))),
        line("Content-Length", F.length(block).cast("string")),
        F.lit("\r\n"),
    )
    return typed.select("record_type", "refers_to", F.concat(head.cast("binary"), block).cast("string").alias("value"))


def write_warc(records: DataFrame) -> str:
    """WARC files of converted records, each with a warcinfo record first. Gives their folder."""
    body = "software: ledgerloom\r\nformat: WARC File Format 1.0\r\n"
    info = lambda part, file: f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{part}-{file}: {body}')}>\r\nWARC-Date: 1997-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n{body}"
    rows = records.select("value", F.spark_partition_id().alias("part"))
    return _packed(rows, "\r\n\r\n", "warc", info, lambda row, part, file: row["value"])


def parse_warc(data: bytes) -> Iterator[dict]:
    """Response and revisit records of one WARC file; a payload that doesn't match its digest is an error."""
    import base64
    import hashlib

    at = 0
    while at < len(data):
        cut = data.find(b"\r\n\r\n", at)
        lines = data[at:cut].decode("utf-8", "replace").split("\r\n")
        if cut < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        own = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        size = int(own["content-length"])
        block = data[cut + 4 : cut + 4 + size]
        if len(block) < size or data[cut + 4 + size : cut + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where it says")
        at = cut + 8 + size
        kind = own["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        http = block.find(b"\r\n\r\n") if own["content-type"].startswith("application/http") else -1
        head, payload = (block[: http + 4], block[http + 4 :]) if http >= 0 else (b"", block)
        digest = base64.b32decode(own["warc-payload-digest"].removeprefix("sha1:")).hex()
        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{own['warc-record-id']}: the payload doesn't match its digest")
        page = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
        length = len(payload) if kind == "response" else int(re.search(rb"\r\nContent-Length: (\d+)\r\n", head)[1])
        yield {
            "page_id": int(page[1]) if page else None, "record_id": own["warc-record-id"], "record_type": kind, "url": own["warc-target-uri"], "date": own["warc-date"], "payload_bytes": length,
            "payload_digest": digest, "refers_to": int(own["x-refers-to-page"]) if "x-refers-to-page" in own else None, "payload": payload if kind == "response" else None,
        }


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, parse_warc, WARC_RECORD)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    legacy = write_arc(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    archives = write_warc(convert(read_arc(spark, legacy)))
    return read_warc(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
k as (select payload_digest, max(page_id) as keeper from p where payload_bytes >= 1000 group by payload_digest having count(*) > 1)
select page_id, payload_bytes, p.payload_digest, case when keeper is not null and keeper <> page_id then 'revisit' else 'response' end as record_type,
  case when keeper <> page_id then keeper end as refers_to
from p left join k on k.payload_digest = p.payload_digest
"""
