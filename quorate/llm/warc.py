"""WARC archives (operator 1): write, normalise, index, read back.

``write_monolithic`` writes one record per page with Spark's own text writer, so that each file is a single whole-file gzip stream.
``normalise`` inflates each such stream once, front to back, rewrites every record as a gzip member of its own and writes a sidecar
index of offsets next to the archive.  ``read_archives`` seeks by that index.

Records of equal payload: the one with the smallest page_id is a response, the others are revisits without payload that name it.

Defined cases: a null html is an empty payload; a null url is written as about:blank; rows with a null page_id are written and read
back, but never named by a revisit unless all their group's ids are null (then all are responses); repeated rows of one page_id that
is its payload's smallest are each a response; an empty table gives an empty result; payloads may be of
any length, each being one record in memory; ties of page_id are repeated rows; other columns, whatever their names, take no part.
"""
from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, scratch_path, spread_join

CRLF2 = b"\r\n\r\n"
#: Bytes of compressed stream that are read at once.
BLOCK = 1 << 20
#: Records that one reading task takes from an archive at a time.
READ_RUN = 256


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def sha1_base32_column(payload: Column) -> Column:
    """The same of a string column's bytes: five hexadecimal digits are four of base 32."""
    hexed = F.sha1(payload.cast("binary"))
    digits = F.concat(*[F.lpad(F.conv(F.substring(hexed, i + 1, 5), 16, 32), 4, "0") for i in range(0, 40, 5)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def open_fs(uri: str):
    """File system and path of a Hadoop-style URI, for executors."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if colon and not rest.startswith("//"):
        uri = f"{scheme}://{rest}"
    return fs.FileSystem.from_uri(uri)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest and refers_to (null for responses)."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    base = base.withColumn("payload_digest", sha1_base32_column(F.col("payload")))
    # one row for each digest that occurs more than once: digests and ids alone are grouped
    firsts = materialize(base.groupBy("payload_digest").agg(F.min("page_id").alias("__q_first"), F.count(F.lit(1)).alias("__q_n")).filter("__q_n > 1"), "digests")
    out = spread_join(base, firsts, ["payload_digest"], "__q_n", pages.count(), "left").withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    again = F.col("__q_first").isNotNull() & ~F.col("__q_first").eqNullSafe(F.col("page_id")) & (F.col("payload_bytes") >= min_bytes)
    return out.withColumn("refers_to", F.when(again, F.col("__q_first"))).drop("__q_first")


def _urn(page_id, digest):
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def write_monolithic(records: DataFrame, path: str, date: str = "2025-01-01T00:00:00Z") -> None:
    """Write with_revisits() output as WARC files, each one gzip stream over all of its records."""
    digest, first = F.col("payload_digest"), F.col("refers_to")
    revisit = first.isNotNull()
    # a header value is one line
    uri = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7f]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), _urn(F.col("page_id"), digest), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), digest,
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("\r\nX-Page-Id: "), F.col("page_id").cast("string"))).otherwise(F.lit("")),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _urn(first, digest), F.lit("\r\nX-Refers-To-Page: "), first.cast("string"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    records.select(F.concat(head, block).alias("value")).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(path)


def inflate(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, as they are inflated, BLOCK of them at a time at most; an error if the last member
    does not end.  Zero bytes behind a member are padding."""
    z, begun = zlib.decompressobj(31), False
    while data := stream.read(BLOCK):
        while data:
            if not begun and not (data := data.lstrip(b"\0")):
                break
            begun = True
            if part := z.decompress(data, BLOCK):
                yield part
            data = z.unconsumed_tail
            if z.eof:
                data, z, begun = z.unused_data, zlib.decompressobj(31), False
    while begun and not z.eof:
        if not (part := z.decompress(b"", BLOCK)):
            raise ValueError("the gzip stream does not end")
        yield part


def parse(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record without its closing blank lines) of each record; holds one record at a time."""
    buffer = bytearray()

    def fill(n: int) -> bool:
        while len(buffer) < n:
            if (more := next(parts, None)) is None:
                return False
            buffer.extend(more)
        return True

    while True:
        while fill(1) and buffer[:1] in (b"\r", b"\n"):
            del buffer[:1]
        if not buffer:
            return
        at = -1
        while (at := buffer.find(CRLF2, max(0, at))) < 0:
            at = len(buffer) - 3
            if not fill(len(buffer) + 1):
                raise ValueError("a record's header does not end")
        headers = read_headers(bytes(buffer[:at]))
        size = at + 4 + int(headers["content-length"])
        if not fill(size):
            raise ValueError("a record's block does not end")
        yield headers, bytes(buffer[:size])
        del buffer[:size]


def read_headers(head: bytes) -> dict[str, str]:
    first, *rest = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}


def normalise_file(source: str, target: str) -> int:
    """Rewrite one archive with a member per record, and its index beside it. Both appear under their names only when whole.

    Every attempt writes files of its own and moves them last, so that attempts that run at once, or one that outlives its task, do no
    harm: their content is the same."""
    src_fs, src = open_fs(source)
    dst_fs, dst = open_fs(target)
    mark = uuid.uuid4().hex
    n = offset = 0
    with src_fs.open_input_stream(src, compression=None) as stream, dst_fs.open_output_stream(f"{dst}.{mark}.part", compression=None) as out, dst_fs.open_output_stream(f"{dst}.idx.{mark}.part", compression=None) as index:
        for headers, record in parse(inflate(stream)):
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = z.compress(record + CRLF2) + z.flush()
            out.write(member)
            index.write(json.dumps({"archive": target, "record": n, "offset": offset, "length": len(member), "record_type": headers.get("warc-type"), "uri": headers.get("warc-target-uri"), "record_id": headers.get("warc-record-id")}).encode() + b"\n")
            offset += len(member)
            n += 1
    for name in (dst, f"{dst}.idx"):
        _publish(dst_fs, f"{name}.{mark}.part", name)
    return n


def _publish(fs, part: str, name: str) -> None:
    """Move a whole file to its name; if another attempt's file is there, and the file system does not replace files, that one stays."""
    from pyarrow.fs import FileType

    try:
        fs.move(part, name)
    except OSError:
        if fs.get_file_info(name).type != FileType.File:
            raise
        fs.delete_file(part)


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Normalise every .gz file of a folder; one row per archive: archive, n_records. Runs at once."""
    fs, path = open_fs(target)
    fs.create_dir(path, recursive=True)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")

    def run(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                archive = f"{target}/{p.rpartition('/')[2].partition('.')[0]}.warc.gz"
                yield pa.RecordBatch.from_pydict({"archive": [archive], "n_records": [normalise_file(p, archive)]})

    n = files.count()
    return materialize(files.repartition(max(1, n), "path").mapInArrow(run, "archive string, n_records long"), "archives")


INDEX = "archive string, record long, offset long, length long, record_type string, uri string, record_id string"


def read_index(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.idx").json(target)


def read_archives(index: DataFrame) -> DataFrame:
    """Fetch each indexed record: page_id, record_type, refers_to, header digest, and the payload's measured bytes and digest."""
    schema = "page_id long, record_type string, refers_to long, stated_digest string, block_bytes long, block_digest string, archive string, offset long"

    def run(batches):
        path, handle = None, None
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                if r["archive"] != path:
                    if handle:
                        handle.close()
                    path = r["archive"]
                    fs, p = open_fs(path)
                    handle = fs.open_input_file(p)
                handle.seek(r["offset"])
                record = zlib.decompress(handle.read(r["length"]), 31)
                head, _, rest = record.partition(CRLF2)
                h = read_headers(head)
                block = rest[:int(h["content-length"])]
                payload = block.partition(CRLF2)[2]
                num = lambda k: int(h[k]) if k in h else None
                out.append({"page_id": num("x-page-id"), "record_type": h["warc-type"], "refers_to": num("x-refers-to-page"), "stated_digest": h["warc-payload-digest"].removeprefix("sha1:"), "block_bytes": len(payload), "block_digest": sha1_base32(payload), "archive": path, "offset": r["offset"]})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(T._parse_datatype_string(schema))
    run_of = F.floor(F.col("record") / READ_RUN)
    dealt = index.select("archive", "offset", "length", run_of.alias("run")).repartition("archive", "run").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(run, schema)


def resolve(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, archive, offset; a revisit takes them from the record it names."""
    full = read.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("block_digest").alias("stated_digest")).agg(F.max("block_bytes").alias("__q_bytes")).filter("refers_to is not null")
    revisit = read.filter("record_type = 'revisit'")
    named = materialize(revisit.groupBy("refers_to", "stated_digest").agg(F.count(F.lit(1)).alias("__q_n")).join(full, ["refers_to", "stated_digest"], "left"), "named")
    joined = spread_join(revisit, named, ["refers_to", "stated_digest"], "__q_n", read.count(), "left")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset"]
    # a revisit whose named record is missing keeps null bytes
    revisits = joined.withColumn("payload_bytes", F.col("__q_bytes")).withColumn("payload_digest", F.col("stated_digest")).select(cols)
    responses = read.filter("record_type = 'response'").withColumn("payload_bytes", F.col("block_bytes")).withColumn("payload_digest", F.col("block_digest")).select(cols)
    return responses.unionByName(revisits)


def warc_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Operator 1 as a whole, in scratch space: write, normalise, read back by the index."""
    spark = pages.sparkSession
    raw, target = scratch_path(spark, "warc-raw"), scratch_path(spark, "warc")
    write_monolithic(with_revisits(pages, min_bytes), raw)
    normalise(spark, raw, target)
    return resolve(materialize(read_archives(read_index(spark, target)), "warc-read"))


ORACLE = r"""WITH d AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
x AS (SELECT page_id, strlen(p) AS n, sha1(p) AS hx FROM d),
b AS (SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hx, (5 * i + 1)::BIGINT, 5))::BIGINT >> s) & 31) + 1, 1)), '')), '') AS payload_digest FROM x),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f
"""
