"""WARC archives whose repeated payloads are revisit records.

Archives are written and read by Spark's own sources, so that they may lie in any store that Spark reaches.
"""

import base64
import datetime
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daytable.llm.common import cut, dealt, new_path, numbered, or_empty, same, small_join, table

LEAST_BYTES = 1000
#: An archive is closed when it holds as many bytes, and a record's gzip member after as many of the record's.
ARCHIVE_BYTES, MEMBER_BYTES = 32 << 20, 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_type string, record_id string, page_id long, url string, payload_digest string, refers_to_id string, payload binary"


def record_id(page: Column, url: Column, digest: Column, copy: Column) -> Column:
    """A name for the record of a page that reruns give again; `copy` tells equal rows apart."""
    h = F.md5(F.concat_ws("|", F.lit("daytable"), page.cast("string"), digest, copy.cast("string"), or_empty(url)))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts))


def base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def copies_numbered(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """rows with `copy`, 0 but for rows that are equal in page, address and payload, which are counted from 0. Only those
    rows are shuffled, if there are any; how often a row is repeated makes no task longer."""
    key = ["page_id", "url", "digest"]
    twice = cut(heads.groupBy(*(F.col(c).alias(f"of_{c}") for c in key)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    if twice.isEmpty():
        return rows.withColumn("copy", F.lit(0).cast("long"))
    met = small_join(rows, twice, same(key, [f"of_{c}" for c in key]), "left").drop(*(f"of_{c}" for c in key))
    repeated = numbered(dealt(met.filter("n is not null")), key, [], [], "copy")
    return met.filter("n is null").withColumn("copy", F.lit(0).cast("long")).unionByName(repeated).drop("n")


def resolve(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, digest, bytes, copy, refers, payload), a record for each row of pages (page_id, url, html): of equal
    payloads of least_bytes or more, the one with the largest page_id is the response and the others, without payload, are
    revisits of it; smaller ones are all responses.

    A null html is an empty payload; a payload of any length stays whole. A null page_id is always a response that none
    refers to. Rows that share the largest page_id of a payload are all responses, the first of them in order of address
    from the end is referred to. Repeated rows are records of their own. An empty table gives an empty table.

    Headers, that is ids, addresses, sizes and digests, are cut and shuffled by digest; extremes of a hot payload combine
    before that. What is left of them, a row for each payload that occurs twice, meets the pages: by broadcast where it is
    counted to be small, else by a join whose side of pages Spark splits.
    """
    payload = or_empty(F.col("html")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})
    heads = cut(rows.drop("payload"))
    large = heads.filter((F.col("bytes") >= least_bytes) & F.col("page_id").isNotNull())
    first = large.groupBy(F.col("digest").alias("of"), F.col("bytes").alias("of_bytes")).agg(F.max(F.struct("page_id", or_empty(F.col("url")).alias("url"))).alias("first"), F.count(F.lit(1)).alias("n"))
    first = cut(first.filter("n > 1").drop("n"))
    met = small_join(copies_numbered(rows, heads), first, (F.col("digest") == F.col("of")) & (F.col("bytes") == F.col("of_bytes")) & (F.col("page_id") < F.col("first.page_id")), "left")
    return met.select("page_id", "url", "digest", "bytes", "copy", F.when(F.col("of").isNotNull(), F.col("first")).alias("refers"), F.when(F.col("of").isNull(), F.col("payload")).alias("payload"))


def head(page: int | None, url: str | None, digest: str, name: str, to_name: str | None, to_url: str | None, size: int, date: str) -> bytes:
    """A record's head with the empty line that ends it. Line ends in addresses are left out."""
    bare = lambda u: re.sub("[\r\n]", "", u or "")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if to_name else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {bare(url)}")
    if page is not None:
        lines.append(f"X-Page-Id: {page}")
    lines.append(f"WARC-Payload-Digest: sha1:{base32(digest)}")
    if to_name:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{to_name}>", f"WARC-Refers-To-Target-URI: {bare(to_url)}"]
    return "\r\n".join([*lines, "Content-Type: application/octet-stream", f"Content-Length: {size}", "", ""]).encode()


def members(record: bytes) -> bytes:
    """A record as a gzip member of its own, or as several where it is long: each ends in a zero byte, the highest of its
    size, which Spark's text writer adds as its line end."""
    out = []
    for at in range(0, len(record), MEMBER_BYTES):
        press = zlib.compressobj(5, zlib.DEFLATED, 31)
        out += [press.compress(record[at : at + MEMBER_BYTES]), press.flush()]
    return b"".join(out)


def write_archives(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None) -> None:
    """Records as archives of about archive_bytes each, a gzip member or more for each record, dated now or as given.

    A task closes an archive as soon as it is full, and each is a row, and so a file, of Spark's text writer."""
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    name = record_id(F.col("page_id"), F.col("url"), F.col("digest"), F.col("copy"))
    to = F.when(F.col("refers").isNotNull(), record_id(F.col("refers.page_id"), F.col("refers.url"), F.col("digest"), F.lit(0)))
    rows = records.select("page_id", "url", "digest", name.alias("name"), to.alias("to_name"), F.col("refers.url").alias("to_url"), "payload")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        archive = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])
        for batch in batches:
            for k in range(batch.num_rows):
                *about, payload = (c[k].as_py() for c in batch.columns)
                payload = payload or b""
                held.append(members(head(*about, len(payload), date) + payload + b"\r\n\r\n"))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield archive()
                    held, size = [], 0
        if held:
            yield archive()

    packed = rows.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def unzipped(archive: memoryview, step: int = 1 << 16) -> Iterator[bytes]:
    """What the gzip members of an archive hold, bit by bit."""
    at, press = 0, zlib.decompressobj(31)
    while at < len(archive):
        out = press.decompress(archive[at : at + step])
        at += min(step, len(archive) - at) - len(press.unused_data)
        if press.eof:
            press = zlib.decompressobj(31)
        if out:
            yield out


def parse(parts: Iterable[bytes]) -> Iterator[dict]:
    """The records of an archive, by their Content-Length; one record at a time is held."""
    held, at, end = bytearray(), None, 0
    for part in parts:
        held += part
        while True:
            if at is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                fields = dict(re.findall(r"^([^:\r\n]+): *([^\r\n]*)", held[:end].decode(), re.M))
                at = end + 4 + int(fields["Content-Length"])
            if len(held) < at + 4:
                break
            if held[at : at + 4] != b"\r\n\r\n":
                raise ValueError(f"no end of record after {fields['WARC-Record-ID']}")
            digest, page = fields["WARC-Payload-Digest"], fields.get("X-Page-Id")
            yield {
                "record_type": fields["WARC-Type"],
                "record_id": fields["WARC-Record-ID"].strip("<>"),
                "page_id": int(page) if page else None,
                "url": fields.get("WARC-Target-URI"),
                "payload_digest": base64.b32decode(digest.removeprefix("sha1:")).hex(),
                "refers_to_id": fields["WARC-Refers-To"].strip("<>") if "WARC-Refers-To" in fields else None,
                "payload": bytes(held[end + 4 : at]),
            }
            del held[: at + 4]
            at = None
    if held:
        raise ValueError("the archive ends inside a record")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under a path: RECORD's columns. A task unzips an archive bit by bit."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n == "page_id" else pa.string()) for n in (x.split()[0] for x in RECORD.split(", "))])
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for r in parse(unzipped(memoryview(content.as_buffer()))):
                    rows.append(r)
                    size += len(r["payload"])
                    if len(rows) == 500 or size > MEMBER_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.filter("length > 0").select("content").mapInArrow(records, RECORD)


def revisits_resolved(records: DataFrame) -> DataFrame:
    """Records, without their payloads, with the page and payload size of what they refer to as refers_to and payload_bytes.

    Archives are read once, into a table of headers; revisits of a hot response are the side of the join that Spark splits.
    """
    sized = cut(records.withColumn("own_bytes", F.octet_length("payload").cast("long")).drop("payload"))
    revisit = sized.filter("record_type = 'revisit'")
    asked = revisit.select(F.col("refers_to_id").alias("to_id")).distinct()
    answers = sized.filter("record_type = 'response'").join(asked, F.col("record_id") == F.col("to_id"), "left_semi")
    answers = cut(answers.groupBy(F.col("record_id").alias("to_id")).agg(F.first("page_id").alias("refers_to"), F.first("own_bytes").alias("to_bytes")))
    met = small_join(revisit, answers, F.col("refers_to_id") == F.col("to_id"), "left").withColumn("payload_bytes", F.col("to_bytes"))
    plain = sized.filter("record_type <> 'revisit'").withColumns({"refers_to": F.lit(None).cast("long"), "payload_bytes": F.col("own_bytes")})
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id"]
    return plain.select(names).unionByName(met.select(names))


def op1_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(resolve(table(spark, sf_dir, "pages")), path)
    return revisits_resolved(read_archives(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT h, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h
"""
