"""WARC archives with an index: records are written, indexed, and read by coalesced byte ranges.

``archive`` writes WARC/1.1 files, a record a page: the page's text in UTF-8 as the payload of an HTTP response. Spark's text
writer does it, with the four bytes that end a record as its line separator, so files are committed like any other output
and a lost executor leaves no part of them. Records are not compressed. ``index`` walks the files by the records' own
lengths and gives file, offset, length, URL and digest of each record, without keeping payloads. ``read`` takes the
index rows of the records wanted, sorts them by file and offset, joins ranges that lie close together into one read, and gives
their payloads.

Of pages with equal payloads of ``LEAST`` bytes or more, that with the largest page_id is a response and the others are
revisits of it, which hold no payload. Payloads are told apart by SHA-1, length and a second hash. Equal payloads are
counted with partial sums, and only payloads met twice or more are joined back, so that a hot one can be split.

Edge cases: null text is an empty payload; a null page_id is written without its field, and revisits a page that has one; rows
that share the largest page_id of a payload are all responses and share a record id. A null or empty URL is left out (null in
the index); white space and control characters of a URL are percent-encoded. Extra columns are ignored; an empty table
gives an empty index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, small_batches

#: Payloads of so many bytes are stored once.
LEAST = 1000
#: Bytes between two records that are read along, most bytes of one read, and bytes of a file that a task reads.
GAP, MOST, PART = 64 << 10, 8 << 20, 32 << 20
# Names of the format.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string, record_id string, refers_to_id string, payload_at long, payload_length long"


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.to_json(F.struct(*[p.cast("string").alias(f"p{k}") for k, p in enumerate(parts)])))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, bytes, digest, record_type, record_id, refers_to_id and refers_to_url of each page."""
    payload = F.col("html").cast("binary")
    url = F.nullif(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("url").cast("string"), "\r", "%0D"), "\n", "%0A"), r"[\x00-\x20\x7F]", "%20"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.select("*", F.octet_length("html").cast("long").alias("bytes"), F.sha1(payload).alias("digest"), F.xxhash64("html").alias("mark"))
    same = ["digest", "bytes", "mark"]
    groups = rows.filter(F.col("bytes") >= least).groupBy(*same).agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("top"))
    groups = materialise(groups.filter("n > 1 and top.page_id is not null").select(*same, "top"), "equal-payloads")
    again = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top.page_id"))
    response = lambda page: _uuid(F.lit("response"), page, F.col("digest"))
    own = F.when(again, _uuid(F.lit("revisit"), F.col("page_id"), F.col("url"), F.col("digest"))).when(F.col("top").isNotNull(), response(F.col("page_id"))).otherwise(_uuid(F.lit("page"), F.col("page_id"), F.col("url"), F.col("digest")))
    found = rows.join(groups, same, "left")
    return found.select("page_id", "url", "html", "bytes", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), own.alias("record_id"), F.when(again, response(F.col("top.page_id"))).alias("refers_to_id"), F.when(again, F.col("top.url")).alias("refers_to_url"))


def archive(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", least: int = LEAST) -> None:
    """Write the pages as WARC files under a new folder."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value.cast("string")), F.lit(""))
    length = F.octet_length("http") + F.when(revisit, 0).otherwise(F.col("bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), line("WARC-Record-ID", F.col("record_id")), F.lit(f"\r\nWARC-Date: {date}"), line("WARC-Target-URI", F.col("url")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Profile", F.when(revisit, PROFILE)), line("WARC-Refers-To", F.col("refers_to_id")), line("WARC-Refers-To-Target-URI", F.col("refers_to_url")), line("X-Page-ID", F.col("page_id")),
        F.lit("\r\nContent-Type: application/http;msgtype=response"), line("Content-Length", length), F.lit(END),
    )
    found = records(pages, least).withColumn("http", http)
    found.select(F.concat(head, "http", F.when(revisit, "").otherwise(F.col("html"))).alias("value")).write.option("lineSep", END).text(path)


def _opened(file: str) -> pa.NativeFile:
    fs, path = pyarrow.fs.FileSystem.from_uri(file)
    return fs.open_input_file(path)


def fields(head: bytes) -> dict[str, str]:
    """The named fields of a record's head, by their names in lower case."""
    lines = (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:])
    return {name.lower(): value.strip() for name, _, value in lines}


def walk(source: pa.NativeFile) -> Iterator[tuple[int, int, bytes, int, int]]:
    """offset, length, head, where the payload begins and its length, of each record of a file."""
    offset, size = 0, source.size()
    while offset < size:
        source.seek(offset)
        data = b""
        while (stop := data.find(b"\r\n\r\n")) < 0:
            more = source.read(16 << 10)
            if not more:
                raise ValueError(f"no record at byte {offset}")
            data += more
        block, length = stop + 4, int(fields(data[:stop])["content-length"])
        while (body := data.find(b"\r\n\r\n", block)) < 0:
            data += source.read(16 << 10)
        body += 4
        yield offset, block + length + 4, data[:stop], offset + body, block + length - body
        offset += block + length + 4


def index(spark: SparkSession, path: str) -> DataFrame:
    """The index of all records of the archives under a folder (columns of ``INDEX``; length is that of the whole record)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in INDEX.split(", ")]
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names=names)
        for file in (x for batch in batches for x in batch.column(0).to_pylist()):
            rows = []
            with _opened(file) as source:
                for offset, length, head, at, n in walk(source):
                    f = fields(head)
                    page = f.get("x-page-id")
                    rows.append((file, offset, length, f.get("warc-target-uri"), f["warc-payload-digest"].removeprefix("sha1:"), None if page is None else int(page), f["warc-type"], f["warc-record-id"], f.get("warc-refers-to"), at, n))
                    if len(rows) == 1000:
                        yield table(rows)
                        rows = []
            yield table(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")  # lists, and reads no content
    return files.repartition("path").mapInArrow(run, INDEX)


def coalesced(spans: Iterator[tuple[int, int]], gap: int = GAP, most: int = MOST) -> Iterator[tuple[int, int, int]]:
    """Ranges (start, end, number of spans) that cover sorted spans (start, end): neighbours are joined while they lie within the gap and the range within most bytes."""
    start = end = n = 0
    for a, b in spans:
        if n and (a - end > gap or max(b, end) - start > most):
            yield start, end, n
            n = 0
        start, end, n = (a, b, 1) if not n else (start, max(b, end), n + 1)
    if n:
        yield start, end, n


def read(selected: DataFrame, gap: int = GAP, most: int = MOST) -> DataFrame:
    """The selected rows of an index with their payload (null for revisits), read by ranges of neighbours.

    Records are dealt out by file and stretches of ``PART`` bytes and sorted there. A payload that doesn't have the index's
    digest is an error.
    """
    small_batches(selected.sparkSession)
    names = [x.split()[0] for x in INDEX.split(", ")]
    rows = selected.select(*names, F.floor(F.col("offset") / PART).alias("part"))
    rows = rows.repartition("file", "part").sortWithinPartitions("file", "offset").drop("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, ids, digests, kinds = (batch.column(names.index(c)).to_pylist() for c in ("file", "record_id", "digest", "record_type"))
            starts, lengths, at, sizes = (batch.column(names.index(c)).to_pylist() for c in ("offset", "length", "payload_at", "payload_length"))
            k, first = 0, 0
            while first < len(files):
                last = first
                while last < len(files) and files[last] == files[first]:
                    last += 1
                with _opened(files[first]) as source:
                    for start, end, n in coalesced(((starts[i], starts[i] + lengths[i]) for i in range(first, last)), gap, most):
                        source.seek(start)
                        data = source.read(end - start)
                        payloads = []
                        for i in range(k, k + n):
                            own = data[at[i] - start : at[i] - start + sizes[i]] if kinds[i] == "response" else None
                            if ids[i].encode() not in data[starts[i] - start : at[i] - start] or own is not None and hashlib.sha1(own).hexdigest() != digests[i]:
                                raise ValueError(f"{files[i]} at {starts[i]} isn't what the index says")
                            payloads.append(own)
                        yield pa.RecordBatch.from_arrays([*batch.slice(k, n).columns, pa.array(payloads, pa.binary())], names=[*names, "payload"])
                        k += n
                first = last

    return rows.mapInArrow(run, f"{INDEX}, payload binary")


def resolved(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records that ``read`` gave: a revisit has those of the response it refers to.

    The responses referred to must be among the records.
    """
    measured = found.select("page_id", "record_id", "refers_to_id", "record_type", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1"))
    measured = materialise(measured, "warc-measured")
    wanted = measured.filter("record_type = 'revisit'")
    # A row for each response that is referred to, though rows of one page_id share it.
    targets = measured.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("page_id").alias("refers_to"), F.max("bytes").alias("t_bytes"), F.max("sha1").alias("t_sha1"))
    again = wanted.drop("bytes", "sha1").join(materialise(targets, "warc-responses"), "refers_to_id")
    again = again.select("page_id", F.col("t_bytes").alias("payload_bytes"), F.col("t_sha1").alias("payload_digest"), "record_type", "refers_to")
    own = measured.filter("record_type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(again)
