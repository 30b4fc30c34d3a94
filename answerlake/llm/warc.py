"""WARC archives of web pages: written with their index, read back by byte ranges.

Writing: every page becomes one gzip member with a WARC 1.1 record. Of records with the
same payload of at least ``MIN_REVISIT`` bytes, that with the largest page id is the
response and the others are revisits without payload. Each task writes its records to a
file of its own in the archive folder, and returns the index rows (file, offset, length,
url, digest, ...); the index is a table that Spark commits, so files of lost tasks are in
no index row and are never read.

Reading: the index rows of the wanted records are sorted by file and offset, neighbours
with gaps up to ``GAP`` bytes are joined to ranges of up to ``RANGE`` bytes, and each
range is fetched with one read.

Cases: null html is an empty payload; null urls are written as an empty URI and read back
as null; pages without id can be revisits, and are responses where no equal page has an
id; repeated rows are written each, rows that share the largest id are all responses; an
empty table gives an empty index. Extra columns are not read.
"""

import gzip
import hashlib
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlake.llm import query
from answerlake.llm.common import col, table, utf8
from answerlake.runtime import cut_lineage, shared_dir

MIN_REVISIT, GAP, RANGE, FILE_BYTES, LEVEL = 1000, 64 << 10, 8 << 20, 256 << 20, 1
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = ("file string, offset long, length long, url string, page_id long, payload_bytes long, "
         "payload_digest string, record_type string, refers_to long")


def _clean(value: str) -> str:
    """A header value on one line, other bytes percent-encoded."""
    return "".join(chr(b) if 33 <= b < 127 else f"%{b:02X}" for b in value.encode())


def record(page_id, url, payload: bytes, size: int, digest: str, kind: str, refers_to) -> bytes:
    """A WARC record; ``size`` and ``digest`` are those of the whole payload, which a revisit
    leaves out. The exact url is kept in a header of its own."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url or '')}",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {size}"]
    if url is not None:
        head.append(f"X-Url: {url.encode().hex()}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To: {refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """The headers and the payload of a record; raises ValueError when it is not whole."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record has another length than it says")
    return headers, rest[:size]


def _write(folder: str, file_bytes: int):
    """Batches (page_id, url, html, bytes, digest, kind, refers_to) to index rows."""
    def work(batches):
        store, base = fs.FileSystem.from_uri(folder)
        out = name = None
        at = 0
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)),
                       *[c.to_pylist() for c in batch.columns[3:]])
            index = []
            for page_id, url, html, size, digest, kind, refers_to in rows:
                if out is None:
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                member = gzip.compress(record(page_id, url, html or b"", size, digest, kind, refers_to), LEVEL, mtime=0)
                out.write(member)
                index.append((name, at, len(member), url, page_id, size, digest, kind, refers_to))
                at += len(member)
                if at >= file_bytes:
                    out.close()
                    out = None
            if index:
                columns = list(zip(*index))
                types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(),
                         pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)],
                    names=[f.split()[0] for f in INDEX.split(", ")])
        if out is not None:
            out.close()
    return work


def write_archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url",
                  html: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archive files and the index to ``folder``; returns the index."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit(""))
    given = (pages.select(col(page_id).cast("long").alias("page_id"), col(url).cast("string").alias("url"),
                          col(html).cast("string").alias("html"))
             .withColumn("payload_bytes", F.octet_length(payload).cast("long"))
             .withColumn("payload_digest", F.sha1(payload.cast("binary"))))
    # digests that occur again: a small part of all, shuffled without the pages
    often = cut_lineage(given.where(F.col("payload_bytes") >= MIN_REVISIT)
                        .groupBy("payload_digest", "payload_bytes")
                        .agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
                        .where((F.col("n") > 1) & F.col("first_id").isNotNull()).drop("n"), "repeated")
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    revisits = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = (given.join(often, ["payload_digest", "payload_bytes"], "left")
            .select("page_id", "url", F.when(revisits, F.lit("")).otherwise(F.col("html")).alias("html"),
                    "payload_bytes", "payload_digest", F.when(revisits, "revisit").otherwise("response")
                    .alias("record_type"), F.when(revisits, F.col("first_id")).alias("refers_to")))
    rows.mapInArrow(_write(folder, file_bytes), INDEX).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def _read(folder: str, gap: int, most: int):
    """Batches (file, offset, length), sorted, to records."""
    def work(batches):
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            ranges = []
            for name, at, size in zip(*[c.to_pylist() for c in batch.columns]):
                last = ranges[-1] if ranges else None
                if last and last[0] == name and 0 <= at - last[2] <= gap and at + size - last[1] <= most:
                    last[2] = at + size
                    last[3].append((at, size))
                else:
                    ranges.append([name, at, at + size, [(at, size)]])
            handle = opened = None
            for name, begin, stop, records in ranges:
                if opened != name:
                    if handle:
                        handle.close()
                    handle, opened = store.open_input_file(f"{base}/{name}"), name
                handle.seek(begin)
                data, out = handle.read(stop - begin), []
                for at, size in records:
                    headers, payload = parse(gzip.decompress(data[at - begin:at - begin + size]))
                    number = lambda k: int(headers[k]) if k in headers else None
                    url = bytes.fromhex(headers["X-Url"]).decode() if "X-Url" in headers else None
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{name} at {at}: the payload is not that of its digest")
                    out.append((number("X-Page-Id"), url, payload, number("X-Payload-Bytes"), digest, kind,
                                number("X-Refers-To")))
                columns = list(zip(*out))
                types = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)],
                    names=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            if handle:
                handle.close()
    return work


def read_records(wanted: DataFrame, folder: str, gap: int = GAP, most: int = RANGE) -> DataFrame:
    """The records of index rows: page_id, url, payload, payload_bytes, payload_digest,
    record_type, refers_to; revisits have an empty payload.

    As many tasks as the wanted records have ranges of ``most`` bytes: index rows are so
    small that their own bytes say nothing about the reads.
    """
    size = wanted.agg(F.sum("length")).first()[0] or 0
    sorted_rows = (wanted.select("file", "offset", "length")
                   .repartition(max(1, -(-size // most)), "file", F.floor(F.col("offset") / most))
                   .sortWithinPartitions("file", "offset"))
    return sorted_rows.mapInArrow(
        _read(folder, gap, most), "page_id long, url string, payload binary, payload_bytes long, "
        "payload_digest string, record_type string, refers_to long")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/index")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
f AS (SELECT payload_bytes, payload_digest, max(page_id) AS first_id FROM d
      WHERE payload_bytes >= {MIN_REVISIT} GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_bytes, payload_digest)"""


@query("op8_warc", SQL)
def op8(spark, sf_dir):
    folder = shared_dir(spark, "warc")
    index = write_archive(table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
