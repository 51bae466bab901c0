"""Operator 2: WARC archives, index first.

Archives are written by Spark's text writer: one record per row with CRLF line ends, one
archive per task, straight from the scan (the payloads are not shuffled unless copies have
to be looked up in a table too large to broadcast).  A scan of the record headers, which
steps over the payloads by their stated length, writes the index: archive, offset, length,
URL, digest, record type.  Reading starts from the index: selected records are sorted by
archive and offset, neighbouring byte ranges are joined up to a size, and each joined range
is one read.

Archives are opened inside tasks through ``pyarrow.fs``, so the shared folder may be a
mounted one (``file:``) or any store pyarrow reaches (``s3:``, ``gs:``, ``hdfs:``).

Defined cases: a null payload is empty; a null URL writes no URL header; a null page id is
written as ``null`` and read back as null, and it is the response only where no page with
that payload has an id (then all such rows are); rows that repeat page id and payload are
each written with the same type; an empty table writes an empty archive and gives empty
results; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobatlas.session import cut_lineage, shared_path

#: Records whose ranges lie closer than this are fetched by one read ...
GAP = 64 << 10
#: ... of at most about this many bytes.
READ_BYTES = 16 << 20
#: Bytes of records that one task reads.
TASK_BYTES = 64 << 20
DATE = "2020-01-01T00:00:00Z"

INDEX_DDL = ("archive string, offset long, length long, url string, digest string, record_type string, "
             "page_id long, refers_to long")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: four groups of ten hex digits become eight base-32 digits each."""
    h = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = DATE) -> str:
    """Write one record per row of ``pages (page_id, url, html)`` under ``path``.  Of equal payloads of at
    least ``min_bytes`` bytes the largest page id is the response, the others are revisits of it."""
    crlf = "\r\n"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload").cast("binary")),
                             "bytes": F.octet_length("payload")})
    copies = rows.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(
        F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = cut_lineage(copies, "warc-copies")  # broadcast if its files are small, else a sort-merge join
    rows = rows.join(copies, "digest", "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")) & (F.col("bytes") >= min_bytes)
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    record = F.concat(
        F.lit("WARC/1.0" + crlf + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(crlf + "WARC-Record-ID: <urn:page:"), name, F.lit(">" + crlf),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit(crlf)), F.lit("")),
        F.lit(f"WARC-Date: {date}{crlf}WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(crlf),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("response").cast("string"), F.lit(
            f">{crlf}WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest{crlf}"))).otherwise(""),
        F.lit("Content-Type: text/html; charset=utf-8" + crlf + "Content-Length: "),
        F.when(revisit, "0").otherwise(F.col("bytes").cast("string")), F.lit(crlf + crlf),
        F.when(revisit, "").otherwise(F.col("payload")), F.lit(crlf))
    rows.select(record.alias("value")).write.option("lineSep", crlf).text(path)
    return path


def _open(path: str):
    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    if "://" not in path:
        return pafs.LocalFileSystem().open_input_file(path)
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def _headers(raw: bytes) -> dict[str, str]:
    return {k.decode(): v.decode() for k, _, v in (line.partition(b": ") for line in raw.split(b"\r\n")[1:] if line)}


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _scan(archive: str) -> Iterator[tuple]:
    """Index rows of one archive, reading on in blocks and stepping over the payloads."""
    with _open(archive) as f:
        size, at, block, base = f.size(), 0, b"", 0
        while at < size:
            want = 4096
            while True:  # the header, however long
                if at < base or at + want > base + len(block):
                    base, block = at, f.read_at(min(size - at, max(want, 1 << 20)), at)
                end = block.find(b"\r\n\r\n", at - base)
                if end >= 0 or base + len(block) >= size:
                    break
                want = 2 * max(want, len(block) - (at - base))
            if end < 0:
                raise ValueError(f"{archive}: no record header ends after offset {at}")
            h = _headers(block[at - base:end])
            length = end + base + 4 - at + int(h["Content-Length"]) + 4
            yield (archive, at, length, h.get("WARC-Target-URI"), h["WARC-Payload-Digest"].removeprefix("sha1:"),
                   h["WARC-Type"], _page(h["WARC-Record-ID"]), _page(h.get("WARC-Refers-To")))
            at += length


_INDEX = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()),
                    ("digest", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()),
                    ("refers_to", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def index_archives(spark: SparkSession, path: str) -> DataFrame:
    """The index of all archives under ``path``."""
    # Only names are read here: the content column is pruned.  One task per few archives.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column(0).to_pylist():
                rows = []
                for row in _scan(archive):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield _batch(rows, _INDEX)
                        rows = []
                yield _batch(rows, _INDEX)

    return files.mapInArrow(run, INDEX_DDL)


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                     ("refers_to", pa.int64()), ("digest", pa.string()), ("payload", pa.binary())])


def reading_tasks(index: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Tasks that read the records of the index rows, by the bytes of the records and not of the rows."""
    return max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // task_bytes))


def read_records(index: DataFrame, gap: int = GAP, read_bytes: int = READ_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The records of the index rows: ``(page_id, url, record_type, refers_to, digest, payload)``.
    Index rows are dealt by stripes of an archive, so a long archive is read by many tasks; how
    many follows from the records' bytes (``index`` is read twice: give a written table)."""
    dealt = index.select("archive", "offset", "length", (F.col("offset") / read_bytes).cast("long").alias("stripe"))
    dealt = dealt.repartition(reading_tasks(index, task_bytes), "archive", "stripe").sortWithinPartitions("archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fetch(archive: str, ranges: list[tuple[int, int]]) -> pa.RecordBatch:
            start = ranges[0][0]
            with _open(archive) as f:
                block = f.read_at(max(o + n for o, n in ranges) - start, start)
            rows = []
            for o, n in ranges:
                raw = block[o - start:o - start + n]
                head, _, rest = raw.partition(b"\r\n\r\n")
                h = _headers(head)
                rows.append((_page(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), h["WARC-Type"],
                             _page(h.get("WARC-Refers-To")), h["WARC-Payload-Digest"].removeprefix("sha1:"),
                             rest[:int(h["Content-Length"])]))
            return _batch(rows, _RECORD)

        archive, ranges = None, []
        for b in batches:
            for a, o, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                if ranges and (a != archive or o - sum(ranges[-1]) > gap or o + n - ranges[0][0] > read_bytes):
                    yield fetch(archive, ranges)
                    ranges = []
                archive = a
                ranges.append((o, n))
        if ranges:
            yield fetch(archive, ranges)

    return dealt.select("archive", "offset", "length").mapInArrow(
        run, "page_id long, url string, record_type string, refers_to long, digest string, payload binary")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the archives and their index under the shared folder and read every record back:
    ``(page_id, url, payload_bytes, payload_digest, record_type, refers_to)``; a revisit takes size and digest
    from the payload of the record that it refers to."""
    spark = pages.sparkSession
    path = write_archives(pages, shared_path(spark, "tables", f"warc-{uuid.uuid4().hex}"), min_bytes)
    index = cut_lineage(index_archives(spark, path), "warc-index")
    records = read_records(index).select(
        "page_id", "url", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("bytes"),
        base32_sha1(F.col("payload")).alias("found"))
    records = cut_lineage(records, "warc-records")
    said = records.where("record_type = 'response'")
    kept = said.select(F.col("page_id").alias("refers_to"), "digest", "bytes", "found").distinct()
    again = records.where("record_type = 'revisit'").drop("bytes", "found").join(kept, ["refers_to", "digest"], "left")
    return said.unionByName(again).select("page_id", "url", F.col("bytes").alias("payload_bytes"),
                                          F.col("found").alias("payload_digest"), "record_type", "refers_to")
