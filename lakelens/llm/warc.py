"""WARC archives: a writer of gzip members and a splittable reader.

Writing: every task writes one archive of its own into a shared folder, under a name that carries
the task attempt, and reports the name once the file is complete, so attempts that were lost or
repeated leave no record behind in the result. Records are one gzip member each. Payloads of at
least ``REVISIT_BYTES`` bytes that occur again are written once in full, under the smallest
page_id, and as ``revisit`` records elsewhere; revisits have no block.

Reading: archives are cut into byte ranges. A task scans its range for the gzip magic, checks each
candidate by decoding its header and the beginning of the member (which must be a WARC header),
and owns all records that start inside its range, reading past its end where the last one needs
it. Candidates that lie inside a member are skipped, as the reader jumps to where a member ends.

Nulls and empty payloads are written as empty records and read back as such. Rows that repeat a
page_id are written and read each for itself; of those with equal payloads, one is the response.
Null page_ids are carried as an absent header; their records are responses and never referred to. An empty table gives
no records.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.llm.shared import keep, pick, scratch

REVISIT_BYTES = 100
MAGIC = b"\x1f\x8b\x08"
RANGE = 8 << 20
_CRLF = "\r\n"


def _open(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """Any store that Arrow knows: file, hdfs, s3, gs."""
    return arrow_fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _record(kind: str, page: int | None, url: str | None, digest: str, n: int, first: int | None, body: bytes) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>"]
    if page is not None:
        head.append(f"X-Page-Id: {page}")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n}"]
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress((_CRLF.join(head) + _CRLF * 2).encode()) + deflate.compress(body) + deflate.compress(b"\r\n\r\n") + deflate.flush()


def write_warc(pages: DataFrame, folder: str, id_column: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes the archives into a shared folder; returns path, size and records of each, already written.

    The smallest id of each digest is found with partial aggregation, so a payload that a third of
    all pages share is one row for each task. The join back splits such a digest's pages (skew join).
    """
    p = pick(pages, id_column, url, payload).toDF("id", "url", "payload").withColumn("id", F.col("id").cast("long"))
    p = p.withColumn("payload", F.coalesce(F.col("payload").cast("string"), F.lit("")))
    p = p.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    p = p.withColumn("turn", F.monotonically_increasing_id())  # tells rows apart that repeat an id
    same = p.filter((F.col("bytes") >= REVISIT_BYTES) & F.col("id").isNotNull())
    firsts = same.groupBy("digest").agg(F.min(F.struct("id", "turn")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    marked = p.join(firsts, "digest", "left")
    other = F.col("first").isNotNull() & F.col("id").isNotNull() & (F.struct("id", "turn") != F.col("first"))
    marked = marked.select("id", "url", F.when(other, F.lit("")).otherwise(F.col("payload")).alias("payload"), "bytes", "digest", F.when(other, F.col("first.id")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next(batches, None)
        if batch is None:
            return
        task = TaskContext.get()
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        name, size, records = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz", 0, 0
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            while batch is not None:
                for i in range(batch.num_rows):
                    r = {c: batch.column(c)[i].as_py() for c in ("id", "url", "payload", "bytes", "digest", "first")}
                    raw = _record("response" if r["first"] is None else "revisit", r["id"], r["url"], r["digest"], r["bytes"], r["first"], r["payload"].encode())
                    out.write(raw)
                    size, records = size + len(raw), records + 1
                batch = next(batches, None)
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "size": [size], "records": [records]})

    return keep(marked.mapInArrow(run, "path string, size long, records long"), "warc-manifest")


class _Stream:
    """Bytes of a file from an offset on, with a bounded buffer."""

    def __init__(self, store: arrow_fs.FileSystem, path: str, at: int, step: int = 1 << 18) -> None:
        self.file, self.step = store.open_input_file(path), step
        self.file.seek(at)
        self.at, self.buffer = at, b""

    def fill(self, n: int) -> bool:
        """At least n bytes, if there are so many."""
        while len(self.buffer) < n:
            more = self.file.read(self.step)
            if not more:
                return False
            self.buffer += more
        return True

    def skip(self, n: int) -> None:
        self.buffer, self.at = self.buffer[n:], self.at + n

    def member(self) -> bytes | None:
        """The gzip member that begins here, decoded, if it is one that holds a WARC record; then the stream stands behind it."""
        self.fill(4096)
        try:
            probe = zlib.decompressobj(31).decompress(self.buffer[:4096], 16)
        except zlib.error:
            return None
        if not probe.startswith(b"WARC/1."):
            return None
        inflate, out, used = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            if not self.buffer and not self.fill(1):
                raise ValueError(f"archive ends within a record at byte {self.at}")
            out.append(inflate.decompress(self.buffer))
            used = len(self.buffer) - len(inflate.unused_data)
            self.skip(used)
        return b"".join(out)


def scan_range(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded record) of all records that start in [start, end)."""
    store, p = _open(path)
    s = _Stream(store, p, start)
    try:
        while s.at < end and s.fill(len(MAGIC)):
            found = s.buffer.find(MAGIC)
            if found < 0:
                s.skip(len(s.buffer) - len(MAGIC) + 1)
                continue
            s.skip(found)
            if s.at >= end:
                return
            at = s.at
            record = s.member()
            if record is None:
                s.skip(1)
            else:
                yield at, record
    finally:
        s.file.close()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split(_CRLF)[1:])
    return fields, rest[: int(fields["Content-Length"])]


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long"


def read_warc(archives: DataFrame, payloads: bool = False, split: int = RANGE) -> DataFrame:
    """One row a record of the archives (path, size). The digest of a response is taken from its block and held against its header."""
    total = archives.agg(F.sum(F.ceil(F.col("size") / split))).first()[0] or 1  # one number
    jobs = archives.filter("size > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
    jobs = jobs.repartition(max(1, int(total)))
    fields = _READ + (", payload string" if payloads else "")
    names = [x.split()[0] for x in fields.split(", ")]
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "offset": pa.int64()}

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                for offset, raw in scan_range(path, start, start + split):
                    f, body = parse_record(raw)
                    kind, digest = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"{path}: the record at {offset} does not match its digest")
                    first = f.get("WARC-Refers-To")
                    page = f.get("X-Page-Id")
                    row = (None if page is None else int(page), len(body) if kind == "response" else int(f["X-Payload-Length"]), digest, kind, None if first is None else int(first[10:-1]), path, offset)
                    rows.append(row + ((body.decode() if kind == "response" else None,) if payloads else ()))
                    held += len(body) if payloads else 0
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield flush(rows)
                        rows, held = [], 0
        if rows:
            yield flush(rows)

    return jobs.mapInArrow(run, fields)


def round_trip(pages: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: one row a page."""
    return read_warc(write_warc(pages, scratch(pages.sparkSession, "warc")))
