"""Data sources for files that Spark's readers do not cut: members of zip archives, and one huge JSON object.

`zip_lines` makes a task of every member, by the archive's central directory, and passes over
members that a filter on `archive` or `member` rules out. `json_ranges` and `json_entries` cut one
object {"key": value, ..} into byte ranges. Whether a range begins inside a string, and how deep,
depends on all before it; so a first pass counts, for either case, and the counts of all ranges are
added up; then every task knows its state, owns the entries whose opening brace or comma is in its
range, and reads past its end for the last of them.

Paths are of any store that Arrow opens (file, hdfs, s3, gs); a path without a scheme is a file's.
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

LINES = 1 << 12


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


# ---------------------------------------------------------------- zip


class Member(InputPartition):
    def __init__(self, archive: str, name: str) -> None:
        self.archive, self.name = archive, name


class _ZipReader(DataSourceReader):
    def __init__(self, path: str, field: str | None, wanted: str | None) -> None:
        self.path, self.field, self.wanted = path, field, wanted
        self.only: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column in ("archive", "member"):
                values = set(f.value if isinstance(f, In) else [f.value])
                self.only[column] = self.only.get(column, values) & values
            else:
                yield f

    def partitions(self) -> Sequence[Member]:
        store, root = _open(self.path)
        info = store.get_file_info(root)
        files = [info] if info.type == arrow_fs.FileType.File else store.get_file_info(arrow_fs.FileSelector(root))
        found = []
        for f in sorted((f for f in files if f.path.endswith(".zip") and f.base_name in self.only.get("archive", {f.base_name})), key=lambda f: f.path):
            with store.open_input_file(f.path) as held, zipfile.ZipFile(held) as z:  # only the directory at its end is read
                found += [Member(f.path, i.filename) for i in z.infolist() if not i.is_dir() and i.filename in self.only.get("member", {i.filename})]
        return found or [Member("", "")]

    def read(self, part: Member) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        left = set(json.loads(self.wanted)) if self.wanted is not None else None
        store, _ = _open(self.path)
        name = part.archive.rsplit("/", 1)[-1]

        def batch(rows: list[tuple[int, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([part.name] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["archive", "member", "line", "value"])

        rows = []
        with store.open_input_file(part.archive) as held, zipfile.ZipFile(held) as z, z.open(part.name) as lines:
            for n, raw in enumerate(lines):
                if left is not None and not left:
                    break  # all that was asked for is found: the rest stays packed
                text = raw.rstrip(b"\r\n").decode("utf-8", "replace")
                if left is not None:
                    try:
                        record = json.loads(text)
                    except ValueError:
                        continue
                    key = record.get(self.field) if isinstance(record, dict) else None
                    if not isinstance(key, str) or key not in left:
                        continue
                    left.discard(key)
                rows.append((n, text))
                if len(rows) == LINES:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


class ZipLines(DataSource):
    """archive, member, line and value of all lines of all members of the zip archives at `path`, a file or a folder.

    With `wanted` (a JSON list of strings) and `field`: of lines that are JSON objects the first with each of these
    values there, by member; a member is read no further than to the last of them.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return "archive string, member string, line long, value string"

    def reader(self, schema) -> _ZipReader:
        return _ZipReader(self.options["path"], self.options.get("field"), self.options.get("wanted"))


def read_zip_lines(spark: SparkSession, path: str, field: str | None = None, wanted: list[str] | None = None) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipLines)
    reader = spark.read.format("zip_lines").option("path", path)
    if wanted is not None:
        reader = reader.option("wanted", json.dumps(wanted)).option("field", field or "id")
    return reader.load()


# ---------------------------------------------------------------- one JSON object


class Range(InputPartition):
    def __init__(self, start: int, end: int, inside: int = 0, depth: int = 0) -> None:
        self.start, self.end, self.inside, self.depth = start, end, inside, depth


def quotes(data: np.ndarray, before: int) -> np.ndarray:
    """Which bytes are quotes that open or close a string; `before` backslashes stand in front of the data."""
    slash = data == 0x5C
    at = np.arange(len(data))
    last = np.maximum.accumulate(np.where(slash, -1, at))  # the last byte that is no backslash
    run = np.concatenate([[before], np.where(slash, at - last + np.where(last < 0, before, 0), 0)[:-1]]) if len(data) else at
    return (data == 0x22) & (run % 2 == 0)


def marks(data: np.ndarray, before: int, inside: int, depth: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(which bytes stand outside of strings, depth after each byte, whether the end is in a string, depth there)."""
    parity = (np.cumsum(quotes(data, before)) + inside) % 2
    outside = parity == 0
    step = np.where(outside, ((data == 0x7B) | (data == 0x5B)).astype(np.int64) - ((data == 0x7D) | (data == 0x5D)), 0)
    depths = np.cumsum(step) + depth
    return outside, depths, int(parity[-1]) if len(data) else inside, int(depths[-1]) if len(data) else depth


class _ObjectReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("range", 8 << 20))
        self.states = json.loads(options["states"]) if "states" in options else None

    def partitions(self) -> Sequence[Range]:
        store, root = _open(self.path)
        total = store.get_file_info(root).size
        starts = range(0, max(total, 1), self.size)
        states = self.states or [(0, 0)] * len(starts)
        return [Range(a, min(a + self.size, total), *s) for a, s in zip(starts, states, strict=True)]

    def _slashes(self, held: pa.NativeFile, start: int) -> int:
        """How many backslashes stand before a byte, however many."""
        n = 0
        while n < start:
            held.seek(max(0, start - n - 64))
            piece = held.read(min(64, start - n))
            own = len(piece) - len(piece.rstrip(b"\\"))
            n += own
            if own < len(piece):
                break
        return n


class _RangesReader(_ObjectReader):
    def read(self, part: Range) -> Iterator[tuple]:
        store, root = _open(self.path)
        with store.open_input_file(root) as held:
            before = self._slashes(held, part.start)
            held.seek(part.start)
            data = np.frombuffer(held.read(part.end - part.start), np.uint8)
        (_, _, odd, plain), (_, _, _, quoted) = (marks(data, before, inside, 0) for inside in (0, 1))
        yield part.start, odd, plain, quoted


class _EntriesReader(_ObjectReader):
    def read(self, part: Range) -> Iterator[tuple]:
        store, root = _open(self.path)
        with store.open_input_file(root) as held:
            before, total = self._slashes(held, part.start), held.size()
            held.seek(part.start)
            raw, end = held.read(part.end - part.start), part.end
            while True:
                data = np.frombuffer(raw, np.uint8)
                outside, depth, _, _ = marks(data, before, part.inside, part.depth)
                opens = outside & (((data == 0x2C) & (depth == 1)) | ((data == 0x7B) & (depth == 1)))
                # a brace that comes back to depth one ends a value, it opens none
                opens &= (data == 0x2C) | (np.concatenate([[part.depth], depth[:-1]]) == 0) if len(data) else opens
                closes = outside & (data == 0x7D) & (depth == 0)
                cuts = np.flatnonzero(opens | closes)
                own = [c for c in cuts if c < part.end - part.start and opens[c]]
                if not own or cuts[-1] > own[-1]:
                    break
                if end >= total:
                    raise ValueError(f"{self.path} ends inside an entry")
                more = held.read(1 << 20)
                raw, end = raw + more, end + len(more)
        after = {int(c): int(n) for c, n in zip(cuts, cuts[1:], strict=False)}
        for c in own:
            text = raw[c + 1 : after[int(c)]].decode().strip()
            if text:
                (key, value), = json.loads("{" + text + "}").items()
                yield key, json.dumps(value, ensure_ascii=False)


class JsonRanges(DataSource):
    """start, odd, plain and quoted of byte ranges: parity of quotes, change of depth if the range begins outside, or inside, of a string."""

    @classmethod
    def name(cls) -> str:
        return "json_ranges"

    def schema(self) -> str:
        return "start long, odd int, plain long, quoted long"

    def reader(self, schema) -> DataSourceReader:
        return _RangesReader(self.options)


class JsonEntries(DataSource):
    """key and value (as JSON) of the entries of an object; `states` says of each range whether it begins in a string, and how deep."""

    @classmethod
    def name(cls) -> str:
        return "json_entries"

    def schema(self) -> str:
        return "key string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _EntriesReader(self.options)


def read_json_object(spark: SparkSession, path: str, size: int = 8 << 20) -> DataFrame:
    """key and value (JSON) of every entry of one object in one file, read by a task for each `size` bytes; repeated keys stay."""
    for source in (JsonRanges, JsonEntries):
        spark.dataSource.register(source)
    facts = spark.read.format("json_ranges").option("path", path).option("range", size).load().collect()  # a row a range
    inside, depth, states = 0, 0, []
    for f in sorted(facts, key=lambda f: f["start"]):
        states.append((inside, depth))
        depth += f["quoted"] if inside else f["plain"]
        inside ^= f["odd"]
    return spark.read.format("json_entries").option("path", path).option("range", size).option("states", json.dumps(states)).load()
