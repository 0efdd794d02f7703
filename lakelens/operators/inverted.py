"""Positional inverted index: posting lists by term in blocks, written once, of which a search reads the buckets of its own terms.

A block is what one portion of rows holds of a term: the rows' keys in order, their lengths and the
places of the term in each. Portions are inverted where they are read; then blocks travel to the
bucket of their term, never tokens as rows. A frequent term is many blocks, which ``spread`` deals
over several parts of its bucket; Spark cuts parts that are large and joins small ones, so that what a
task sorts and writes does not grow with the table. A phrase is matched by intersecting places moved
back by each word's turn, so texts are not read again.

Rows without tokens count in the statistics (their length is zero) and are in no list; null texts
have no tokens. A key that stands in several rows counts for each of them in the statistics and is
not told apart in a search: keys are to be unique. An empty table gives an index that finds nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.operators import lexical as L

#: Tokens that are inverted at once; a longer row comes alone.
PORTION = 1 << 19


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def _lists(values: np.ndarray | pa.Array, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def _blocks(batch: pa.RecordBatch, buckets: int, block: int) -> pa.RecordBatch:
    """Posting lists of a portion of rows (key, tokens), a row a term; the term '' lists all rows."""
    keys, tokens = batch.column(0), batch.column(1)
    n = np.asarray(tokens.value_lengths().fill_null(0)).astype(np.int64)
    words = tokens.flatten().dictionary_encode()
    codes = np.asarray(words.indices).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n)
    order = np.argsort(codes, kind="stable")  # places stay in order
    codes, row, place = codes[order], row[order], place[order]
    lists = np.flatnonzero(np.diff(codes, prepend=-1) | np.diff(row, prepend=-1)) if len(codes) else np.empty(0, np.int64)
    terms = np.flatnonzero(np.diff(codes[lists], prepend=-1)) if len(lists) else np.empty(0, np.int64)
    names = words.dictionary.take(pa.array(codes[lists][terms])).to_pylist() + [""]
    held = np.concatenate([row[lists], np.arange(len(n))])
    starts = np.concatenate([terms, [len(lists), len(held)]])
    places = _lists(place.astype(np.int32), np.concatenate([lists, np.full(len(n) + 1, len(place))]))
    columns = [pa.array(names), pa.array([bucket_of(t, buckets) for t in names], pa.int32()), pa.array(np.full(len(names), block)), _lists(keys.take(pa.array(held)), starts), _lists(n[held].astype(np.int32), starts), _lists(places, starts)]
    return pa.RecordBatch.from_arrays(columns, names=["term", "bucket", "block", "keys", "lengths", "places"])


def _portions(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(np.asarray(batch.column(1).value_lengths().fill_null(0)).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _schema(kind: str) -> str:
    return f"term string, bucket int, block long, keys array<{kind}>, lengths array<int>, places array<array<int>>"


@dataclass(frozen=True)
class Index:
    """An index in a folder: `postings`, in one folder a bucket, and `stats`, one row."""

    path: str
    key: str
    kind: str
    tokenizer: str
    buckets: int

    def _read(self, spark: SparkSession, what: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{self.path}/{what}")

    def postings(self, terms: list[str]) -> DataFrame:
        """The blocks of some terms; the filter on the bucket prunes folders, that on the term row groups."""
        spark = SparkSession.active()
        rows = self._read(spark, "postings", _schema(self.kind))
        wanted = sorted({bucket_of(t, self.buckets) for t in terms})
        return rows.filter(F.col("bucket").isin(wanted) & F.col("term").isin(sorted(set(terms))))

    def stats(self) -> DataFrame:
        return self._read(SparkSession.active(), "stats", "n_docs long, n_tokens long")

    def counts(self, phrases: list[list[str]]) -> tuple[DataFrame, DataFrame]:
        """(key, n and f0, f1, ..: how often each phrase occurs, for rows that hold any of their words; n_docs and mean)."""
        if not phrases:  # nothing is asked, nothing is read
            return self.stats().limit(0).select(F.lit(None).cast(self.kind).alias(self.key), F.lit(0.0).alias("n")), self.stats()
        words = sorted({w for p in phrases for w in p})
        at = {w: f"p{i}" for i, w in enumerate(words)}
        each = self.postings(words).select("term", F.explode(F.arrays_zip("keys", "lengths", "places")).alias("x"))
        each = each.select("term", F.col("x.keys").alias(self.key), F.col("x.lengths").cast("double").alias("n"), F.col("x.places").alias("places"))
        rows = each.groupBy(self.key, "n").agg(*[F.max(F.when(F.col("term") == w, F.col("places"))).alias(c) for w, c in at.items()])

        def moved(places: str, turn: int) -> Column:
            return F.transform(places, lambda x: x - turn)

        def occurrences(phrase: list[str]) -> Column:
            start = F.col(at[phrase[0]])
            for turn, w in enumerate(phrase[1:], 1):
                start = F.array_intersect(start, moved(at[w], turn))
            return F.coalesce(F.size(start), F.lit(0))

        f = [F.greatest(occurrences(p), F.lit(0)).alias(f"f{i}") for i, p in enumerate(phrases)]
        return rows.select(self.key, "n", *f), self.stats().select("n_docs", F.try_divide("n_tokens", "n_docs").alias("mean"))

    def terms(self) -> DataFrame:
        """term, how many rows hold it, how often it occurs, and in how many blocks: from the heads of all lists."""
        rows = self._read(SparkSession.active(), "postings", _schema(self.kind)).filter("term <> ''")
        n = F.aggregate("places", F.lit(0).cast("long"), lambda s, x: s + F.size(x))
        return rows.groupBy("term").agg(F.sum(F.size("keys")).alias("n_docs"), F.sum(n).alias("n_times"), F.count(F.lit(1)).alias("n_blocks"))


def build(rows: DataFrame, key: str, *texts: str, path: str, tokenizer: str = "plain", buckets: int = 16, spread: int = 16) -> Index:
    """Writes the index of rows to a folder. About a bucket a GB of text is meant; at least `spread` parts of a large bucket share its frequent terms."""
    tokens = L.token_index(rows, key, *texts, tokenizer=tokenizer).select(key, "tokens")
    kind = dict(tokens.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in _portions(batch, PORTION):
                yield _blocks(part, buckets, block)
                block += 1

    blocks = tokens.mapInArrow(run, _schema(kind))
    blocks = blocks.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(spread)))
    dealt = blocks.hint("rebalance", "bucket", "part").drop("part").sortWithinPartitions("bucket", "term", "block")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    index = Index(path, key, kind, tokenizer, buckets)
    whole = index.postings([""])
    stats = whole.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)).cast("long").alias("n_docs"), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0)).alias("n_tokens"))
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")  # last: an index without it is not finished
    return index
