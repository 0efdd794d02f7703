"""Approximate neighbours by cosine: inverted lists with product codes, stored in a folder and probed by joins.

Vectors are dealt to cells by their nearest centroid; what is left of a vector is written as one
byte for each of a few ranges of its dimensions. A search looks into the cells nearest to a query,
ranks what they hold by codes, and compares the vectors themselves for a short list only, so that
most of the index is read as codes. Centroids and code words are learnt by rounds of k-means over a
sample of at most about ``train`` vectors; every vector is indexed. How many cells a search looks
into is measured when the index is built: as many as hold a share of ``recall`` of the true
neighbours of TRIED vectors of the sample. Vectors that spread evenly need many.

Cells are searched in groups of PART vectors, so that a query travels to a group once and a group
answers it with a short list, however many of its cells are probed; a cell of more is dealt over
parts. A group that is asked for by many queries is dealt over several tasks of ASKED queries each. A scope narrows the lists before they are ranked: as many more
cells are probed as the scope is smaller than the index, and a scope of at most ``exact`` vectors
is searched whole. Cells are probed until they hold twice as many vectors as are asked for.

Vectors that are null, of another width than most, or zero have no direction: they are neither
indexed nor asked. Ties go to the smaller id. Ids are to be unique, of the index and of the queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART, ASKED, WORDS, TRIED = 1 << 18, 1 << 13, 256, 128
#: Scores that a task works out at once.
SCORES = 1 << 21
Batches = Iterator[pa.RecordBatch]


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), width).astype(np.float32)


def directions(vectors: DataFrame, key: str, width: int) -> DataFrame:
    """key and x: vectors of the width at length one."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            x = _matrix(batch.column(1), width)
            norm = np.linalg.norm(x.astype(np.float64), axis=1)
            on = np.flatnonzero(norm > 0)
            unit = (x[on] / norm[on, None]).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, unit.size + 1, width, dtype=np.int32)), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(on)), lists], names=[key, "x"])

    whole = vectors.select(key, F.col("embedding").cast("array<float>").alias("embedding")).filter((F.size("embedding") == width) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v)))
    return whole.mapInArrow(run, f"{key} {dict(vectors.dtypes)[key]}, x array<float>")


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Number of the nearest word of every row; the first of equals."""
    return (((book**2).sum(1) / 2)[None] - x @ book.T).argmin(1)


def learn(rows: DataFrame, width: int, ranges: int, size: int, rounds: int) -> np.ndarray:
    """Code words (ranges, size, width / ranges) of the vectors x by rounds of k-means; sums of tasks are added by Spark before they leave it."""
    spark, part = rows.sparkSession, width // ranges
    # equal vectors would be one word many times
    start = _matrix(rows.groupBy(F.xxhash64("x").alias("h")).agg(F.first("x").alias("x")).orderBy("h").limit(size).select("x").toArrow()["x"], width)
    books = start.reshape(len(start), ranges, part).transpose(1, 0, 2).copy()
    size = len(start)

    def summed(sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=["sums", "counts"])

    def add(batches: Batches) -> Batches:
        sums, counts = np.zeros((ranges, size, part)), np.zeros((ranges, size))
        for batch in batches:
            for s, c in zip(batch.column(0), batch.column(1), strict=True):
                sums += np.frombuffer(s.as_buffer()).reshape(sums.shape)
                counts += np.frombuffer(c.as_buffer()).reshape(counts.shape)
        yield summed(sums, counts)

    for _ in range(rounds if size else 0):
        sent = spark.sparkContext.broadcast(books)

        def run(batches: Batches, sent=sent) -> Batches:
            sums, counts = np.zeros((ranges, size, part)), np.zeros((ranges, size))
            for batch in batches:
                x = _matrix(batch.column(0), width).reshape(-1, ranges, part)
                for r in range(ranges):
                    at = _nearest(x[:, r], sent.value[r])
                    np.add.at(sums[r], at, x[:, r])
                    counts[r] += np.bincount(at, minlength=size)
            yield summed(sums, counts)

        schema = "sums binary, counts binary"
        got = rows.select("x").mapInArrow(run, schema).repartition(4).mapInArrow(add, schema).collect()  # four rows
        sums, counts = (sum(np.frombuffer(r[c]) for r in got) for c in ("sums", "counts"))
        sums, counts = sums.reshape(ranges, size, part), counts.reshape(ranges, size)
        books = np.where(counts[..., None] > 0, sums / np.maximum(counts, 1)[..., None], books).astype(np.float32)
        sent.destroy()
    return books


def _groups(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The group of every cell, of at most `most` vectors, and how many parts its group has: several if it is one cell of more."""
    group, parts, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0
    at = 0
    for c, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            at, held = at + 1, 0
        group[c], parts[c], held = at, max(1, -(-n // most)), held + n
    return group, parts


def _short(q: np.ndarray, probed: np.ndarray, codes: np.ndarray, cell: np.ndarray, centroids: np.ndarray, words: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score) of the `take` codes of best score of every query, among the cells that it probes (queries x cells); codes are sorted by cell."""
    n, held_s, held_at = len(q), np.full((len(q), take), -np.inf, np.float32), np.zeros((len(q), take), np.int64)
    tables = [q.reshape(n, len(words), -1)[:, r] @ book.T for r, book in enumerate(words)]
    start = q @ centroids.T
    wanted = np.flatnonzero(probed.any(0)[cell])  # codes of cells that any of these queries probes
    step = max(1, SCORES // n)
    for first in range(0, len(wanted), step):
        some = wanted[first : first + step]
        score = start[:, cell[some]]
        for r, table in enumerate(tables):
            score += table[:, codes[some, r]]
        score = np.concatenate([held_s, np.where(probed[:, cell[some]], score, -np.inf)], 1)
        top = np.argpartition(-score, take - 1, axis=1)[:, :take]
        held_at = np.take_along_axis(np.concatenate([held_at, np.broadcast_to(some, (n, len(some)))], 1), top, 1)
        held_s = np.take_along_axis(score, top, 1)
    row, col = np.nonzero(held_s > -np.inf)
    return row, held_at[row, col], held_s[row, col]


_HEAD = "key string, kind string, width int, count long, probes int, cells array<int>, centroids binary, ranges array<int>, words binary"


@dataclass(frozen=True)
class Ann:
    """An index in a folder: `lists` (bucket, cell, key, code, x) and `head`, one row with what is in memory, of a fixed size."""

    path: str
    key: str
    kind: str
    width: int
    count: int
    centroids: np.ndarray
    words: np.ndarray
    probes: int = 1

    def save(self) -> None:
        row = (self.key, self.kind, self.width, self.count, self.probes, list(self.centroids.shape), self.centroids.tobytes(), list(self.words.shape), self.words.tobytes())
        SparkSession.active().createDataFrame([row], _HEAD).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/head")

    def lists(self) -> DataFrame:
        schema = f"bucket int, cell int, {self.key} {self.kind}, code binary, x array<float>"
        return SparkSession.active().read.schema(schema).parquet(f"{self.path}/lists")

    def _probed(self, queries: DataFrame, probes: int, sizes: np.ndarray, least: int, group: np.ndarray) -> DataFrame:
        """query_id, grp, cells and q: the nearest cells, `probes` of them or as many as hold `least` vectors, a row a group of them; empty ones are left out."""
        sent = queries.sparkSession.sparkContext.broadcast((self.centroids, sizes, group))
        width = self.width

        def run(batches: Batches) -> Batches:
            centroids, sizes, group = sent.value
            for whole in batches:
                step = max(1, SCORES // len(centroids))
                for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                    q = _matrix(batch.column(1), width)
                    order = np.argsort(((centroids**2).sum(1) / 2)[None] - q @ centroids.T, axis=1, kind="stable")
                    before = np.cumsum(sizes[order], axis=1) - sizes[order]
                    owner, place = np.nonzero(((np.arange(order.shape[1]) < probes) | (before < least)) & (sizes[order] > 0))
                    cell = order[owner, place]
                    by = np.lexsort((group[cell], owner))  # the cells of a query and group stand together, nearest first
                    owner, cell = owner[by], cell[by]
                    first = np.flatnonzero(np.diff(owner, prepend=-1) | np.diff(group[cell], prepend=-1)) if len(cell) else np.empty(0, np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(cell)).astype(np.int32)), pa.array(cell.astype(np.int32)))
                    at = pa.array(owner[first])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(group[cell[first]].astype(np.int32)), lists, batch.column(1).take(at)], names=["query_id", "grp", "cells", "q"])

        return queries.mapInArrow(run, f"query_id {dict(queries.dtypes)['query_id']}, grp int, cells array<int>, q array<float>")

    def search(self, queries: DataFrame, k: int, scope: DataFrame | None = None, probes: int | None = None, short: int = 8, exact: int = 1 << 12) -> DataFrame:
        """query_id, key, score (cosine) and rank of the k nearest of every query (query_id, embedding)."""
        asked = directions(queries, "query_id", self.width).withColumnRenamed("x", "q")
        if not self.count:
            return asked.limit(0).select("query_id", F.lit(None).cast(self.kind).alias(self.key), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        rows, probes = self.lists(), probes or self.probes
        if scope is not None:
            rows = rows.join(scope.select(self.key).distinct(), self.key, "left_semi")
        sizes = np.zeros(len(self.centroids), np.int64)
        for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a cell
            sizes[r["cell"]] = r["n"]
        inside = int(sizes.sum())
        if inside < self.count:
            probes = len(sizes) if inside <= exact else min(len(sizes), -(-probes * self.count // inside))
        group, parts = _groups(sizes, PART)
        near = self._probed(asked, probes, sizes, 2 * k, group)
        # how many vectors a group holds and how many ask for it decides over how many tasks it is dealt
        held = queries.sparkSession.createDataFrame([(i, int(group[i]), int(parts[i])) for i, n in enumerate(sizes) if n], "cell int, grp int, parts int")
        wanted = near.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / F.lit(ASKED)).cast("int").alias("turns"))
        cells = F.broadcast(held.join(wanted, "grp"))  # a row a cell
        groups = F.broadcast(held.groupBy("grp").agg(F.max("parts").alias("parts")).join(wanted, "grp"))
        of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        left = near.join(groups, "grp").select("query_id", "grp", "cells", "q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), of("query_id", "turns").alias("turn"))
        right = rows.select(self.key, "cell", "code").join(cells, "cell").select(self.key, "grp", "cell", "code", of(self.key, "parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))
        sent = queries.sparkSession.sparkContext.broadcast((self.centroids, self.words))
        width, key, take = self.width, self.key, k * short
        q_kind = dict(queries.dtypes)["query_id"]

        def rank(asks: pa.Table, lists: pa.Table) -> pa.Table:
            centroids, words = sent.value
            out = [pa.table({"query_id": asks["query_id"].slice(0, 0), key: lists[key].slice(0, 0), "near": pa.array([], pa.float32())})]
            if len(asks) and len(lists):
                lists = lists.sort_by("cell")
                codes = np.frombuffer(b"".join(lists["code"].to_pylist()), np.uint8).reshape(len(lists), len(words))
                own, cell = np.unique(lists["cell"].to_numpy(), return_inverse=True)
                asks = asks.take(pa.array(np.argsort([c[0] for c in asks["cells"].to_pylist()], kind="stable")))  # queries alike stand together
                for at in range(0, len(asks), 256):
                    some = asks.slice(at, 256)
                    probed = np.zeros((len(some), len(centroids)), bool)
                    asked = some["cells"].combine_chunks()
                    probed[np.repeat(np.arange(len(some)), np.asarray(asked.value_lengths())), np.asarray(asked.flatten())] = True
                    row, place, score = _short(_matrix(some["q"], width), probed[:, own], codes, cell, centroids[own], words, take)
                    out.append(pa.table({"query_id": some["query_id"].take(pa.array(row)), key: lists[key].take(pa.array(place)), "near": pa.array(score)}))
            return pa.concat_tables(out)

        by = ("grp", "part", "turn")
        ranked = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(rank, f"query_id {q_kind}, {key} {self.kind}, near float")
        turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), key))
        few = ranked.withColumn("turn", turn).filter(F.col("turn") <= take).select("query_id", key)  # k * short a query
        dot = F.aggregate(F.zip_with("q", "x", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
        scored = few.join(self.lists().select(key, "x"), key).join(asked, "query_id").select("query_id", key, F.round(dot, 6).alias("score"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
        return scored.withColumn("rank", place).filter(F.col("rank") <= k)

    def nearest(self, query: list[float], k: int, scope: DataFrame | None = None) -> DataFrame:
        """key, score and rank of the k nearest of one query."""
        one = SparkSession.active().createDataFrame([(0, [float(x) for x in query])], "query_id int, embedding array<float>")
        return self.search(one, k, scope).drop("query_id")


def build(vectors: DataFrame, key: str, path: str, cells: int | None = None, ranges: int = 16, train: int = 1 << 16, rounds: int = 8, buckets: int = 16, recall: float = 0.97) -> Ann:
    """Writes the index of vectors (key, embedding) to a folder; by default as many cells as the root of the count, 4,096 at most."""
    spark = vectors.sparkSession
    top = vectors.filter("embedding is not null").groupBy(F.size("embedding").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").first()
    width, count = (top["w"], top["n"]) if top else (0, 0)
    kind = dict(vectors.dtypes)[key]
    if not width:
        spark.createDataFrame([], f"bucket int, cell int, {key} {kind}, code binary, x array<float>").write.mode("overwrite").parquet(f"{path}/lists")
        empty = Ann(path, key, kind, 0, 0, np.zeros((0, 0), np.float32), np.zeros((0, 0, 0), np.float32))
        empty.save()
        return empty
    while width % ranges:
        ranges -= 1
    unit = directions(vectors, key, width)
    share = min(1.0, train / max(count, 1))
    directions(vectors.filter(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))), key, width).write.mode("overwrite").parquet(f"{path}/sample")
    sample = spark.read.parquet(f"{path}/sample")
    centroids = learn(sample, width, 1, cells or int(min(4096, max(1, count**0.5))), rounds)[0]
    sent = spark.sparkContext.broadcast(centroids)

    def rests(batches: Batches) -> Batches:
        for batch in batches:
            x = _matrix(batch.column(0), width)
            rest = x - sent.value[_nearest(x, sent.value)]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, rest.size + 1, width, dtype=np.int32)), pa.array(rest.ravel()))], names=["x"])

    words = learn(sample.select("x").mapInArrow(rests, "x array<float>"), width, ranges, WORDS, rounds)
    both = spark.sparkContext.broadcast((centroids, words))

    def coded(batches: Batches) -> Batches:
        centroids, words = both.value
        for batch in batches:
            x = _matrix(batch.column(1), width)
            cell = _nearest(x, centroids)
            rest = (x - centroids[cell]).reshape(len(x), len(words), -1)
            codes = np.stack([_nearest(rest[:, r], b) for r, b in enumerate(words)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array((cell % buckets).astype(np.int32)), pa.array(cell.astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1)], names=["bucket", "cell", key, "code", "x"])

    dealt = unit.mapInArrow(coded, f"bucket int, cell int, {key} {kind}, code binary, x array<float>")
    dealt.repartition(buckets * 4, "bucket", F.pmod(F.xxhash64(key), F.lit(4))).sortWithinPartitions("bucket", "cell", key).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/lists")
    index = Ann(path, key, kind, width, count, centroids, words)
    index = replace(index, count=index.lists().count())  # those that have a direction
    index = replace(index, probes=_probes(index, sample, recall))
    index.save()  # last: an index without its head is not finished
    return index


def _probes(index: Ann, sample: DataFrame, share: float) -> int:
    """How many cells hold that share of the ten true neighbours of TRIED vectors."""
    tried = sample.orderBy(F.xxhash64(index.key, F.lit(2))).limit(TRIED).select(F.col(index.key).alias("query_id"), F.col("x").alias("embedding"))
    found = index.search(tried, 10, probes=len(index.centroids), short=32).select("query_id", index.key)
    cells = found.join(index.lists().select(index.key, "cell"), index.key).join(tried, "query_id").select("cell", "embedding").toArrow()  # ten rows for each
    if not len(cells):
        return 1
    q = _matrix(cells["embedding"], index.width)
    order = np.argsort(((index.centroids**2).sum(1) / 2)[None] - q @ index.centroids.T, axis=1, kind="stable")
    place = (order == np.asarray(cells["cell"])[:, None]).argmax(1)
    return int(np.sort(place)[min(len(place) - 1, int(len(place) * share))]) + 1


def load(path: str) -> Ann:
    """An index as it was written."""
    r = SparkSession.active().read.schema(_HEAD).parquet(f"{path}/head").first()
    books = [np.frombuffer(r[x], np.float32).reshape(r[n]) for x, n in (("centroids", "cells"), ("words", "ranges"))]
    return Ann(path, r["key"], r["kind"], r["width"], r["count"], *books, r["probes"])


def recall(found: DataFrame, exact: DataFrame, key: str) -> float:
    """The share of the exact (query_id, key) pairs that are found."""
    pairs = exact.select("query_id", key).distinct()
    n, hit = pairs.count(), pairs.join(found.select("query_id", key).distinct(), ["query_id", key]).count()
    return hit / n if n else 1.0
