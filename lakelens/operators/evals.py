"""Evaluation of rankings, batches of nearest neighbours, embedding upkeep."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of the queries of one block, which is sent to all tasks (16 MB); scores that a task works out at once (8 MB).
BLOCK, SCORES = 1 << 21, 1 << 20


def scores(ranked: DataFrame, expected: DataFrame, k: int, paper: Column) -> DataFrame:
    """question, config, type and recall, ndcg, mrr, paper_recall at k, for questions with expected chunks.

    ranked: question, config, type, chunk, rank; expected: question, chunk; `paper` is a chunk's paper.
    """
    wanted = expected.select("question", "chunk").distinct()
    n = wanted.groupBy("question").agg(F.count(F.lit(1)).alias("n"))
    papers = wanted.select("question", paper.alias("paper")).distinct().withColumn("of_paper", F.lit(1.0))
    top = ranked.withColumn("paper", paper).join(n, "question")
    top = top.join(wanted.withColumn("found", F.lit(True)), ["question", "chunk"], "left").join(papers, ["question", "paper"], "left")
    inside = F.col("rank") <= k
    hit = F.col("found") & inside
    gain = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda x, i: x + F.lit(1.0) / F.log2(i + F.lit(1.0)))
    out = top.groupBy("question", "config", "type", "n").agg(
        (F.count_distinct(F.when(hit, F.col("chunk")))).alias("hits"),
        F.coalesce(F.sum(F.when(hit, F.lit(1.0) / F.log2(F.col("rank") + F.lit(1.0)))), F.lit(0.0)).alias("dcg"),
        F.coalesce(F.lit(1.0) / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.max(F.when(inside, F.col("of_paper"))), F.lit(0.0)).alias("paper_recall"),
    )
    return out.select("question", "config", "type", (F.col("hits") / F.col("n")).alias("recall"), (F.col("dcg") / gain).alias("ndcg"), "mrr", "paper_recall")


def means(each: DataFrame) -> DataFrame:
    """Means of the metrics by configuration, over all questions and by type."""
    metrics = ["recall", "ndcg", "mrr", "paper_recall"]
    rows = each.withColumn("type", F.explode(F.array(F.lit("all"), "type")))
    return rows.groupBy("config", "type").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in metrics])


def bootstrap(each: DataFrame, metric: str, draws: int = 4000, seed: int = 7) -> DataFrame:
    """config, low, mean and high: 2.5 and 97.5 percent of the means of resamples.

    A question's weight in a draw is a Poisson number of a hash, so resamples need no sort, no join and no common list:
    each task adds up its own questions for all draws.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for config, value, h in zip(batch.column("config").to_pylist(), batch.column("v").to_pylist(), batch.column("h").to_pylist(), strict=True):
                w = np.random.default_rng(h).poisson(1.0, draws)
                had = sums.setdefault(config, [np.zeros(draws), np.zeros(draws)])
                had[0] += w * value
                had[1] += w
        for config, (total, weight) in sums.items():
            yield pa.RecordBatch.from_pydict({"config": pa.array([config] * draws, pa.string()), "draw": pa.array(range(draws), pa.int32()), "total": pa.array(total), "weight": pa.array(weight)})

    rows = each.select("config", F.col(metric).alias("v"), F.abs(F.xxhash64("question", F.lit(seed))).alias("h"))
    drawn = rows.mapInArrow(run, "config string, draw int, total double, weight double").groupBy("config", "draw").agg(F.try_divide(F.sum("total"), F.sum("weight")).alias("mean"))
    return drawn.groupBy("config").agg(F.expr("percentile(mean, 0.025)").alias("low"), F.avg("mean").alias("mean"), F.expr("percentile(mean, 0.975)").alias("high"))


def rank_of(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """The place of each expected chunk, null where it was not found."""
    places = ranked.groupBy("question", "chunk").agg(F.min("rank").alias("place"))
    return expected.join(places, ["question", "chunk"], "left").select("question", "chunk", "place")


def grades(ranked: DataFrame, expected: DataFrame, paper: Column) -> DataFrame:
    """2 for an expected chunk, 1 for another of an expected paper, else 0."""
    wanted = expected.select("question", "chunk").distinct().withColumn("exact", F.lit(True))
    papers = expected.select("question", paper.alias("paper")).distinct().withColumn("near", F.lit(True))
    out = ranked.withColumn("paper", paper).join(wanted, ["question", "chunk"], "left").join(papers, ["question", "paper"], "left")
    return out.withColumn("grade", F.when(F.col("exact"), 2).when(F.col("near"), 1).otherwise(0))


def at_depths(ranked: DataFrame, depths: list[int]) -> DataFrame:
    """The ranking cut at several depths."""
    return ranked.withColumn("depth", F.explode(F.array(*[F.lit(x) for x in depths]))).filter("rank <= depth")


def _merge(best_s: np.ndarray, best_v: np.ndarray, s: np.ndarray, v: np.ndarray) -> None:
    """Puts the scores of every query (a row) for some vectors among its best, in place; only those that reach the last of them are sorted."""
    k = best_s.shape[1]
    i, j = np.nonzero(s >= best_s[:, -1:])
    if not len(i):
        return
    rows = np.unique(i)
    who = np.concatenate([np.repeat(rows, k), i])
    score, vec = np.concatenate([best_s[rows].ravel(), s[i, j]]), np.concatenate([best_v[rows].ravel(), v[j]])
    order = np.lexsort((vec, -score, who))
    first = np.searchsorted(who[order], rows)[:, None] + np.arange(k)
    best_s[rows], best_v[rows] = score[order][first], vec[order][first]


def knn_batch(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score and rank: the k nearest of every query among all vectors, exactly.

    Queries are taken in blocks of a bounded number of values, sent to all tasks; a task keeps k rows a query of its own
    vectors by matrix products of a bounded size, and those are merged by rank. Scores are cosines, rounded to six digits; ties go to the
    smaller id. Rows without a vector or of another length than the queries' are left out.
    """
    spark = vectors.sparkSession
    rows = queries.filter("embedding is not null").select("vec_id", "embedding")
    width, count = rows.agg(F.max(F.size("embedding")), F.count(F.lit(1))).first()
    out = spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    if not count:
        return out
    blocks = -(-count * width // BLOCK)
    parts = []
    for b in range(blocks):
        held = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        ids = held["vec_id"].to_numpy()
        q = np.array(held["embedding"].to_pylist(), np.float64).reshape(len(ids), width)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        sent = spark.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            best_s, best_v = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            step = max(1, SCORES // max(1, len(ids)))
            for batch in batches:
                column = batch.column("embedding")
                on = np.flatnonzero(np.asarray(column.value_lengths().fill_null(-1)) == width)
                for at in range(0, len(on), step):
                    some = pa.array(on[at : at + step])
                    x = column.take(some).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), width)
                    norm = np.linalg.norm(x, axis=1)
                    s = np.round(q @ x.T / np.where(norm > 0, norm, np.inf), 6)
                    _merge(best_s, best_v, s, batch.column("vec_id").take(some).to_numpy().astype(np.int64))
            row, place = np.nonzero(best_s > -np.inf)
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[row]), "vec_id": pa.array(best_v[row, place]), "score": pa.array(best_s[row, place])})

        parts.append(vectors.select("vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, score double"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hash_embedding(rows: DataFrame, key: str, dims: int) -> DataFrame:
    """key, dim and x, the numbers that are not zero: token counts (column tokens) dealt to `dims` by hash, at length one. It needs no model."""
    token = rows.select(key, F.explode("tokens").alias("t"))
    counts = token.groupBy(key, (F.conv(F.substring(F.md5("t"), 1, 4), 16, 10).cast("int") % dims).alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    norm = F.sqrt(F.sum((F.col("n") * F.col("n")).cast("double")).over(Window.partitionBy(key)))  # `dims` rows a key at most
    return counts.select(key, "dim", F.round(F.col("n") / norm, 6).alias("x"))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def vector_state(stored: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Of every stored vector whether its text is the same ('kept'), 'changed' or 'gone'."""
    now = chunks.select(key, content_hash(F.col("text")).alias("now"))
    state = F.when(F.col("now").isNull(), "gone").when(F.col("now") == F.col("hash"), "kept").otherwise("changed")
    return stored.join(now, key, "left").select(key, state.alias("state"))


def embedding_plan(chunks: DataFrame, done: DataFrame, key: str, usd_per_million: float) -> DataFrame:
    """How many chunks have no vector yet, their tokens, and what these would cost."""
    todo = chunks.join(done.select(key), key, "left_anti")
    tokens = F.coalesce(F.sum("n_tokens"), F.lit(0))
    return todo.agg(F.count(F.lit(1)).alias("n_chunks"), tokens.cast("long").alias("n_tokens"), F.round(tokens * F.lit(usd_per_million) / 1_000_000, 9).alias("usd"))
