"""A layout of vectors that keeps neighbours together: a fuzzy graph of nearest neighbours, drawn by attraction and repulsion.

Each point's nearest neighbours weigh exp(-(d - nearest) / bandwidth), with a bandwidth by which the
weights add up to the logarithm of how many neighbours there are; both directions are joined as
a + b - ab. Positions start on the principal axes and are moved by stochastic gradient steps in
rounds: points are dealt to blocks, a block moves its own points for some epochs against where all
others stood when the round began, then positions are written and dealt anew. Points to be repelled
from are drawn from SEEN positions that every block sees. Blocks hold PART points at most; which
ones they are changes with the round, so no edge is stale for long.

Points without a direction (null, zero, or of another width) have no place. Equal points share their
neighbours and come to lie close. The same ids, vectors and seed give the same layout.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.operators.ann import Ann, Batches
from lakelens.operators.density import Keep

PART, SEEN, REPELLED = 1 << 13, 1 << 11, 5


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b for which 1 / (1 + a d^2b) comes nearest to 1 up to min_dist and a decay by spread beyond, by damped Gauss-Newton steps."""
    x = np.linspace(1e-3, 3 * spread, 300)
    want = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p, damp = np.array([1.0, 1.0]), 1e-2
    error = lambda p: 1 / (1 + p[0] * x ** (2 * p[1])) - want
    for _ in range(200):
        y = 1 / (1 + p[0] * x ** (2 * p[1]))
        j = np.stack([-(y**2) * x ** (2 * p[1]), -(y**2) * p[0] * x ** (2 * p[1]) * 2 * np.log(x)], 1)
        step = np.linalg.solve(j.T @ j + damp * np.eye(2), -j.T @ error(p))
        better = (p + step > 0).all() and (error(p + step) ** 2).sum() < (error(p) ** 2).sum()
        p, damp = (p + step, damp / 3) if better else (p, damp * 3)
    return float(p[0]), float(p[1])


def bandwidths(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance of the nearest other point, and the bandwidth, of every row of distances (nan: no neighbour)."""
    there = ~np.isnan(d)
    near = np.nanmin(np.where(there & (d > 0), d, np.nan), axis=1, initial=np.inf, where=there & (d > 0))
    near = np.where(np.isfinite(near), near, 0.0)
    gap, want = np.maximum(d - near[:, None], 0), np.log2(np.maximum(there.sum(1), 2))
    low, high = np.zeros(len(d)), np.full(len(d), np.inf)
    s = np.ones(len(d))
    for _ in range(64):
        total = np.nansum(np.exp(-gap / s[:, None]), axis=1)
        low, high = np.where(total < want, s, low), np.where(total < want, high, s)
        s = np.where(np.isinf(high), s * 2, (low + high) / 2)
    return near, np.maximum(s, 1e-3 * np.maximum(np.nanmean(d, axis=1), 1e-12))


def fuzzy_graph(neighbours: DataFrame) -> DataFrame:
    """a, b and w, in both directions, of neighbours (a, b, d)."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            lists = batch.column("n").to_pylist()
            width = max(map(len, lists), default=0)
            d = np.full((len(lists), width), np.nan)
            for i, x in enumerate(lists):
                d[i, : len(x)] = [e["d"] for e in x]
            if not width:
                continue
            near, s = bandwidths(d)
            w = np.exp(-np.maximum(d - near[:, None], 0) / s[:, None])
            a = np.repeat(batch.column("a").to_numpy(), [len(x) for x in lists])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array([e["b"] for x in lists for e in x], pa.int64()), pa.array(w[~np.isnan(d)])], names=["a", "b", "w"])

    held = neighbours.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("d", "b"))).alias("n"))  # as many as neighbours are asked for
    one = held.mapInArrow(run, "a long, b long, w double")
    both = one.select("a", "b", "w", F.lit(0.0).alias("v")).unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0.0).alias("w"), F.col("w").alias("v")))
    return both.groupBy("a", "b").agg(F.sum("w").alias("w"), F.sum("v").alias("v")).select("a", "b", (F.col("w") + F.col("v") - F.col("w") * F.col("v")).alias("w"))


def _moved(z: np.ndarray, a: np.ndarray, b: np.ndarray, other: np.ndarray, w: np.ndarray, seen: np.ndarray, form: tuple[float, float], rates: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Positions z after an epoch for each rate; b is -1 for ends outside, which stay at `other`."""
    p, q = form
    own = b >= 0
    for rate in rates:
        on = np.flatnonzero(rng.random(len(w)) < w)
        end = np.where(own[on, None], z[b[on]], other[on])
        gap = z[a[on]] - end
        d = np.maximum((gap**2).sum(1), 1e-12)
        pull = (-2 * p * q * d ** (q - 1) / (1 + p * d**q))[:, None] * gap
        step = np.zeros_like(z)
        np.add.at(step, a[on], np.clip(pull, -4, 4))
        for _ in range(REPELLED):
            gap = z[a[on]] - seen[rng.integers(0, len(seen), len(on))]
            d = (gap**2).sum(1)
            push = (2 * q / ((0.001 + d) * (1 + p * d**q)))[:, None] * gap
            np.add.at(step, a[on], np.clip(push, -4, 4))
        z = z + rate * step
    return z


def _mover(sent: Broadcast, form: tuple[float, float], rates: np.ndarray, seed: int, turn: int) -> Callable:
    """What a block does in a round: its edges (a, b, w, za, zb) give its own points' new positions."""

    def run(key, t):  # Spark reads type hints here, and knows these without
        t = t.sort_by([("a", "ascending"), ("b", "ascending")])
        a, b = t["a"].to_numpy(), t["b"].to_numpy()
        ids, first, of = np.unique(a, return_index=True, return_inverse=True)
        za, zb = (np.array(t[c].to_pylist(), np.float64) for c in ("za", "zb"))
        place = np.minimum(np.searchsorted(ids, b), len(ids) - 1)
        z = _moved(za[first], of, np.where(ids[place] == b, place, -1), zb, t["w"].to_numpy(), sent.value, form, rates, np.random.default_rng([seed, turn, key[0].as_py()]))
        return pa.table({"id": pa.array(ids), "moved": pa.array(z.tolist(), pa.list_(pa.float64()))})

    return run


def layout(index: Ann, vectors: DataFrame, start: DataFrame, keep: Keep, neighbours: int = 15, min_dist: float = 0.1, rounds: int = 6, epochs: int = 40, rate: float = 1.0, seed: int = 7) -> DataFrame:
    """id and z of every indexed vector (id, embedding); start: id and z to begin from, as the principal axes give it."""
    spark = vectors.sparkSession
    asked = vectors.select(F.col("id").alias("query_id"), "embedding")
    found = index.search(asked, neighbours + 1).filter(F.col("query_id") != F.col(index.key))
    near = keep(found.filter(F.col("rank") <= neighbours + 1).select(F.col("query_id").cast("long").alias("a"), F.col(index.key).cast("long").alias("b"), F.greatest(F.lit(0.0), 1 - F.col("score")).alias("d")), "near")
    graph = keep(fuzzy_graph(near), "graph")
    placed = start.select(F.col("id").cast("long").alias("id"), "z").join(index.lists().select(F.col(index.key).cast("long").alias("id")), "id")
    far = placed.agg(F.max(F.array_max(F.transform("z", lambda x: F.abs(x)))).alias("far"))
    at = keep(placed.join(F.broadcast(far)).select("id", F.transform("z", lambda x: F.when(F.col("far") > 0, x / F.col("far") * 10).otherwise(F.lit(0.0))).alias("z")), "at")
    count = at.count()
    if not count:
        return at
    form, blocks = curve(min_dist), -(-count // PART)
    for turn in range(rounds):
        seen = at.orderBy(F.xxhash64("id", F.lit(turn))).limit(SEEN).select("id", "z").orderBy("id").toArrow()  # SEEN at most
        sent = spark.sparkContext.broadcast(np.array(seen["z"].to_pylist(), np.float64))
        rates = rate * (1 - (turn * epochs + np.arange(epochs)) / (rounds * epochs))

        ends = graph.join(at.select(F.col("id").alias("a"), F.col("z").alias("za")), "a").join(at.select(F.col("id").alias("b"), F.col("z").alias("zb")), "b")
        dealt = ends.withColumn("block", F.pmod(F.xxhash64("a", F.lit(turn)), F.lit(blocks)).cast("int"))
        moved = dealt.groupBy("block").applyInArrow(_mover(sent, form, rates, seed, turn), "id long, moved array<double>")
        at = keep(at.join(moved, "id", "left").select("id", F.coalesce("moved", "z").alias("z")), "at")
        sent.destroy()
    return at


def trustworthiness(x: np.ndarray, z: np.ndarray, k: int) -> float:
    """How few strangers stand among the k nearest of a layout, 1 for none; over all pairs, for samples."""
    n = len(x)
    order = lambda v: np.argsort(np.argsort(((v[:, None] - v[None]) ** 2).sum(2) + np.diag(np.full(n, -1.0)), axis=1, kind="stable"), axis=1)
    far, near = order(x), order(z)
    late = np.where((near > 0) & (near <= k), np.maximum(far - k, 0), 0).sum()
    return float(1 - late * 2 / (n * k * (2 * n - 3 * k - 1)))
