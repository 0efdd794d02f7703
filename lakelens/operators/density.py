"""Clusters by a hierarchy of densities: mutual reachability, its minimum spanning tree, the condensed tree, stability.

Points are dealt to cells by k-means; a cell has a centre, a radius and the largest core distance of
its points, which bound what it can hold for a point outside, so that whole cells are passed over.

* The core distance of a point is that to its ``samples``-th nearest point, itself included. Its own
  group of cells bounds it from above; then only groups that reach within that bound are visited. Each
  point keeps its NEAR nearest points, or ``samples`` if that is more.
* The tree is grown by rounds of Boruvka: each component but the largest, which the others come to,
  takes its shortest edge outwards. The shortest one to a kept neighbour bounds it from above; only points
  whose other edges, no shorter than their farthest kept neighbour is away, may reach that bound ask again,
  in groups that reach within it. Where no kept neighbour is outside, a bound comes from the centres; cells that
  are wholly of the point's component are passed over. Edges are ordered by (length, smaller id,
  larger id), so that equal lengths make no cycle and the result does not depend on the dealing.
* The hierarchy is cut from the top, HEAVY of the longest edges at a time: they are undone in memory,
  over the pieces that the shorter edges leave together, which Spark joins and counts. Pieces of
  fewer than ``size`` points are done; larger ones are cut in the next turn. So memory is bounded by
  HEAVY, and turns grow with the points that fall out of large clusters one by one.

Cells near each other form groups of about PART points, larger cells are dealt over parts of so many; askers of a group come
in turns of PART, and a turn against a part is worked out by matrix products: what may be within a point's bound is then
measured exactly. On points that spread evenly in many dimensions that is a product of all with all, once. Points are to have unique ids and coordinates
of one length without nulls; with fewer than ``size`` points all are noise. Equal points have
distance zero, and their cluster has no finite density: such edges count as TINY long.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakelens.operators.ann import Batches, _matrix, learn

NOISE, HEAVY, PART, TINY = -1, 1 << 18, 1 << 14, 1e-12
#: Neighbours that a point keeps.
NEAR = 8
Keep = Callable[[DataFrame, str], DataFrame]


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of two matrices, exact for equal rows."""
    return np.sqrt(((a[:, None].astype(np.float64) - b[None]) ** 2).sum(2))


def _slices(n: int, m: int, width: int) -> list[slice]:
    step = max(1, (1 << 22) // max(1, m * width))
    return [slice(i, i + step) for i in range(0, n, step)]


def _within(a: np.ndarray, b: np.ndarray, most: np.ndarray, other: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of all rows of a and b that are at most most[i] apart, and a few more; with `other` only where these differ.

    A product of matrices says which may be, these are measured as by `_gaps`. All of a row come at once, about 2**18 pairs in all.
    """
    a, b = a.astype(np.float64), b.astype(np.float64)
    own, far = (a * a).sum(1), (b * b).sum(1)
    left, right = np.column_stack([-2 * a, np.ones(len(a))]), np.column_stack([b, far]).T.copy()
    limit = most * most * (1 + 1e-9) + 1e-11 * (own + far.max(initial=0)) - own
    for s in _slices(len(a), len(b), 1):
        on = left[s] @ right <= limit[s][:, None]
        if other is not None:
            on &= other[0][s][:, None] != other[1][None]
        i, j = np.nonzero(on)
        start = 0
        while start < len(i):
            end = len(i) if len(i) - start <= 1 << 18 else int(np.searchsorted(i, i[start + (1 << 18)], "left"))
            end = end if end > start else int(np.searchsorted(i, i[start], "right"))
            p, q = i[start:end] + s.start, j[start:end]
            yield p, q, np.sqrt(((a[p] - b[q]) ** 2).sum(1))
            start = end


class Cells:
    """Points (id, x) in cells, written once; `centres` in memory, as many as the root of the points, 1,024 at most."""

    def __init__(self, points: DataFrame, keep: Keep) -> None:
        self.keep, self.spark = keep, points.sparkSession
        rows = keep(points.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<float>").alias("x")), "points")
        self.count, width = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
        self.width = width or 1
        self.centres = learn(rows, self.width, 1, int(min(1024, max(1, self.count**0.5))), 4)[0] if self.count else np.zeros((0, 1), np.float32)
        sent, width = self.spark.sparkContext.broadcast(self.centres), self.width

        def run(batches: Batches) -> Batches:
            for batch in batches:
                x = _matrix(batch.column(1), width)
                at, far = [], []
                for s in _slices(len(x), len(sent.value), width):
                    gaps = _gaps(x[s], sent.value)
                    at.append(gaps.argmin(1))
                    far.append(gaps.min(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(far))], names=["id", "x", "cell", "off"])

        self.rows = keep(rows.mapInArrow(run, "id long, x array<float>, cell int, off double"), "cells")
        self.radius, held = np.full(len(self.centres), -np.inf), np.zeros(len(self.centres), np.int64)
        for r in self.rows.groupBy("cell").agg(F.max("off").alias("radius"), F.count(F.lit(1)).alias("n")).collect():  # a row a cell
            self.radius[r["cell"]], held[r["cell"]] = r["radius"], r["n"]
        self._group(held)

    def _group(self, held: np.ndarray) -> None:
        """Cells in groups of about PART points: the nearest cells of the first that is left, then of the next; `parts` by group."""
        self.group, parts, free = np.full(len(held), -1, np.int64), [], held > 0
        for first in np.argsort(self.centres[:, 0], kind="stable"):
            if not free[first]:
                continue
            near = np.flatnonzero(free)
            near = near[np.argsort(_gaps(self.centres[first : first + 1], self.centres[near])[0], kind="stable")]
            taken = near[: max(1, int(np.searchsorted(np.cumsum(held[near]), PART, "right")))]
            self.group[taken], free[taken] = len(parts), False
            parts.append(-(-int(held[taken].sum()) // PART))
        self.parts = np.array(parts, np.int64)

    def visits(self, points: DataFrame, bound: str, component: str, only: np.ndarray | None = None) -> DataFrame:
        """The columns of points (with x) and the groups that may hold a point nearer than the bound; `only`: of which component a cell wholly is, or -1."""
        only = np.full(len(self.centres), -1) if only is None else only
        sent, width, names = self.spark.sparkContext.broadcast((self.centres, self.radius, self.group, self.parts, only)), self.width, points.columns
        schema = ", ".join(f"`{n}` {t}" for n, t in points.dtypes) + ", group int, part int"

        def run(batches: Batches) -> Batches:
            centres, radius, group, parts, only = sent.value
            order = np.argsort(group, kind="stable")
            order = order[group[order] >= 0]  # cells that hold points
            first = np.searchsorted(group[order], np.arange(len(parts)))
            for batch in batches:
                x, most = _matrix(batch.column("x"), width), np.asarray(batch.column(bound))
                mine = np.asarray(batch.column(component))
                for s in _slices(len(x), len(centres), width):
                    near = (_gaps(x[s], centres) - radius * (1 + 1e-6) - 1e-6 <= most[s][:, None]) & (only[None] != mine[s][:, None])
                    i, g = np.nonzero(np.logical_or.reduceat(near[:, order], first, axis=1))
                    i, g = np.repeat(i, parts[g]), np.repeat(g, parts[g])
                    turn = np.arange(len(g)) - np.searchsorted(i * len(parts) + g, i * len(parts) + g)
                    at = pa.array(i + s.start)
                    yield pa.RecordBatch.from_arrays([*[batch.column(n).take(at) for n in names], pa.array(g.astype(np.int32)), pa.array(turn.astype(np.int32))], names=[*names, "group", "part"])

        return points.mapInArrow(run, schema)

    def parted(self, rows: DataFrame) -> DataFrame:
        """Rows of cells, dealt over the parts of their group."""
        n = F.broadcast(self.spark.createDataFrame([(i, int(g), int(self.parts[g])) for i, g in enumerate(self.group) if g >= 0], "cell int, group int, parts int"))
        return rows.join(n, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")


def _least_of(left: DataFrame, right: DataFrame, each: Callable[[np.ndarray, np.ndarray, pa.Table, pa.Table], pa.Table], schema: str, width: int) -> DataFrame:
    """Askers (with x) against the points of the parts of groups that they visit; askers of a part come in turns of PART."""
    by_part = ["group", "part"]
    turns = left.groupBy(*by_part).agg(F.ceil(F.count(F.lit(1)) / F.lit(PART)).cast("int").alias("turns"))
    left = left.join(F.broadcast(turns), by_part).withColumn("turn", F.pmod(F.xxhash64("id", F.lit(3)), F.col("turns")).cast("int"))
    right = right.join(F.broadcast(turns), by_part).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    empty = pa.table({n.split()[0]: pa.array([], {"long": pa.int64(), "double": pa.float64()}[n.split()[1]]) for n in schema.split(", ")})

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return empty
        return each(_matrix(a["x"], width), _matrix(b["x"], width), a, b)

    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # both may stem from the same table
    by = (*by_part, "turn")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, schema)


def _firsts(by: np.ndarray, *order: np.ndarray, n: int = 1) -> np.ndarray:
    """Of each value of `by` the places of the n rows that come first."""
    at = np.lexsort((*reversed(order), by))
    start = np.flatnonzero(np.diff(by[at], prepend=by[at][0] - 1)) if len(at) else at
    turn = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
    return at[turn < n]


def neighbours(cells: Cells, kept: int) -> DataFrame:
    """id, other, d and k (1 for the first) of every point's `kept` nearest points, itself included, equal ones by id."""
    held = cells.parted(cells.rows.select("id", "x", "cell"))

    def kth(xa: np.ndarray, xb: np.ndarray, a: pa.Table, b: pa.Table) -> pa.Table:  # no nearer one is missed: raised by more than the product's error
        xa, xb = xa.astype(np.float64), xb.astype(np.float64)
        own, far = (xa * xa).sum(1), (xb * xb).sum(1)
        d = np.full(len(xa), np.inf)
        if len(xb) >= kept:
            for s in _slices(len(xa), len(xb), 1):
                d[s] = np.partition(far[None] - 2 * (xa[s] @ xb.T), kept - 1, axis=1)[:, kept - 1]
        return pa.table({"id": a["id"], "most": pa.array(np.sqrt(np.maximum(d + own, 0) + 1e-11 * (own + far.max())))})

    def near(xa: np.ndarray, xb: np.ndarray, a: pa.Table, b: pa.Table) -> pa.Table:
        ia, ib = np.asarray(a["id"]), np.asarray(b["id"])
        ids, others, gaps = [], [], []
        for i, j, d in _within(xa, xb, np.asarray(a["most"])):
            at = _firsts(i, d, ib[j], n=kept)
            ids.append(ia[i[at]]), others.append(ib[j[at]]), gaps.append(d[at])
        join = lambda x, kind: pa.array(np.concatenate([np.empty(0, kind), *x]))
        return pa.table({"id": join(ids, np.int64), "other": join(others, np.int64), "d": join(gaps, np.float64)})

    first = cells.keep(_least_of(held, held, kth, "id long, most double", cells.width), "bounds")  # within the own group's part
    bounded = cells.rows.select("id", "x").join(first, "id").withColumn("none", F.lit(-2).cast("long"))
    found = _least_of(cells.visits(bounded, "most", "none"), held, near, "id long, other long, d double", cells.width)
    return cells.keep(found.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))).filter(F.col("k") <= kept), "near")  # `kept` a point and part it visits


def core_distances(cells: Cells, samples: int) -> DataFrame:
    """id, x, cell, core, near (others with their distance) and least (no other point is nearer) of every point; with fewer points than samples, the farthest stands in."""
    samples, kept = min(samples, cells.count), min(max(samples, NEAR + 1), cells.count)
    of = neighbours(cells, kept).groupBy("id").agg(
        F.max(F.when(F.col("k") == samples, F.col("d"))).alias("core"),
        F.collect_list(F.when(F.col("other") != F.col("id"), F.struct("other", "d"))).alias("near"),
        F.lit(float("inf")).alias("least") if kept == cells.count else F.max("d").alias("least"),
    )
    return cells.keep(cells.rows.select("id", "x", "cell").join(of, "id"), "cores")


def _joined(edges: DataFrame, parent: DataFrame, keep: Keep) -> DataFrame:
    """id and component (its smallest id) of points after edges between components: larger roots hook to smaller ones, then all paths are halved until they end at a root."""
    links = edges.select("a", "b")
    while True:
        # what a root's neighbours' smallest root is
        of = lambda c: parent.select(F.col("id").alias(c), F.col("component").alias(f"{c}_root"))
        rooted = links.join(of("a"), "a").join(of("b"), "b").filter("a_root <> b_root")
        rooted = keep(rooted.select(F.least("a_root", "b_root").alias("low"), F.greatest("a_root", "b_root").alias("high")).distinct(), "hooks")
        if not rooted.take(1):
            return parent
        hook = rooted.groupBy(F.col("high").alias("id")).agg(F.min("low").alias("to"))
        parent = keep(parent.join(hook.select(F.col("id").alias("component"), "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component")), "parents")
        while True:  # until all point to a root
            up = parent.select(F.col("id").alias("component"), F.col("component").alias("to"))
            over = up.select(F.col("component").alias("to"), F.col("to").alias("top"))
            jumped = keep(parent.join(up, "component").join(over, "to").select("id", F.col("top").alias("component"), (F.col("top") != F.col("component")).alias("moved")), "jumps")
            parent = jumped.select("id", "component")
            if not jumped.filter("moved").take(1):
                break
        links = rooted.select(F.col("low").alias("a"), F.col("high").alias("b"))


def spanning_tree(cells: Cells, cores: DataFrame) -> DataFrame:
    """a, b and w: the edges of the minimum spanning tree by mutual reachability."""
    keep, width = cells.keep, cells.width
    points = cores.select("id", "x", "cell", "core", "least")
    edges = cores.select("id", "core", F.explode("near").alias("n")).select("id", "core", "n.other", "n.d")
    edges = edges.join(cores.select(F.col("id").alias("other"), F.col("core").alias("other_core")), "other")
    edges = keep(edges.select("id", "other", F.greatest("d", "core", "other_core").alias("w")), "edges")
    component = cores.select("id", F.col("id").alias("component"))
    tree: DataFrame | None = None
    most_core = cores.groupBy("cell").agg(F.max("core").alias("c"))
    reach = {r["cell"]: r["c"] for r in most_core.collect()}  # a row a cell
    limit = np.array([max(reach.get(i, np.inf), 0) for i in range(len(cells.centres))])
    radius = np.where(np.isfinite(cells.radius), cells.radius, np.inf)
    while True:
        rows = keep(points.join(component, "id"), "round")
        largest = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(2).collect()
        if len(largest) < 2:
            return tree if tree is not None else rows.select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("core").alias("w")).limit(0)
        others = F.col("component") != largest[0]["component"]  # the largest waits for the others, which are all joined to something
        only = rows.groupBy("cell").agg(F.when(F.min("component") == F.max("component"), F.min("component")).alias("only"))
        pure = {r["cell"]: r["only"] for r in only.collect()}
        pure = np.array([pure[i] if pure.get(i) is not None else -1 for i in range(len(cells.centres))])
        sent = cells.spark.sparkContext.broadcast((cells.centres, radius, limit, pure))

        # the shortest edges to kept neighbours; those within a component are of no more use
        of = lambda c: component.select(F.col("id").alias(c), F.col("component").alias(f"{c}_component"))
        edges = keep(edges.join(of("id"), "id").join(of("other"), "other").filter("id_component <> other_component").select("id", "other", "w", F.col("id_component").alias("component")), "outward")
        known = edges.filter(others).groupBy("component").agg(F.min(F.struct("w", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))).alias("e"))
        known = keep(known.select("component", "e.*"), "known")
        edges = edges.drop("component")

        def bound(batches: Batches, sent=sent) -> Batches:
            """What an edge out of the component is at most: to the farthest side of any cell that is not its own."""
            centres, radius, limit, pure = sent.value
            for batch in batches:
                x, c, core = _matrix(batch.column("x"), width), np.asarray(batch.column("component")), np.asarray(batch.column("core"))
                out = []
                for s in _slices(len(x), len(centres), width):
                    far = np.maximum(np.maximum(_gaps(x[s], centres) + radius, limit), core[s][:, None])
                    out.append(np.where(pure[None] == c[s][:, None], np.inf, far).min(1))
                yield pa.RecordBatch.from_arrays([batch.column("component"), pa.array(np.concatenate(out) * (1 + 1e-6) + 1e-6)], names=["component", "most"])

        left = rows.filter(others).join(known.select("component"), "component", "left_anti")  # no kept neighbour is outside
        most = left.select("component", "x", "core").mapInArrow(bound, "component long, most double").groupBy("component").agg(F.min("most").alias("most"))
        most = most.unionByName(known.select("component", F.col("w").alias("most")))
        asking = keep(rows.join(most, "component").filter(F.greatest("core", "least") <= F.col("most")).select("id", "x", "component", "core", "most"), "asking")
        held = cells.parted(rows.select("id", "x", "cell", "component", "core"))

        def shortest(xa: np.ndarray, xb: np.ndarray, a: pa.Table, b: pa.Table) -> pa.Table:
            """The shortest edge outwards of each component among the askers."""
            ca, cb, ia, ib, core_a, core_b = (np.asarray(t[n]) for n in ("component", "id", "core") for t in (a, b))
            best = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)]
            for i, j, d in _within(xa, xb, np.asarray(a["most"]), (ca, cb)):
                w = np.maximum(np.maximum(d, core_a[i]), core_b[j])
                more = ca[i], w, np.minimum(ia[i], ib[j]), np.maximum(ia[i], ib[j])
                best = [np.concatenate(p) for p in zip(best, more, strict=True)]
                one = _firsts(*best)
                best = [p[one] for p in best]
            return pa.table(dict(zip(("component", "w", "a", "b"), map(pa.array, best), strict=True)))

        found = _least_of(cells.visits(asking, "most", "component", pure), held, shortest, "component long, w double, a long, b long", width)
        chosen = found.unionByName(known).groupBy("component").agg(F.min(F.struct("w", "a", "b")).alias("e")).select("e.*").distinct()
        chosen = keep(chosen, "chosen")
        tree = chosen if tree is None else tree.unionByName(chosen)  # a table a round
        component = _joined(chosen, component, keep)


class Condensed:
    """The condensed tree, grown from the top: clusters with their birth, their parent, and the stability that they gather."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.birth, self.parent, self.stability = [0.0], [-1], [0.0]

    def fall(self, cluster: int, n: int, w: float) -> None:
        self.stability[cluster] += n * (1 / max(w, TINY) - self.birth[cluster])

    def cut(self, edges: list[tuple[float, int, int, int, int]], sizes: dict[int, int], start: int) -> dict[int, int]:
        """Undoes the edges (w, a, b, piece of a, piece of b) of one cluster's tree, longest first; returns the cluster where each piece is left."""
        node = {p: p for p in sizes}
        count, kids = dict(sizes), {}

        def root(p: int) -> int:
            while node[p] != p:
                node[p] = node[node[p]]
                p = node[p]
            return p

        fresh = max(sizes, default=0) + 1
        for w, _, _, a, b in sorted(edges):  # joined shortest first, which makes the tree that is then undone
            ra, rb = root(a), root(b)
            node[fresh] = fresh
            node[ra] = node[rb] = fresh
            count[fresh], kids[fresh] = count[ra] + count[rb], (w, ra, rb)
            fresh += 1
        left: dict[int, int] = {}
        todo = [(root(p), start) for p in list(sizes)[:1]]
        while todo:
            at, cluster = todo.pop()
            if at not in kids:
                left[at] = cluster
                continue
            w, *pair = kids[at]
            big = [k for k in pair if count[k] >= self.size]
            if len(big) == 2:
                self.fall(cluster, count[at], w)
                for k in pair:
                    self.birth.append(1 / max(w, TINY))
                    self.parent.append(cluster)
                    self.stability.append(0.0)
                    todo.append((k, len(self.birth) - 1))
                continue
            for k in pair:
                if k in big:
                    todo.append((k, cluster))
                else:  # too small to be a cluster: its points fall out here
                    self.fall(cluster, count[k], w)
                    self._rest(k, kids, cluster, left)
        return left

    def _rest(self, at: int, kids: dict, cluster: int, left: dict[int, int]) -> None:
        todo = [at]
        while todo:
            k = todo.pop()
            if k in kids:
                todo += kids[k][1:]
            else:
                left[k] = cluster

    def chosen(self) -> dict[int, int]:
        """For every cluster the chosen one that it belongs to, by excess of mass; none for those above all chosen ones."""
        kids = defaultdict(list)
        for c, p in enumerate(self.parent):
            kids[p].append(c)
        best, taken = {}, set()
        for c in reversed(range(len(self.parent))):
            below = sum(best[k] for k in kids[c])
            if c and (not kids[c] or self.stability[c] >= below):
                best[c] = self.stability[c]
                taken.add(c)
            else:
                best[c] = below
        out: dict[int, int] = {}
        for c in range(len(self.parent)):  # parents come first
            p = self.parent[c]
            if p in out:
                out[c] = out[p]
            elif c in taken:
                out[c] = c
        return out


def hierarchy(tree: DataFrame, points: DataFrame, size: int, keep: Keep) -> DataFrame:
    """id and label of every point by the condensed tree; labels are the smallest id of their cluster's points."""
    spark = points.sparkSession
    condensed = Condensed(size)
    at = keep(points.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("piece")), "at")
    left = tree.join(at.select(F.col("id").alias("a"), "cluster", "piece"), "a")
    done: DataFrame | None = None
    while True:
        total = left.count()
        if total:
            floor = left.orderBy(F.desc("w"), F.desc("a"), F.desc("b")).limit(HEAVY).agg(F.min(F.struct("w", "a", "b")).alias("e")).first()["e"]
            more, same = F.col("a") > floor["a"], (F.col("a") == floor["a"]) & (F.col("b") >= floor["b"])
            heavy = (F.col("w") > floor["w"]) | ((F.col("w") == floor["w"]) & (more | same))
            light = keep(left.filter(~heavy), "light")
            pieces = keep(_joined(light, at.select("id", F.col("id").alias("component")), keep), "pieces")
            counts = keep(pieces.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "counts")
            where = lambda c: pieces.select(F.col("id").alias(c), F.col("component").alias(f"{c}_piece"))
            cuts = left.filter(heavy).join(where("a"), "a").join(where("b"), "b").select("w", "a", "b", "a_piece", "b_piece", "cluster", "piece").collect()  # HEAVY at most
            ends = spark.createDataFrame([(p,) for p in {r[c] for r in cuts for c in ("a_piece", "b_piece")}], "component long")
            sizes = {r["component"]: r["n"] for r in counts.join(F.broadcast(ends), "component").collect()}
            by = defaultdict(list)
            for r in cuts:
                by[r["cluster"], r["piece"]].append((r["w"], r["a"], r["b"], r["a_piece"], r["b_piece"]))
            moved = {}
            for (cluster, _), edges in sorted(by.items()):
                moved |= condensed.cut(edges, {p: sizes[p] for e in edges for p in e[3:]}, cluster)
            change = spark.createDataFrame(list(moved.items()), "component long, to int")
            rows = at.join(pieces, "id").join(F.broadcast(change), "component", "left")
            rows = rows.join(counts.filter(F.col("n") >= size), "component", "left")
            rows = keep(rows.select("id", F.coalesce("to", "cluster").alias("cluster"), F.col("component").alias("piece"), F.coalesce("n", F.lit(0)).alias("n")), "cut")
        else:
            rows = at.withColumn("n", F.lit(0).cast("long"))
        stays = rows.filter(F.col("n") < size).select("id", "cluster")
        done = stays if done is None else done.unionByName(stays)
        at = keep(rows.filter(F.col("n") >= size).select("id", "cluster", "piece"), "at")
        if not total or not at.take(1):
            break
        left = light.select("w", "a", "b").join(at.select(F.col("id").alias("a"), "cluster", "piece"), "a")
    final = condensed.chosen()
    names = spark.createDataFrame([(c, f) for c, f in final.items()], "cluster int, chosen int")
    rows = keep(done.join(F.broadcast(names), "cluster", "left").select("id", "chosen"), "chosen")
    first = rows.filter("chosen is not null").groupBy("chosen").agg(F.min("id").alias("label"))
    return rows.join(F.broadcast(first), "chosen", "left").select("id", F.coalesce("label", F.lit(NOISE)).alias("label"))


def clusters(points: DataFrame, size: int, samples: int, keep: Keep) -> DataFrame:
    """id and label (the smallest id of the cluster, or -1 for noise) of points (id, x); `keep` writes a table and reads it back."""
    cells = Cells(points, keep)
    if cells.count < max(size, 2):
        return cells.rows.select("id", F.lit(NOISE).cast("long").alias("label"))
    cores = core_distances(cells, samples)
    return hierarchy(spanning_tree(cells, cores), cores, size, keep)
