"""The hierarchy of densities against a plain one over all pairs."""

from itertools import count

import numpy as np
import pytest

from lakelens.operators import density as D


def by_hand(x, size, samples):
    """Labels from all distances: a tree by Prim, then every threshold from the top."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, min(samples, n) - 1]
    m = np.maximum(np.maximum(d, core[:, None]), core[None])
    inside, edges = {0}, []
    while len(inside) < n:
        w, a, b = min((m[a, b], min(a, b), max(a, b)) for a in inside for b in range(n) if b not in inside)
        edges.append((w, a, b))
        inside |= {a, b}

    def parts(points, left):
        out, points = [], set(points)
        while points:
            todo, got = [points.pop()], set()
            while todo:
                p = todo.pop()
                got.add(p)
                near = {q for _, a, b in left for p_, q in ((a, b), (b, a)) if p_ == p and q in points}
                points -= near
                todo += near
            out.append(got)
        return out

    names, tree, falls = count(1), {0: (None, 0.0)}, {0: []}
    todo = [(set(range(n)), sorted(edges), 0)]
    while todo:
        points, left, c = todo.pop()
        *left, (w, a, b) = left
        lam = 1 / max(w, D.TINY)
        two = parts(points, left)
        big = [p for p in two if len(p) >= size]
        if len(big) == 2:
            falls[c] += [(q, lam) for q in points]
            for p in big:
                k = next(names)
                tree[k], falls[k] = (c, lam), []
                todo.append((p, [e for e in left if e[1] in p], k))
        else:
            for p in two:
                if p in big:
                    todo.append((p, [e for e in left if e[1] in p], c))
                else:
                    falls[c] += [(q, lam) for q in p]
    stability = {c: sum(lam - tree[c][1] for _, lam in falls[c]) for c in tree}

    def pick(c):
        kids = [k for k in tree if tree[k][0] == c]
        below = [pick(k) for k in kids]
        score, chosen = sum(s for s, _ in below), {k for _, t in below for k in t}
        return (stability[c], {c}) if c and (not kids or stability[c] >= score) else (score, chosen)

    out = np.full(n, -1)
    for c in pick(0)[1]:
        under = [c]
        for k in under:
            under += [j for j in tree if tree[j][0] == k]
        members = sorted({q for k in under for q, _ in falls[k]})
        out[members] = members[0]
    return out


@pytest.fixture
def keep(spark, tmp_path):
    names = count()

    def write(df, label):
        path = f"file://{tmp_path}/{label}-{next(names)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return write


def blobs(n, seed):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(c, s, (k, 2)) for c, s, k in (((0, 0), 0.3, n // 3), ((4, 0), 0.6, n // 3), ((4, 3), 0.2, n // 6))]
    return np.concatenate([*parts, rng.uniform(-3, 7, (n - sum(map(len, parts)), 2))]).astype(np.float32)


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>").repartition(3)


def test_labels_of_the_plain_hierarchy(spark, keep, monkeypatch):
    x = blobs(120, 1)
    want = by_hand(x.astype(float), 8, 4)
    monkeypatch.setattr(D, "HEAVY", 70)  # several turns
    monkeypatch.setattr(D, "PART", 16)  # cells in parts, askers in turns
    got = {r.id: r.label for r in D.clusters(table(spark, x), 8, 4, keep).collect()}
    assert [got[i] for i in range(len(x))] == want.tolist() and len(set(want)) >= 3


def test_five_hundred_points_and_edges_of_the_tree(spark, keep):
    x = blobs(500, 2)
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, 4]
    m = np.maximum(np.maximum(d, core[:, None]), core[None])
    near, total = m[0].copy(), 0.0
    near[0] = np.inf
    inside = np.zeros(500, bool)
    inside[0] = True
    for _ in range(499):
        near[inside] = np.inf
        p = int(near.argmin())
        total += near[p]
        inside[p] = True
        near = np.minimum(near, m[p])
    cells = D.Cells(table(spark, x), keep)
    cores = D.core_distances(cells, 5)
    assert np.allclose([r.core for r in cores.orderBy("id").collect()], core)
    tree = keep(D.spanning_tree(cells, cores), "all")
    assert tree.count() == 499 and abs(sum(r.w for r in tree.collect()) - total) < 1e-6
    labels = {r.id: r.label for r in D.hierarchy(tree, cores, 20, keep).collect()}
    clear = [labels[i] for i in range(166)], [labels[i] for i in range(166, 332)]
    assert all(max(map(c.count, set(c) - {-1})) > 120 for c in clear) and len(labels) == 500


def test_copies_and_few_points(spark, keep):
    x = np.concatenate([np.zeros((40, 2)), np.ones((10, 2)), [[9, 9]]]).astype(np.float32)
    got = {r.id: r.label for r in D.clusters(table(spark, x), 5, 3, keep).collect()}
    assert {got[i] for i in range(40)} == {0} and {got[i] for i in range(40, 50)} == {40} and got[50] == -1
    assert {r.label for r in D.clusters(table(spark, x[:3]), 5, 3, keep).collect()} == {-1}
    assert D.clusters(table(spark, x).limit(0), 5, 3, keep).count() == 0


def test_evenly_spread_points_visit_few_groups(spark, keep, monkeypatch):
    x = np.random.default_rng(3).uniform(-1, 1, (800, 10)).astype(np.float32)
    monkeypatch.setattr(D, "PART", 200)
    sent, visits = [], D.Cells.visits

    def counted(self, *args):
        rows = keep(visits(self, *args), "visits")
        sent.append(rows.count())
        return rows

    monkeypatch.setattr(D.Cells, "visits", counted)
    cells = D.Cells(table(spark, x), keep)
    cores = D.core_distances(cells, 5)
    tree = keep(D.spanning_tree(cells, cores), "all")
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, 4]
    m = np.maximum(np.maximum(d, core[:, None]), core[None])
    near, inside, total = np.full(800, np.inf), np.zeros(800, bool), 0.0
    p = 0
    for _ in range(799):
        inside[p] = True
        near = np.where(inside, np.inf, np.minimum(near, m[p]))
        p = int(near.argmin())
        total += near[p]
    assert tree.count() == 799 and abs(sum(r.w for r in tree.collect()) - total) < 1e-6
    assert sum(sent) < 15 * 800  # a point goes to each group once, and some points a few times more
