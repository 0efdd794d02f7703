"""The neighbour layout: bandwidths, the fuzzy graph, trustworthiness against the principal axes."""

from itertools import count

import numpy as np
import pytest

from lakelens.operators import ann
from lakelens.operators import manifold as M
from lakelens.operators import themes as H


@pytest.fixture
def keep(spark, tmp_path):
    names = count()

    def write(df, label):
        path = f"file://{tmp_path}/{label}-{next(names)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return write


def test_curve_and_bandwidths():
    a, b = M.curve(0.1)
    assert abs(a - 1.577) < 0.02 and abs(b - 0.895) < 0.02
    rng = np.random.default_rng(0)
    d = np.sort(rng.random((50, 15)), axis=1)
    d[3, 10:] = np.nan
    d[4] = 0.0
    near, s = M.bandwidths(d)
    w = np.exp(-np.maximum(d - near[:, None], 0) / s[:, None])
    total = np.nansum(w, axis=1)
    want = np.log2((~np.isnan(d)).sum(1))
    on = [i for i in range(50) if i != 4]
    assert np.allclose(total[on], want[on], atol=1e-4) and near[4] == 0 and near[0] == d[0, 0]


def test_graph_is_even_and_joins_directions(spark):
    rows = [(1, 2, 0.1), (1, 3, 0.4), (2, 1, 0.1), (2, 3, 0.2), (3, 2, 0.2), (3, 1, 0.4), (4, 1, 0.9), (4, 2, 0.8)]
    w = {(r.a, r.b): r.w for r in M.fuzzy_graph(spark.createDataFrame(rows, "a long, b long, d double")).collect()}
    assert all(abs(w[a, b] - w[b, a]) < 1e-12 and 0 < x <= 1 for (a, b), x in w.items())
    assert w[1, 2] == 1.0 and (1, 4) in w and w[2, 4] == 1.0


def test_neighbours_stay_together(spark, keep, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 3
    x = centres[np.arange(300) % 12] + rng.normal(size=(300, 16)) * 0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    odd = [(900, None), (901, [0.0] * 16)]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + odd, "id long, embedding array<double>").repartition(3)
    index = ann.build(v, "id", f"file://{tmp_path}/index", rounds=4)
    start = H.layout(v.filter("id < 900"), "id", 2)
    monkeypatch.setattr(M, "PART", 128)  # three blocks
    got = M.layout(index, v, start, keep, neighbours=10, rounds=4, epochs=30).orderBy("id").collect()
    assert [r.id for r in got] == list(range(300))
    z = np.array([r.z for r in got])
    linear = np.array([r.z for r in start.orderBy("id").collect()])
    mine, plain = M.trustworthiness(x, z, 10), M.trustworthiness(x, linear, 10)
    assert mine > 0.95 and mine > plain
    assert M.trustworthiness(x, x, 10) == 1.0
