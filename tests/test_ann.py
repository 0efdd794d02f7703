"""The index of approximate neighbours: recall against the exact search, odd rows, hot cells, filters, empty tables."""

import numpy as np
import pytest

from lakelens.operators import ann
from lakelens.operators import evals as E
from lakelens.operators import hybrid as H

WIDTH = 24


def vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, WIDTH))
    x = centres[rng.integers(0, 30, 1500)] + rng.normal(scale=0.5, size=(1500, WIDTH))
    x[:500] = x[0]  # one vector is a third of all rows
    return [(i, [float(v) for v in r]) for i, r in enumerate(x)]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    odd = [(5000, None), (5001, [0.0] * WIDTH), (5002, [1.0, 2.0]), (5003, [float("nan")] * WIDTH), (5004, [])]
    rows = spark.createDataFrame(vectors() + odd, "vec_id long, embedding array<double>").repartition(3).cache()
    index = ann.build(rows, "vec_id", f"file://{tmp_path_factory.mktemp('ann')}/index", cells=24, rounds=4)
    return rows, index


def asked(rows):
    return rows.filter("vec_id % 50 = 0 and vec_id < 5000").selectExpr("vec_id as query_id", "embedding")


def scores(df):
    """Equal vectors may stand in for each other: what counts is how near the found ones are."""
    return {(r.query_id, r["rank"]): r.score for r in df.collect()}


def test_recall_against_the_exact_search(made):
    rows, index = made
    found, exact = scores(index.search(asked(rows), 10)), scores(E.knn_batch(rows.filter("vec_id % 50 = 0 and vec_id < 5000"), rows.filter("vec_id < 5000"), 10))
    assert found.keys() == exact.keys() and len(found) == 300
    assert np.mean([abs(found[k] - exact[k]) < 1e-5 for k in exact]) >= 0.9
    assert index.probes < 24 and index.count == 1500


@pytest.mark.parametrize("keep", [3, 97])
def test_scopes_reach_far_enough(made, keep):
    rows, index = made
    scope = rows.filter(f"vec_id % {keep} = 1 and vec_id < 5000")
    found = scores(index.search(asked(rows), 10, scope, exact=100))
    exact = scores(E.knn_batch(rows.filter("vec_id % 50 = 0 and vec_id < 5000"), scope, 10))
    assert found.keys() == exact.keys()
    assert np.mean([abs(found[k] - exact[k]) < 1e-5 for k in exact]) >= 0.9


def test_hot_cells_in_parts_and_saved_indexes_answer_alike(made, monkeypatch):
    rows, index = made
    whole = sorted(map(tuple, index.search(asked(rows), 5, short=400).collect()))
    monkeypatch.setattr(ann, "PART", 64)
    monkeypatch.setattr(ann, "ASKED", 4)
    again = ann.load(index.path)
    assert sorted(map(tuple, again.search(asked(rows), 5, short=400).collect())) == whole and again.probes == index.probes


def test_one_query_and_all_cells_are_exact(made):
    rows, index = made
    query = vectors()[900][1]
    got = index.search(rows.filter("vec_id = 900").selectExpr("vec_id as query_id", "embedding"), 5, probes=24, short=300).orderBy("rank").collect()
    want = H.knn(rows.filter("vec_id < 5000"), "vec_id", query, 5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [r.vec_id for r in want]
    assert [r.vec_id for r in index.nearest(query, 1).collect()] == [900]


def test_odd_queries_and_empty_tables(spark, made, tmp_path):
    rows, index = made
    assert index.lists().select("vec_id").distinct().count() == 1500
    assert index.search(rows.filter("vec_id >= 5000").selectExpr("vec_id as query_id", "embedding"), 3).count() == 0
    assert index.search(asked(rows), 3, rows.limit(0)).count() == 0
    empty = ann.build(rows.limit(0), "vec_id", f"file://{tmp_path}/index")
    assert ann.load(empty.path).search(asked(rows), 3).count() == 0
    few = ann.build(rows.filter("vec_id in (1, 900)"), "vec_id", f"file://{tmp_path}/few")
    assert {r.vec_id for r in few.nearest(vectors()[900][1], 5).collect()} == {1, 900}


def test_a_query_travels_to_a_group_of_cells_once(made):
    """However many cells are probed, a query is a row a group of cells; groups hold a bounded number of vectors or a part of one cell."""
    rows, index = made
    q = ann.directions(asked(rows), "query_id", WIDTH)
    sizes = np.zeros(24, np.int64)
    for r in index.lists().groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    one = index._probed(q, 20, sizes, 20, ann._groups(sizes, 1 << 18)[0]).collect()
    assert len(one) == q.count() == 30 and min(len(r.cells) for r in one) >= 18
    group, parts = ann._groups(sizes, 64)
    many = index._probed(q, 20, sizes, 20, group).collect()
    of = lambda found: {(r.query_id, c) for r in found for c in r.cells}
    assert of(many) == of(one) and len({(r.query_id, r.grp) for r in many}) == len(many) > 30
    held = np.bincount(group, sizes)
    assert all(held[group[c]] <= 64 or (held[group[c]] == sizes[c] and parts[c] == -(-sizes[c] // 64)) for c in np.flatnonzero(sizes))
