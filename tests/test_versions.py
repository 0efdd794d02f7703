"""Versioned tables: deltas touch their buckets only, readers keep their version, writers do not overrun each other."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from lakelens.sources import versions as V
from lakelens.sources.writers import Invalid


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, v string")


def rows(df):
    return sorted(((r.id, r.v) for r in df.collect()), key=repr)


def test_deltas(spark, tmp_path):
    s = V.Store(spark, f"file://{tmp_path}/store", buckets=8)
    assert s.manifest() == (0, {})
    base = [(i, f"v{i}") for i in range(200)] + [(None, "null key")]
    assert s.write(t=(table(spark, base), "id"), u=(table(spark, []), "id")) == 1
    held = s.read("t")
    before = s.manifest()[1]["t"].parts
    version, touched = s.merge("t", table(spark, [(5, "new"), (6, "v6"), (999, "more"), (None, None)]), table(spark, [(7, ""), (5000, "")]))
    after = s.manifest()[1]["t"].parts
    want = [(i, "new" if i == 5 else f"v{i}") for i in range(200) if i != 7] + [(999, "more"), (None, None)]
    assert version == 2 and rows(s.read("t")) == sorted(want, key=repr) and rows(s.read("u")) == []
    assert {b for b in after if after[b] != before.get(b)} == touched and 0 < len(touched) <= 4
    assert rows(held) == rows(s.read("t", 1)) == sorted(base, key=repr)  # the old version is whole
    assert s.merge("t", table(spark, [(5, "new"), (8, "v8")])) == (2, set())  # nothing differs
    state = {r.id: r.change for r in s.changes("t", table(spark, [(1, "x"), (2, "v2"), (3000, "y")]), whole=True).collect()}
    assert state[1] == "changed" and state[3000] == "new" and 2 not in state and state[3] == "gone" and len(state) == 201
    version, touched = s.merge("t", table(spark, [(1, "x")]), whole=True)
    assert rows(s.read("t")) == [(1, "x")] and len(touched) == 8
    assert s.vacuum(1) > 0 and s.versions() == [3] and rows(s.read("t")) == [(1, "x")]
    with pytest.raises(Invalid):
        s.read("t", 1)
    with pytest.raises(Invalid):
        s.merge("t", table(spark, [(1, "a"), (1, "b")]))
    with pytest.raises(Invalid):
        s.read("none")


def test_two_writers_and_a_reader(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    s = V.Store(spark, path, buckets=2)
    s.write(t=(table(spark, [(1, "a")]), "id"))
    s.write(based_on=1, t=(table(spark, [(1, "b")]), "id"))
    with pytest.raises(V.Conflict):
        V.Store(spark, path, 2).write(based_on=1, t=(table(spark, [(1, "c")]), "id"))
    assert rows(s.read("t")) == [(1, "b")] and s.versions() == [1, 2]

    def write():
        for i in range(4):
            V.Store(spark, path, 2).write(t=(table(spark, [(1, f"w{i}"), (2, f"w{i}")]), "id"))

    with ThreadPoolExecutor(1) as pool:
        done = pool.submit(write)
        seen = [rows(s.read("t")) for _ in range(6)]
        done.result()
    assert all(x == [(1, "b")] or (len(x) == 2 and x[0][1] == x[1][1]) for x in seen)
    assert rows(s.read("t")) == [(1, "w3"), (2, "w3")]
