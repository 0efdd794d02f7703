"""Order statistics by narrowed ranges against sorted groups."""

import random
import sys
from itertools import count

import pytest
from pyspark.sql import functions as F

from lakelens.operators import selection as S


@pytest.fixture
def keep(spark, tmp_path):
    names = count()

    def write(df, label):
        path = f"file://{tmp_path}/{label}-{next(names)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return write


def test_ranks_of_odd_groups(spark, keep, monkeypatch):
    monkeypatch.setattr(S, "SLICES", 8)
    rng = random.Random(4)
    top = sys.float_info.max
    groups = {
        "spread": [rng.uniform(-5, 5) for _ in range(300)],
        "skewed": [10.0 ** rng.randint(-12, 12) for _ in range(200)],
        "equal": [2.5] * 100,
        "ends": [-top, top, 0.0, 5e-324, -5e-324, 1.0],
        "hot": [1.0] * 200 + [1.0 + 2**-52, 0.5],
        "one": [7.0],
        None: [3.0, 1.0, 2.0],
    }
    rows = [(g, v) for g, x in groups.items() for v in x] + [("spread", None), ("one", float("nan")), ("empty", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    ranks = {"first": F.lit(0), "third": F.lit(2), "middle": F.expr("n div 2"), "last": F.col("n") - 1}
    got = {r.g: r for r in S.select(df, "g", "v", ranks, keep).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        v = sorted(values)
        assert (got[g].n, got[g].first, got[g].middle, got[g].last) == (len(v), v[0], v[len(v) // 2], v[-1]), g
        assert got[g].third == (v[2] if len(v) > 2 else None)
    medians = {r.g: r.median for r in S.median(df.filter("g is null or g <> 'ends'"), "g", "v", keep).collect()}
    assert medians["hot"] == 1.0 and medians[None] == 2.0 and medians["one"] == 7.0
    assert S.select(df.limit(0), "g", "v", ranks, keep).count() == 0
