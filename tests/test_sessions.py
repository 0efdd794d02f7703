"""Sessions and budgets as state against the batch functions, on shuffled rows and rows that come too late."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakelens.streaming import sessions as S

SCHEMA = "session_id long, run_id string, ts timestamp, scope string, cost double"
START = datetime(2026, 7, 1, 8)


def runs():
    rng = random.Random(2)
    out = []
    for i in range(150):
        out.append((rng.randint(1, 6), f"r{i:03d}", START + timedelta(minutes=rng.randint(0, 60 * 30), seconds=rng.choice([0, 0, 17])), rng.choice(["a", "a", "a", "b", None]), rng.choice([0.1, 0.25, None])))
    out += [(1, "same", START, "a", 0.1), (1, "same2", START, "a", 0.1), (None, "x", START, "a", 1.0), (2, "y", None, "a", 1.0)]
    return out


@pytest.fixture
def stream(spark, tmp_path):
    S.state_store(spark)
    source = str(tmp_path / "in")

    def run(made, batches, name):
        """Each list of rows is a file, read as a batch of its own."""
        import os

        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            newest = max((f for f in os.listdir(source) if f.endswith(".parquet")), key=lambda f: os.path.getmtime(f"{source}/{f}"))
            os.utime(f"{source}/{newest}", (1_700_000_000 + 60 * i, 1_700_000_000 + 60 * i))
        df = made(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source))
        out = str(tmp_path / name)
        query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/check-{name}").trigger(availableNow=True).start()
        query.awaitTermination(200)
        assert query.exception() is None
        return spark.read.schema(df.schema).parquet(out)

    yield run
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_sessions(spark, stream):
    given = runs()
    ordered = sorted((r for r in given if r[2] is not None), key=lambda r: r[2])
    batches = [ordered[i : i + 50] for i in range(0, len(ordered), 50)]
    for b in batches:
        random.Random(1).shuffle(b)
    late = (1, "late", START - timedelta(days=3), "a", 9.0)
    end = [(9, "end", START + timedelta(days=9), "a", 0.0)]
    got = stream(lambda df: S.sessions_stream(df, timedelta(hours=1), "40 hours"), [*batches, end, [late], [(9, "end2", START + timedelta(days=20), "a", 0.0)]], "sessions")
    columns = ["session_id", "start", "end", "scope", "runs", "cents"]
    want = S.sessions(spark.createDataFrame(given + end, SCHEMA))
    assert plain(got.filter("session_id <> '9'").select(columns)) == plain(want.filter("session_id <> '9'").select(columns))
    assert got.filter("session_id = '9'").count() == 1 and want.filter("runs > 1").count() > 3


def test_budgets(spark, stream):
    given = runs()
    rows = [r for r in given if r[2] is not None]
    random.Random(3).shuffle(rows)
    end = [(9, "end", START + timedelta(days=9), "a", 0.0)]
    got = stream(lambda df: S.spend_stream(df, 60, "40 hours"), [rows[:80], rows[80:], end, [(9, "end2", START + timedelta(days=20), "a", 0.0)]], "spend")
    want = S.spend(spark.createDataFrame(given, SCHEMA), 60)
    columns = ["session_id", "run_id", "ts", "spent", "allowed"]
    assert plain(got.filter("session_id <> '9'").select(columns)) == plain(want.select(columns))
    assert want.filter(~F.col("allowed")).count() > 5
