from lakelens.operators import relational as R


def edges(spark):
    return spark.createDataFrame([(1, 10), (2, 10), (3, 10), (1, 20), (2, 20), (1, 30)], "citing_id long, cited_id long")


def test_foundations_and_co_cited(spark):
    works = spark.createDataFrame([(10, "a", "x", 2017), (20, "b", "y", 2024), (30, None, None, None)], "work_id long, title string, category string, year int")
    assert [(r.work_id, r.cited_by) for r in R.foundations(edges(spark), works, 5).collect()] == [(10, 3), (20, 2), (30, 1)]
    assert [(r.cited_id, r.together) for r in R.co_cited(edges(spark), 10, 5).collect()] == [(20, 2), (30, 1)]


def test_newest_citers(spark):
    got = {(r.cited_id, r.citing_id) for r in R.newest_citers(edges(spark), 1, 2).collect()}
    assert got == {(10, 3), (10, 2)}


def test_rank_norm(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 4), ("b", 9)], "g string, v int")
    assert sorted((r.g, r.v, r.norm) for r in R.rank_norm(df, "v", ["g"]).collect()) == [("a", 1, 0.0), ("a", 2, 0.5), ("a", 2, 0.5), ("a", 4, 1.0), ("b", 9, 0.5)]


def test_budget_keeps_the_first(spark):
    df = spark.createDataFrame([("a", 1, 99), ("a", 2, 1), ("b", 1, 5), ("b", 2, 5), ("b", 3, 1)], "d string, k int, n int")
    assert sorted((r.d, r.k) for r in R.within_budget(df, ["d"], ["k"], "n", 10).collect()) == [("a", 1), ("b", 1), ("b", 2)]


def test_scope(spark):
    df = spark.range(5)
    assert R.in_scope(df, "id", None).count() == 5
    assert R.in_scope(df, "id", []).count() == 0
    assert R.in_scope(df, "id", [1, 9]).count() == 1
