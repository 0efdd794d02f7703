import pytest

from lakelens.operators import catalog as C
from lakelens.operators import census as N
from lakelens.operators import relational as R

EDGES = [("2608.00001", "1707.06347"), ("2608.00002", "1707.06347"), ("2608.00003", "1707.06347"), ("2608.00001", "2402.03300"), ("2608.00002", "2402.03300"), ("2608.00001", "9999.99999")]


@pytest.fixture(scope="module")
def graph(spark):
    rows = [("2608.00001", True), ("2608.00002", True), ("2608.00003", True), ("1506.00001", False)]
    papers = spark.createDataFrame([(p, p, p[:4], t) for p, t in rows], "paper_id string, pid string, month string, has_text boolean")
    chunks = spark.createDataFrame([("2608.00001",), ("2608.00001",), ("2608.00002",)], "paper_id string")
    works = spark.createDataFrame([("1707.06347", "cs.LG", 2017), ("2402.03300", "cs.CL", 2024), ("9999.99999", None, None)], "work_id string, category string, year int")
    listed = spark.createDataFrame([("2608", 10), ("1506", 900)], "month string, cs_papers long")
    return papers, spark.createDataFrame(EDGES, "citing_id string, cited_id string"), chunks, works, listed


def test_cohort(graph):
    papers, edges, chunks, works, listed = graph
    r = N.cohort_stats(papers, edges, chunks, listed).first()
    assert (r.cohort_start, r.cohort_end, r.cohort_papers, r.cohort_catalog_papers) == ("2608", "2608", 3, 10)
    assert (r.papers_parsed, r.papers_with_references, r.citations, r.cited_works, r.readable_papers) == (3, 3, 6, 3, 2)
    small = listed.sparkSession.createDataFrame([("2608", 2)], "month string, cs_papers long")
    assert N.cohort_stats(papers, edges, chunks, small).first().cohort_catalog_papers is None


def test_foundation(graph):
    papers, edges, chunks, works, _ = graph
    assert N.foundation(edges, works, "1707.06347").first().cited_by == 3
    assert N.foundation(edges, works, "0000.00000").count() == 0
    assert [r.pid for r in N.indexed_citers(edges, papers, chunks, "1707.06347", 8).collect()] == ["2608.00002", "2608.00001"]
    assert {r.cited_id: r.together for r in R.co_cited(edges, "1707.06347", 8).collect()} == {"2402.03300": 2, "9999.99999": 1}
    assert {r.paper_id for r in R.scope(edges, chunks, "1707.06347").collect()} == {"2608.00001", "2608.00002"}


def test_census(spark):
    papers = [("2607.00001", "cs.CV"), ("2607.00002", "cs.CV"), ("2607.00003", "cs.CL"), ("2607.00004", "cs.RO"), ("2608.00001", "cs.CV"), ("2608.00002", "cs.CL"), ("2608.00003", "cs.CL"), ("2608.00004", "cs.CR"), ("2609.00001", "cs.CL")]
    p = spark.createDataFrame([(i, i[:4], c, True) for i, c in papers], "paper_id string, month string, category string, has_text boolean")
    edges = spark.createDataFrame([("2608.00001", "2607.00001"), ("2608.00002", "2607.00001"), ("2609.00001", "2607.00001"), ("2608.00003", "2607.00003")], "citing_id string, cited_id string")
    listed = spark.createDataFrame([("2607", 4), ("2608", 4), ("2609", 20)], "month string, cs_papers long")
    coverage = N.month_coverage(p, edges, listed)
    complete = N.complete_months(coverage)
    assert sorted(r.month for r in complete.collect()) == ["2607", "2608"]
    assert [(r.from_month, r.to_month) for r in N.consecutive(complete).collect()] == [("2607", "2608")]
    assert [r.month for r in N.excluded_months(coverage, N.cohort_months(p, edges)).collect()] == ["2609"]
    got = [(r.cited_id, r.citations_from, r.cited_by) for r in N.uptake(edges, p.select("paper_id", "month"), N.consecutive(complete)).collect()]
    assert got == [("2607.00001", 2, 3), ("2607.00003", 1, 1)]
    totals = N.uptake_totals(edges, p.select("paper_id", "month"), N.consecutive(complete)).first()
    assert (totals.works_total, totals.edges_total) == (2, 3)
    cells = {(r.month, r.category): r.n for r in N.category_census(p, coverage, 2).collect()}
    assert cells == {("2607", "cs.CL"): 1, ("2607", "cs.CV"): 2, ("2607", "other"): 1, ("2608", "cs.CL"): 2, ("2608", "cs.CV"): 1, ("2608", "other"): 1}
    unknown = N.month_coverage(p, edges, listed.filter("month <> '2607'"))
    assert sorted(r.month for r in N.complete_months(unknown).collect()) == ["2608"]


def flagged(spark):
    rows = [("2607.00001", "2607", "cs.CV", "2026-07-01", True, True, 2, None), ("2607.00002", "2607", "cs.CL", "2026-07-01", True, False, 0, "x"), ("2608.00001", "2608", "cs.CL", "", False, False, 1, "y")]
    return spark.createDataFrame([(i, *r, 2026) for i, r in enumerate(rows)], "paper_id long, pid string, month string, category string, published string, has_text boolean, indexed boolean, cited_by long, license string, year int")


def test_pages(spark):
    f = flagged(spark)
    ids = lambda w, sort="newest", limit=9, offset=0: [r.pid for r in C.page(f, w, sort, limit, offset).orderBy("pid").collect()]
    assert ids(C.Where(holding="indexed")) == ["2607.00001"] and len(ids(C.Where(holding="text"))) == 2
    assert ids(C.Where(), "cited", 1) == ["2607.00001"] and ids(C.Where(), "newest", 1) == ["2607.00002"] and ids(C.Where(), "oldest", 1) == ["2608.00001"]
    assert sorted(ids(C.Where(), "newest", 1, 0) + ids(C.Where(), "newest", 1, 1) + ids(C.Where(), "newest", 1, 2)) == ["2607.00001", "2607.00002", "2608.00001"]
    assert ids(C.Where(licensed=False)) == ["2607.00001"] and ids(C.Where(year_max=2025)) == []
    assert C.next_offset(0, 25, 26) == 25 and C.next_offset(25, 1, 26) is None
    for bad in ("26", "26081", "2608\n"):
        with pytest.raises(ValueError):
            C.Where(month=bad)


def test_facets_drop_their_own_filter(spark):
    got = {(r.facet, r.value): r.n for r in C.facets(flagged(spark), C.Where(category="cs.CL", month="2607")).collect()}
    assert got == {("category", "cs.CV"): 1, ("category", "cs.CL"): 1, ("month", "2607"): 1, ("month", "2608"): 1, ("holding", "all"): 1, ("holding", "text"): 1, ("total", None): 1}


def test_backfill(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "v1")], "k int, license string, version string")
    snap = spark.createDataFrame([(1, None, "v9"), (2, "b", "v9")], "k int, license string, version string")
    assert sorted(map(tuple, R.backfill(df, snap, "k", ["license"], ["version"]).collect())) == [(1, "a", "v9"), (2, "b", "v1")]


def test_author_keys_are_told_apart_within_their_paper(spark):
    """Keys are distinct, and no row of a single key is held to make them so: nothing is aggregated after they are laid out."""
    from lakelens.plans import ordered

    keys = ordered._keys(spark, "/root/testdata/sf0.001")
    assert 0 < keys.count() == keys.distinct().count()
    plan = keys._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "Aggregate" not in plan[: plan.index("Generate")]
