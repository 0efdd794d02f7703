"""All queries of the reference's own operators, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelens.operators import evals as E
from lakelens.operators import relational as R
from lakelens.plans import mapping as M

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None, views: bool | str = True) -> Callable[[Query], Query]:
    """views: the relations that the SQL starts from, those of the graph (True), the catalog's too ("catalog"), or none."""

    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = {False: "", True: M.VIEWS, "catalog": M.VIEWS + M.CATALOG}[views] + sql
        return f

    return put


def load_all() -> None:
    """Imports the modules that register queries here."""
    import importlib

    for module in ("more", "catalog", "strings", "retrieval", "ordered", "documents", "stores"):
        importlib.import_module(f"lakelens.plans.{module}")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _indexed(s: SparkSession, d: str) -> DataFrame:
    return M.chunks(s, d).filter("section = 'R'").select("paper_id")


@register("AGG05_foundations", "SELECT work_id, title, w.category, w.year, count(*) AS cited_by FROM citations c JOIN works w ON c.cited_id = w.work_id GROUP BY ALL ORDER BY cited_by DESC, work_id LIMIT 50")
def foundations(s: SparkSession, d: str) -> DataFrame:
    return R.foundations(M.citations(s, d), M.works(s, d), 50)


@register("AGG07_cited_years", "SELECT year, count(*) AS n FROM citations JOIN works ON cited_id = work_id GROUP BY year")
def cited_years(s: SparkSession, d: str) -> DataFrame:
    counts = M.citations(s, d).groupBy("cited_id").agg(F.count(F.lit(1)).alias("k"))
    return counts.join(M.works(s, d), F.col("cited_id") == F.col("work_id")).groupBy("year").agg(F.sum("k").alias("n"))


@register("AGG08_co_cited", "SELECT o.cited_id, count(*) AS together FROM citations a JOIN citations o ON a.citing_id = o.citing_id AND a.cited_id <> o.cited_id WHERE a.cited_id = 7 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def co_cited(s: SparkSession, d: str) -> DataFrame:
    return R.co_cited(M.citations(s, d), 7, 20)


@register("JOI02_co_citation_pairs", "SELECT a.cited_id AS a, b.cited_id AS b, count(*) AS n FROM citations a JOIN citations b ON a.citing_id = b.citing_id AND a.cited_id < b.cited_id GROUP BY 1, 2")
def co_citation_pairs(s: SparkSession, d: str) -> DataFrame:
    """All pairs that a paper cites together. A paper makes as many as its own list of references has; adaptive execution splits a long one."""
    c = M.citations(s, d)
    other = c.select("citing_id", F.col("cited_id").alias("b"))
    return c.withColumnRenamed("cited_id", "a").join(other, "citing_id").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@register("AGG01_count_indexed", "SELECT count(*) AS n FROM papers SEMI JOIN indexed USING (paper_id) WHERE category = '1-URGENT' AND year >= 1995")
def count_indexed(s: SparkSession, d: str) -> DataFrame:
    p = M.papers(s, d).filter(R.all_of(F.col("category") == "1-URGENT", None, F.col("year") >= 1995))
    return R.indexed_only(p, _indexed(s, d)).agg(F.count(F.lit(1)).alias("n"))


for _by in ("category", "year", "month"):
    register(f"AGG02_histogram_{_by}", f"SELECT {_by} AS value, count(*) AS n FROM papers SEMI JOIN indexed USING (paper_id) GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 21")(lambda s, d, by=_by: R.histogram(R.indexed_only(M.papers(s, d), _indexed(s, d)), by, 20))


@register("AGG03_corpus_stats", "SELECT count(*) AS papers, min(year) AS first_year, max(year) AS last_year, count(DISTINCT category) AS categories, (SELECT count(*) FROM chunks) AS chunks FROM papers SEMI JOIN indexed USING (paper_id)")
def corpus_stats(s: SparkSession, d: str) -> DataFrame:
    n = M.chunks(s, d).agg(F.count(F.lit(1)).alias("chunks")).withColumn("k", F.lit(1))
    p = R.indexed_only(M.papers(s, d), _indexed(s, d)).agg(F.count(F.lit(1)).alias("papers"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.countDistinct("category").alias("categories")).withColumn("k", F.lit(1))
    return p.join(n, "k").drop("k")


@register("AGG04_paper_facets", "SELECT p.paper_id, p.category, p.year, count(c.paper_id) AS n_chunks, coalesce(max(c.page_end), 0) AS last_page FROM papers p LEFT JOIN chunks c USING (paper_id) GROUP BY ALL")
def paper_facets(s: SparkSession, d: str) -> DataFrame:
    c = M.chunks(s, d).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("page_end").alias("last_page"))
    return M.papers(s, d).join(c, "paper_id", "left").select("paper_id", "category", "year", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("last_page", F.lit(0)).alias("last_page"))


@register("AGG09_cohort_months", "SELECT month, n FROM (SELECT month, count(DISTINCT citing_id) AS n, sum(count(DISTINCT citing_id)) OVER () AS total FROM citations JOIN papers ON citing_id = paper_id GROUP BY month) WHERE n >= 0.01 * total")
def cohort_months(s: SparkSession, d: str) -> DataFrame:
    citing = M.papers(s, d).join(M.citations(s, d), F.col("paper_id") == F.col("citing_id"), "left_semi")
    months = citing.groupBy("month").agg(F.count(F.lit(1)).alias("n"))  # few rows
    return months.withColumn("total", F.sum("n").over(Window.partitionBy())).filter("n >= 0.01 * total").select("month", "n")


@register("AGG11_month_coverage", "SELECT month, count(DISTINCT p.paper_id) AS papers, count(DISTINCT p.paper_id) FILTER (has_text) AS with_text, count(cited_id) AS refs FROM papers p LEFT JOIN citations ON citing_id = p.paper_id GROUP BY month")
def month_coverage(s: SparkSession, d: str) -> DataFrame:
    refs = M.citations(s, d).groupBy("citing_id").agg(F.count(F.lit(1)).alias("refs"))
    p = M.papers(s, d).join(refs, F.col("paper_id") == F.col("citing_id"), "left")
    return p.groupBy("month").agg(F.count(F.lit(1)).alias("papers"), F.count_if("has_text").alias("with_text"), F.coalesce(F.sum("refs"), F.lit(0)).alias("refs"))


@register("AGG13_category_census", "SELECT month, category, count(*) AS n FROM papers GROUP BY 1, 2")
def category_census(s: SparkSession, d: str) -> DataFrame:
    return M.papers(s, d).groupBy("month", "category").agg(F.count(F.lit(1)).alias("n"))


@register("AGG21_spend_by_day", "SELECT day, coalesce(sum(cost), 0.0) AS spend, count(*) AS runs FROM (SELECT day, CAST(round(cost * 100) AS BIGINT) AS cost FROM runs) GROUP BY day".replace("0.0", "0"))
def spend_by_day(s: SparkSession, d: str) -> DataFrame:
    cents = M.runs(s, d).withColumn("cost", F.round(F.col("cost") * 100).cast("long"))
    return cents.groupBy("day").agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("spend"), F.count(F.lit(1)).alias("runs"))


@register("AGG32_latency", "SELECT tool, median(cost) AS p50, max(cost) AS worst, list_sort(list(cost))[greatest(1, CAST(floor(0.95 * count(*)) AS BIGINT))] AS p95 FROM runs GROUP BY tool")
def latency(s: SparkSession, d: str) -> DataFrame:
    return R.quantiles(M.runs(s, d), "tool", "cost").select("tool", "p50", "worst", "p95")


@register("WIN03_newest_citers", "SELECT cited_id, cited_by, citing_id, turn FROM (SELECT c.*, cited_by, CAST(row_number() OVER (PARTITION BY cited_id ORDER BY citing_id DESC) AS INTEGER) AS turn FROM citations c JOIN (SELECT cited_id, count(*) AS cited_by FROM citations GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50) USING (cited_id)) WHERE turn <= 8")
def newest_citers(s: SparkSession, d: str) -> DataFrame:
    return R.newest_citers(M.citations(s, d), 50, 8)


@register("WIN02_rank_norm", "SELECT paper_id, CASE WHEN n = 1 THEN 0.5 ELSE (2 * (r - 1) + ties - 1) / 2.0 / (n - 1) END AS norm FROM (SELECT paper_id, rank() OVER (PARTITION BY month ORDER BY size) AS r, count(*) OVER (PARTITION BY month, size) AS ties, count(*) OVER (PARTITION BY month) AS n FROM papers)")
def rank_norm(s: SparkSession, d: str) -> DataFrame:
    return R.rank_norm(M.papers(s, d), "size", ["month"]).select("paper_id", "norm")


@register("WIN05_page_budget", "SELECT paper_id, seq, n_tokens, running FROM (SELECT paper_id, seq, n_tokens, sum(n_tokens) OVER w AS running, row_number() OVER w AS k FROM chunks WINDOW w AS (PARTITION BY paper_id ORDER BY seq, n_tokens ROWS UNBOUNDED PRECEDING)) WHERE k = 1 OR running <= 60")
def page_budget(s: SparkSession, d: str) -> DataFrame:
    c = M.chunks(s, d).select("paper_id", "seq", "n_tokens")
    return R.within_budget(c, ["paper_id"], ["seq", "n_tokens"], "n_tokens", 60)


@register("SET01_scope", "SELECT citing_id AS paper_id FROM citations SEMI JOIN indexed ON paper_id = citing_id WHERE cited_id = 7 UNION SELECT paper_id FROM indexed WHERE paper_id = 7")
def scope(s: SparkSession, d: str) -> DataFrame:
    i = _indexed(s, d)
    citers = M.citations(s, d).filter("cited_id = 7").select(F.col("citing_id").alias("paper_id")).join(i, "paper_id", "left_semi")
    return citers.union(i.filter("paper_id = 7")).distinct()


@register("SRT01_catalog_page", "SELECT paper_id, month, category FROM papers ORDER BY published DESC, paper_id DESC LIMIT 25 OFFSET 50")
def catalog_page(s: SparkSession, d: str) -> DataFrame:
    p = M.papers(s, d)
    keys = p.select("paper_id", "published").orderBy(F.desc("published"), F.desc("paper_id")).offset(50).limit(25)
    return p.join(F.broadcast(keys.select("paper_id")), "paper_id", "left_semi").select("paper_id", "month", "category")


@register("RET06_cosine_knn", """SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id) QUALIFY rank <= 10""", views=False)
def cosine_knn(s: SparkSession, d: str) -> DataFrame:
    """The ten nearest other vectors of every fiftieth one: one more is asked for, as a vector mostly finds itself."""
    e = M.load(s, d, "embeddings")
    near = E.knn_batch(e.filter("vec_id % 50 = 0"), e, 11).filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter("rank <= 10").select("query_id", "vec_id", "rank")


@register("AGG22_document_frequency", r"SELECT word, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM documents) GROUP BY word", views=False)
def document_frequency(s: SparkSession, d: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)")))
    return M.load(s, d, "documents").select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
