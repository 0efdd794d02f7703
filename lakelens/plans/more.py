"""Further queries of the reference's own operators, registered beside those of the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelens.functions import scalars as X
from lakelens.plans import mapping as M
from lakelens.plans.registry import register


@register("JOI01_edges_with_works", "SELECT citing_id, cited_id, title, category, year FROM citations JOIN works ON cited_id = work_id")
def edges_with_works(s: SparkSession, d: str) -> DataFrame:
    return M.citations(s, d).join(M.works(s, d), F.col("cited_id") == F.col("work_id")).select("citing_id", "cited_id", "title", "category", "year")


@register("JOI05_cited_by", "SELECT work_id, (SELECT count(*) FROM citations WHERE cited_id = work_id) AS cited_by FROM works")
def cited_by(s: SparkSession, d: str) -> DataFrame:
    counts = M.citations(s, d).groupBy("cited_id").agg(F.count(F.lit(1)).alias("k"))
    return M.works(s, d).join(counts, F.col("work_id") == F.col("cited_id"), "left").select("work_id", F.coalesce("k", F.lit(0)).alias("cited_by"))


@register("JOI11_resolved_works", "SELECT c.cited_id, title, year FROM (SELECT DISTINCT cited_id + 50 AS cited_id FROM citations) c LEFT JOIN works ON work_id = c.cited_id")
def resolved_works(s: SparkSession, d: str) -> DataFrame:
    """Every cited id with what is known of it; ids beyond the last work stay, without metadata."""
    cited = M.citations(s, d).select((F.col("cited_id") + 50).alias("cited_id")).distinct()
    return cited.join(M.works(s, d), F.col("cited_id") == F.col("work_id"), "left").select("cited_id", "title", "year")


@register("AGG14_excluded_months", "SELECT month FROM papers GROUP BY month HAVING count(*) FILTER (has_text) < 0.9 * count(*)")
def excluded_months(s: SparkSession, d: str) -> DataFrame:
    return M.papers(s, d).groupBy("month").agg(F.count_if("has_text").alias("held"), F.count(F.lit(1)).alias("n")).filter("held < 0.9 * n").select("month")


@register("AGG18_chunk_distribution", "SELECT CAST(sum(n) AS DOUBLE) / count(*) AS mean, list_sort(list(n))[count(*) // 2 + 1] AS median, min(n) AS least, max(n) AS most FROM (SELECT paper_id, count(*) AS n FROM chunks GROUP BY paper_id)")
def chunk_distribution(s: SparkSession, d: str) -> DataFrame:
    # a histogram of counts is small whatever the number of papers: the median is read off its running sum
    h = M.chunks(s, d).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    total = Window.partitionBy()
    h = h.withColumn("upto", F.sum("k").over(Window.orderBy("n"))).withColumn("all", F.sum("k").over(total))
    median = F.min(F.when(F.expr("upto > all div 2"), F.col("n")))
    return h.agg((F.sum(F.col("n") * F.col("k")).cast("double") / F.sum("k")).alias("mean"), median.alias("median"), F.min("n").alias("least"), F.max("n").alias("most"))


@register("WIN04_sequence", "SELECT paper_id, seq, row_number() OVER (PARTITION BY paper_id ORDER BY seq, n_tokens) - 1 AS at FROM chunks")
def sequence(s: SparkSession, d: str) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("paper_id").orderBy("seq", "n_tokens"))
    return M.chunks(s, d).select("paper_id", "seq", (turn - 1).cast("long").alias("at"))


@register("FLT09_page_overlap", "SELECT paper_id, seq FROM chunks WHERE page_end >= 2 AND seq <= 4")
def page_overlap(s: SparkSession, d: str) -> DataFrame:
    return M.chunks(s, d).filter(X.overlaps(F.col("seq"), F.col("page_end"), 2, 4)).select("paper_id", "seq")


@register("FLT11_months_since", "SELECT paper_id, month FROM papers WHERE month >= '9506'")
def months_since(s: SparkSession, d: str) -> DataFrame:
    return M.papers(s, d).filter("month >= '9506'").select("paper_id", "month")


@register("STR02_next_month", "SELECT DISTINCT month, CASE WHEN month[3:4] = '12' THEN printf('%02d01', CAST(month[1:2] AS INTEGER) + 1) ELSE printf('%02d%02d', CAST(month[1:2] AS INTEGER), CAST(month[3:4] AS INTEGER) + 1) END AS following FROM papers")
def next_months(s: SparkSession, d: str) -> DataFrame:
    return M.papers(s, d).select("month").distinct().withColumn("following", X.next_month(F.col("month")))


@register("STR13_collapse", r"SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS digest FROM documents", views=False)
def collapsed(s: SparkSession, d: str) -> DataFrame:
    return M.load(s, d, "documents").select("doc_id", F.sha2(X.collapse(F.col("text")), 256).alias("digest"))


@register("STR15_cap_words", r"SELECT doc_id, array_to_string(string_split(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), ' ')[1:12], ' ') AS head FROM documents", views=False)
def capped(s: SparkSession, d: str) -> DataFrame:
    return M.load(s, d, "documents").select("doc_id", X.cap_words(F.col("text"), 12).alias("head"))


@register("RET07_rank_fusion", """, a AS (SELECT paper_id, row_number() OVER (ORDER BY size DESC, paper_id) AS r FROM papers QUALIFY r <= 50),
b AS (SELECT paper_id, row_number() OVER (ORDER BY published DESC, paper_id) AS r FROM papers QUALIFY r <= 50)
SELECT paper_id, round(sum(1.0::DOUBLE / (60 + r)), 12) AS score, CASE WHEN count(*) = 2 THEN 'both' ELSE min(leg) END AS found_by
FROM (SELECT *, 'size' AS leg FROM a UNION ALL SELECT *, 'date' FROM b) GROUP BY paper_id""")
def rank_fusion(s: SparkSession, d: str) -> DataFrame:
    p = M.papers(s, d)

    def leg(column: str, name: str) -> DataFrame:
        top = p.select("paper_id", column).orderBy(F.desc(column), "paper_id").limit(50)  # a fixed depth, so one small window
        return top.select("paper_id", F.row_number().over(Window.orderBy(F.desc(column), "paper_id")).alias("r"), F.lit(name).alias("leg"))

    found = F.when(F.count(F.lit(1)) == 2, F.lit("both")).otherwise(F.min("leg"))
    return leg("size", "size").union(leg("published", "date")).groupBy("paper_id").agg(F.round(F.sum(X.reciprocal_rank(F.col("r"))), 12).alias("score"), found.alias("found_by"))


@register("JOI04_indexed_citers", "SELECT citing_id FROM citations SEMI JOIN indexed ON paper_id = citing_id WHERE cited_id = 7")
def indexed_citers(s: SparkSession, d: str) -> DataFrame:
    indexed = M.chunks(s, d).filter("section = 'R'").select("paper_id")
    return M.citations(s, d).filter("cited_id = 7").join(indexed, F.col("citing_id") == F.col("paper_id"), "left_semi").select("citing_id")


@register("AGG15_uptake", "SELECT cited_id, count(*) AS total, count(*) FILTER (month = '9503') AS later FROM citations JOIN papers ON citing_id = paper_id GROUP BY cited_id HAVING count(*) FILTER (month = '9503') > 0 ORDER BY later DESC, total DESC, cited_id LIMIT 8")
def uptake(s: SparkSession, d: str) -> DataFrame:
    edges = M.citations(s, d).join(M.papers(s, d).select("paper_id", "month"), F.col("citing_id") == F.col("paper_id"))
    counts = edges.groupBy("cited_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("month") == "9503").alias("later"))
    return counts.filter("later > 0").orderBy(F.desc("later"), F.desc("total"), "cited_id").limit(8)


@register("AGG16_facets", """, p AS (SELECT category = '1-URGENT' AS in_category, year = 1995 AS in_year, * FROM papers)
SELECT 'category' AS facet, category AS value, count(*) AS n FROM p WHERE in_year GROUP BY category
UNION ALL SELECT 'year', CAST(year AS VARCHAR), count(*) FROM p WHERE in_category GROUP BY year""")
def facets(s: SparkSession, d: str) -> DataFrame:
    p = M.papers(s, d)  # one scan feeds all facets: each row counts for a facet if it passes every other filter
    each = F.array(
        F.when(F.col("year") == 1995, F.struct(F.lit("category").alias("facet"), F.col("category").alias("value"))),
        F.when(F.col("category") == "1-URGENT", F.struct(F.lit("year").alias("facet"), F.col("year").cast("string").alias("value"))),
    )
    return p.select(F.explode(F.array_compact(each)).alias("e")).groupBy("e.facet", "e.value").agg(F.count(F.lit(1)).alias("n"))


@register("AGG24_niche", "SELECT category, count(*) AS df, round(ln((SELECT count(*) FROM papers)::DOUBLE / count(*)), 9) AS idf FROM papers GROUP BY category")
def niche(s: SparkSession, d: str) -> DataFrame:
    df = M.papers(s, d).groupBy("category").agg(F.count(F.lit(1)).alias("df"))
    return df.select("category", "df", F.round(F.log(F.sum("df").over(Window.partitionBy()) / F.col("df")), 9).alias("idf"))


@register("AGG30_centroids", "SELECT label, dim, round(avg(x), 5) AS mean, count(*) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM embeddings) GROUP BY label, dim", views=False)
def centroids(s: SparkSession, d: str) -> DataFrame:
    x = M.load(s, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return x.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"), F.count(F.lit(1)).alias("n"))


@register("WIN09_windows", r"SELECT doc_id, i AS start, least(i + 1000, n) AS stop FROM (SELECT doc_id, n, unnest(range(0, greatest(n - 150, 1), 850)) AS i FROM (SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS n FROM documents) WHERE n > 0)", views=False)
def windows(s: SparkSession, d: str) -> DataFrame:
    n = F.size(F.regexp_extract_all("text", F.lit(r"([^ \t\n\x0B\f\r]+)"))).cast("long")
    docs = M.load(s, d, "documents").select("doc_id", n.alias("n")).filter("n > 0")
    return docs.select("doc_id", "n", F.explode(F.expr("sequence(0L, greatest(n - 150, 1) - 1, 850L)")).alias("start")).select("doc_id", "start", F.expr("least(start + 1000, n)").alias("stop"))


@register("WIN12_first_seen", "SELECT text_id, min(doc_id) AS doc_id FROM (SELECT sha256(coalesce(text, '')) AS text_id, doc_id FROM documents) GROUP BY text_id", views=False)
def first_seen(s: SparkSession, d: str) -> DataFrame:
    return M.load(s, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_id"), "doc_id").groupBy("text_id").agg(F.min("doc_id").alias("doc_id"))


@register("GRF02_frontier", "SELECT l_partkey AS cited_id, count(*) AS edges FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100", views=False)
def frontier(s: SparkSession, d: str) -> DataFrame:
    edges = M.load(s, d, "lineitem").groupBy(F.col("l_partkey").alias("cited_id")).agg(F.count(F.lit(1)).alias("edges"))
    return edges.orderBy(F.desc("edges"), "cited_id").limit(100)
