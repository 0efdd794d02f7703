"""Queries of the catalog, the landing page and the census."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.functions import scalars as X
from lakelens.operators import catalog as C
from lakelens.operators import census as N
from lakelens.operators import relational as R
from lakelens.plans import mapping as M
from lakelens.plans.registry import register


def _indexed(s: SparkSession, d: str) -> DataFrame:
    return M.chunks(s, d).filter("section = 'R'").select("paper_id")


def _flagged(s: SparkSession, d: str) -> DataFrame:
    papers = M.catalog(s, d).join(M.papers(s, d).select("paper_id", "year"), "paper_id")
    return C.with_flags(papers, _indexed(s, d), M.citations(s, d))


def _coverage(s: SparkSession, d: str) -> DataFrame:
    return N.month_coverage(M.papers(s, d), M.citations(s, d), M.census(s, d))


_FLAGGED = """, flagged AS (SELECT c.*, year(o_orderdate) AS year, c.paper_id IN (FROM indexed) AS indexed, coalesce(k, 0) AS cited_by
  FROM catalog c JOIN orders ON o_orderkey = c.paper_id LEFT JOIN (SELECT cited_id, count(*) AS k FROM citations GROUP BY 1) ON cited_id = c.paper_id)"""


@register("FLT01_indexed_flag", _FLAGGED + "SELECT paper_id, indexed FROM flagged", "catalog")
def indexed_flag(s: SparkSession, d: str) -> DataFrame:
    return _flagged(s, d).select("paper_id", "indexed")


_WHERES = {
    "open": C.Where(),
    "category": C.Where(category="2-HIGH", holding="indexed"),
    "years": C.Where(year_min=1995, year_max=1996, holding="indexed"),
    "licensed": C.Where(licensed=True, holding="indexed"),
    "unlicensed": C.Where(licensed=False, year_min=1997, category="5-LOW"),
}


@register("FLT02_where_builder", _FLAGGED + """SELECT 'open' AS variant, count(*) AS n FROM flagged
UNION ALL SELECT 'category', count(*) FROM flagged WHERE category = '2-HIGH' AND indexed
UNION ALL SELECT 'years', count(*) FROM flagged WHERE year BETWEEN 1995 AND 1996 AND indexed
UNION ALL SELECT 'licensed', count(*) FROM flagged WHERE license IS NOT NULL AND indexed
UNION ALL SELECT 'unlicensed', count(*) FROM flagged WHERE license IS NULL AND year >= 1997 AND category = '5-LOW'""", "catalog")
def where_builder(s: SparkSession, d: str) -> DataFrame:
    cells = [F.when(w.column(), F.lit(name)) for name, w in _WHERES.items()]
    return _flagged(s, d).select(F.explode(F.array_compact(F.array(*cells))).alias("variant")).groupBy("variant").agg(F.count(F.lit(1)).alias("n"))


@register("FLT03_catalog_where", _FLAGGED + "SELECT paper_id, pid, holding FROM (SELECT *, unnest(['all', 'text', 'indexed']) AS holding FROM flagged WHERE category = '3-MEDIUM' AND month = '9504') WHERE holding = 'all' OR (holding = 'text' AND has_text) OR (holding = 'indexed' AND indexed)", "catalog")
def catalog_where(s: SparkSession, d: str) -> DataFrame:
    f = _flagged(s, d)
    cells = [F.when(C.Where("3-MEDIUM", "9504", h).column(), F.lit(h)) for h in C.HOLDINGS]
    return f.select("paper_id", "pid", F.explode(F.array_compact(F.array(*cells))).alias("holding"))


@register("FLT06_scope", "SELECT 'none' AS scope, count(*) AS n FROM papers UNION ALL SELECT 'some', count(*) FROM papers WHERE paper_id IN (1, 7, 99, -5)")
def scopes(s: SparkSession, d: str) -> DataFrame:
    p = M.papers(s, d).select("paper_id")
    parts = [R.in_scope(p, "paper_id", ids).select(F.lit(name).alias("scope")) for name, ids in (("none", None), ("empty", []), ("some", [1, 7, 99, -5]))]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


@register("FLT10_id_prefix", "SELECT count(*) AS n, min(pid) AS first, max(pid) AS last FROM catalog WHERE pid LIKE '9504.%'", "catalog")
def id_prefix(s: SparkSession, d: str) -> DataFrame:
    return M.catalog(s, d).filter(F.col("pid").startswith("9504.")).agg(F.count(F.lit(1)).alias("n"), F.min("pid").alias("first"), F.max("pid").alias("last"))


@register("FLT14_contract_view", "SELECT pid AS doc_id, title, CASE WHEN length(published) >= 10 THEN CAST(replace(published, '-', '') AS INTEGER) ELSE (CASE WHEN CAST(month[1:2] AS INTEGER) >= 90 THEN 1900 ELSE 2000 END + CAST(month[1:2] AS INTEGER)) * 10000 + 101 END AS day, version FROM catalog", "catalog")
def contract_view(s: SparkSession, d: str) -> DataFrame:
    return M.catalog(s, d).select(F.col("pid").alias("doc_id"), "title", X.paper_day(F.col("published"), F.col("pid")).alias("day"), "version")


@register("FLT15_existence", "SELECT DISTINCT l_orderkey AS paper_id, l_linenumber + 2 AS page, l_orderkey IN (FROM indexed) AS paper_known, coalesce(l_linenumber + 2 <= last_page, false) AS page_known FROM lineitem LEFT JOIN (SELECT paper_id, max(page_end) AS last_page FROM chunks WHERE section = 'R' GROUP BY 1) ON paper_id = l_orderkey")
def existence(s: SparkSession, d: str) -> DataFrame:
    asked = M.load(s, d, "lineitem").select(F.col("l_orderkey").alias("paper_id"), (F.col("l_linenumber") + 2).alias("page")).distinct()
    last = M.chunks(s, d).filter("section = 'R'").groupBy("paper_id").agg(F.max("page_end").alias("last_page"))
    known = asked.join(last, "paper_id", "left")
    return known.select("paper_id", "page", F.col("last_page").isNotNull().alias("paper_known"), F.coalesce(F.col("page") <= F.col("last_page"), F.lit(False)).alias("page_known"))


@register("FLT16_scope_guard", ", scope AS (SELECT citing_id AS paper_id FROM citations SEMI JOIN indexed ON paper_id = citing_id WHERE cited_id = 7) SELECT paper_id, paper_id IN (FROM scope) AS allowed FROM indexed")
def scope_guard(s: SparkSession, d: str) -> DataFrame:
    asked = _indexed(s, d).distinct()
    scope = M.citations(s, d).filter("cited_id = 7").select(F.col("citing_id").alias("paper_id")).distinct().withColumn("allowed", F.lit(True))
    return asked.join(scope, "paper_id", "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


for _by in ("license", "venue"):
    register(f"AGG02_histogram_{_by}", f"SELECT {_by} AS value, count(*) AS n FROM catalog SEMI JOIN indexed USING (paper_id) GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 21", "catalog")(lambda s, d, by=_by: R.histogram(R.indexed_only(M.catalog(s, d), _indexed(s, d)), by, 20))


@register("AGG04_point_facets", "SELECT pid, title, category, license, venue, version, count(k.paper_id) AS n_chunks, coalesce(max(page_end), 0) AS last_page FROM catalog c LEFT JOIN chunks k USING (paper_id) GROUP BY ALL", "catalog")
def point_facets(s: SparkSession, d: str) -> DataFrame:
    chunks = M.chunks(s, d).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("page_end").alias("last_page"))
    p = M.catalog(s, d).join(chunks, "paper_id", "left")
    return p.select("pid", "title", "category", "license", "venue", "version", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("last_page", F.lit(0)).alias("last_page"))


@register("AGG06_foundation", "SELECT w.*, count(*) AS cited_by FROM citations JOIN works w ON cited_id = work_id WHERE cited_id = 7 GROUP BY ALL")
def foundation(s: SparkSession, d: str) -> DataFrame:
    return N.foundation(M.citations(s, d), M.works(s, d), 7)


@register("AGG10_cohort_stats", """SELECT (SELECT min(month) FROM cohort) AS cohort_start, (SELECT max(month) FROM cohort) AS cohort_end, p AS cohort_papers,
 CASE WHEN c >= p THEN CAST(c AS BIGINT) END AS cohort_catalog_papers, (SELECT count(*) FROM papers WHERE has_text) AS papers_parsed, (SELECT count(DISTINCT citing_id) FROM citations) AS papers_with_references,
 (SELECT count(*) FROM citations) AS citations, (SELECT count(DISTINCT cited_id) FROM citations) AS cited_works, (SELECT count(*) FROM papers SEMI JOIN indexed USING (paper_id)) AS readable_papers
FROM (SELECT (SELECT count(*) FROM papers SEMI JOIN cohort USING (month)) AS p, (SELECT sum(cs_papers) FROM census SEMI JOIN cohort USING (month)) AS c)""", "catalog")
def cohort_stats(s: SparkSession, d: str) -> DataFrame:
    return N.cohort_stats(M.papers(s, d), M.citations(s, d), _indexed(s, d), M.census(s, d))


@register("JOI03_month_coverage", "SELECT month, papers_held, papers_parsed, refs_made, CAST(catalog_papers AS BIGINT) AS catalog_papers FROM coverage", "catalog")
def coverage(s: SparkSession, d: str) -> DataFrame:
    return _coverage(s, d)


@register("AGG12_complete_census_months", "SELECT month FROM complete", "catalog")
def complete(s: SparkSession, d: str) -> DataFrame:
    return N.complete_months(_coverage(s, d)).select("month")


@register("AGG13_top_categories", """, t AS (SELECT category FROM catalog SEMI JOIN complete USING (month) WHERE category IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3),
l AS (SELECT month, category, (SELECT count(*) FROM catalog c WHERE c.month = complete.month AND c.category = t.category) AS n FROM complete, t)
SELECT * FROM l UNION ALL SELECT month, 'other', papers_held - (SELECT CAST(sum(n) AS BIGINT) FROM l WHERE l.month = coverage.month) FROM coverage SEMI JOIN complete USING (month)""", "catalog")
def top_categories(s: SparkSession, d: str) -> DataFrame:
    return N.category_census(M.catalog(s, d), _coverage(s, d), 3)


@register("AGG14_excluded_cohort_months", "SELECT month, papers_held, catalog_papers FROM coverage SEMI JOIN cohort USING (month) ANTI JOIN complete USING (month)", "catalog")
def excluded(s: SparkSession, d: str) -> DataFrame:
    return N.excluded_months(_coverage(s, d), N.cohort_months(M.papers(s, d), M.citations(s, d)))


_NEXT = "CASE WHEN {0}[3:4] = '12' THEN printf('%02d01', CAST({0}[1:2] AS INTEGER) + 1) ELSE printf('%02d%02d', CAST({0}[1:2] AS INTEGER), CAST({0}[3:4] AS INTEGER) + 1) END"
_PAIRS = f", pairs AS (SELECT from_month, to_month FROM (SELECT month AS from_month, lead(month) OVER (ORDER BY month) AS to_month FROM complete) WHERE to_month = {_NEXT.format('from_month')}), pair AS (FROM pairs ORDER BY from_month DESC LIMIT 1)"


@register("JOI13_month_pairs", _PAIRS + " FROM pairs", "catalog")
def month_pairs(s: SparkSession, d: str) -> DataFrame:
    return N.consecutive(N.complete_months(_coverage(s, d)))


def _last_pair(s: SparkSession, d: str) -> DataFrame:
    return month_pairs(s, d).orderBy(F.desc("from_month")).limit(1)


_UPTAKE = _PAIRS + ", e AS (SELECT cited_id, b.month AS citing_month, from_month, to_month FROM citations JOIN papers a ON a.paper_id = cited_id JOIN pair ON a.month = from_month LEFT JOIN papers b ON b.paper_id = citing_id)"


@register("AGG15_uptake_pair", _UPTAKE + "SELECT cited_id, from_month, to_month, count(*) AS cited_by, count(*) FILTER (citing_month = to_month) AS citations_from FROM e GROUP BY 1, 2, 3 HAVING count(*) FILTER (citing_month = to_month) > 0 ORDER BY citations_from DESC, cited_id LIMIT 8", "catalog")
def uptake_pair(s: SparkSession, d: str) -> DataFrame:
    return N.uptake(M.citations(s, d), M.papers(s, d).select("paper_id", "month"), _last_pair(s, d))


@register("AGG15_uptake_totals", _UPTAKE + "SELECT count(DISTINCT cited_id) AS works_total, count(*) AS edges_total FROM e WHERE citing_month = to_month", "catalog")
def uptake_totals(s: SparkSession, d: str) -> DataFrame:
    return N.uptake_totals(M.citations(s, d), M.papers(s, d).select("paper_id", "month"), _last_pair(s, d))


@register("AGG16_catalog_facets", _FLAGGED + """SELECT 'category' AS facet, category AS value, count(*) AS n FROM flagged WHERE month = '9503' AND has_text GROUP BY 2
UNION ALL SELECT 'month', month, count(*) FROM flagged WHERE category = '1-URGENT' AND has_text GROUP BY 2
UNION ALL SELECT 'holding', h, count(*) FROM (SELECT *, unnest(['all', 'text', 'indexed']) AS h FROM flagged WHERE category = '1-URGENT' AND month = '9503') WHERE h = 'all' OR h = 'text' AND has_text OR h = 'indexed' AND indexed GROUP BY 2
UNION ALL SELECT 'total', NULL, count(*) FROM flagged WHERE category = '1-URGENT' AND month = '9503' AND has_text HAVING count(*) > 0""", "catalog")
def catalog_facets(s: SparkSession, d: str) -> DataFrame:
    return C.facets(_flagged(s, d), C.Where("1-URGENT", "9503", "text"))


for _sort, _order in (("newest", "published DESC, pid DESC"), ("oldest", "published, pid"), ("cited", "cited_by DESC, pid")):
    register(f"SRT01_{_sort}", _FLAGGED + f"SELECT pid, title, published, cited_by, indexed FROM flagged WHERE has_text ORDER BY {_order} LIMIT 25 OFFSET 50", "catalog")(lambda s, d, sort=_sort: C.page(_flagged(s, d), C.Where(holding="text"), sort, 25, 50).select("pid", "title", "published", "cited_by", "indexed"))


_WIDE = ["pid", "title", "authors", "category", "published", "version", "license", "has_text", "indexed", "cited_by"]


@register("SRT02_late_rows", _FLAGGED + f"SELECT {', '.join(_WIDE)} FROM flagged ORDER BY cited_by DESC, pid LIMIT 40 OFFSET 1000", "catalog")
def late_rows(s: SparkSession, d: str) -> DataFrame:
    return C.page(_flagged(s, d), C.Where(), "cited", 40, 1000).select(*_WIDE)


@register("SRT03_next_offset", _FLAGGED + "SELECT o AS page_offset, t AS total, CASE WHEN o + least(25, greatest(t - o, 0)) < t THEN o + least(25, greatest(t - o, 0)) END AS next_offset FROM (SELECT count(*) AS t FROM flagged WHERE indexed), (SELECT unnest([0::BIGINT, 25, 100000000]) AS o)", "catalog")
def next_offsets(s: SparkSession, d: str) -> DataFrame:
    total = _flagged(s, d).filter(C.Where(holding="indexed").column()).agg(F.count(F.lit(1)).alias("total"))
    rows = total.select(F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 25, 100_000_000)])).alias("page_offset"), "total")
    after = F.col("page_offset") + F.least(F.lit(25).cast("long"), F.greatest(F.col("total") - F.col("page_offset"), F.lit(0).cast("long")))
    return rows.withColumn("next_offset", F.when(after < F.col("total"), after))


@register("SRT05_month_list", "SELECT list(month ORDER BY month) AS months FROM cohort", "catalog")
def month_list(s: SparkSession, d: str) -> DataFrame:
    return N.cohort_months(M.papers(s, d), M.citations(s, d)).agg(F.sort_array(F.collect_list("month")).alias("months"))  # a value a month


@register("JOI09_differences", """SELECT 'catalog id not held' AS kind, count(*) AS n FROM catalog WHERE paper_id NOT IN (SELECT paper_id FROM papers WHERE has_text)
UNION ALL SELECT 'citation from an unindexed paper', count(*) FROM citations WHERE citing_id NOT IN (FROM indexed)
UNION ALL SELECT 'indexed paper without references to works of size 1', count(*) FROM indexed WHERE paper_id NOT IN (SELECT citing_id FROM citations JOIN works ON cited_id = work_id WHERE year = 1)
UNION ALL SELECT 'vector without a document', count(*) FROM embeddings WHERE vec_id * 3 NOT IN (SELECT doc_id FROM documents)""", "catalog")
def differences(s: SparkSession, d: str) -> DataFrame:
    p, c, i = M.papers(s, d), M.citations(s, d), _indexed(s, d)
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    small = c.join(M.works(s, d).filter("year = 1"), F.col("cited_id") == F.col("work_id"), "left_semi").select(F.col("citing_id").alias("paper_id"))
    vectors = M.load(s, d, "embeddings").select((F.col("vec_id") * 3).alias("doc_id"))
    out = count(M.catalog(s, d).join(p.filter("has_text"), "paper_id", "left_anti"), "catalog id not held")
    out = out.union(count(c.join(i, F.col("citing_id") == F.col("paper_id"), "left_anti"), "citation from an unindexed paper"))
    out = out.union(count(i.distinct().join(small, "paper_id", "left_anti"), "indexed paper without references to works of size 1"))
    return out.union(count(vectors.join(M.load(s, d, "documents").select("doc_id"), "doc_id", "left_anti"), "vector without a document"))


_FRONTIER = "manifest AS (SELECT DISTINCT citing_id AS paper_id FROM citations SEMI JOIN (SELECT cited_id FROM citations GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50) USING (cited_id))"


@register("JOI10_unindexed_manifest", f", {_FRONTIER} SELECT paper_id FROM manifest ANTI JOIN indexed USING (paper_id)")
def unindexed_manifest(s: SparkSession, d: str) -> DataFrame:
    c = M.citations(s, d)
    top = c.groupBy("cited_id").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "cited_id").limit(50).select("cited_id")
    manifest = c.join(F.broadcast(top), "cited_id", "left_semi").select(F.col("citing_id").alias("paper_id")).distinct()
    return manifest.join(_indexed(s, d), "paper_id", "left_anti")


@register("JOI12_metadata_backfill", ", snapshot AS (SELECT paper_id, CASE WHEN paper_id % 2 = 0 THEN 'CC0' END AS license, 'v' || (paper_id % 4 + 1) AS version FROM papers WHERE has_text) SELECT pid, coalesce(s.license, c.license) AS license, coalesce(c.version, s.version) AS version FROM catalog c LEFT JOIN snapshot s USING (paper_id)", "catalog")
def metadata_backfill(s: SparkSession, d: str) -> DataFrame:
    even = F.when(F.col("paper_id") % 2 == 0, F.lit("CC0"))
    snapshot = M.papers(s, d).filter("has_text").select("paper_id", even.alias("license"), F.concat(F.lit("v"), (F.col("paper_id") % 4 + 1).cast("string")).alias("version"))
    return R.backfill(M.catalog(s, d), snapshot, "paper_id", replaced=["license"], filled=["version"]).select("pid", "license", "version")


@register("SET03_difference", "SELECT paper_id FROM papers WHERE has_text EXCEPT SELECT citing_id FROM citations WHERE cited_id % 2 = 0")
def difference(s: SparkSession, d: str) -> DataFrame:
    citing = M.citations(s, d).filter("cited_id % 2 = 0").select(F.col("citing_id").alias("paper_id"))
    return M.papers(s, d).filter("has_text").select("paper_id").join(citing, "paper_id", "left_anti").distinct()


@register("GRF03_landing", """, f AS (SELECT work_id AS id, count(*) AS n FROM citations JOIN works ON cited_id = work_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)
SELECT 'foundation' AS part, id, n FROM f UNION ALL SELECT 'cited year', year, count(*) FROM citations JOIN works ON cited_id = work_id GROUP BY 2
UNION ALL SELECT 'citations', NULL, count(*) FROM citations UNION ALL SELECT 'readable papers', NULL, count(*) FROM papers SEMI JOIN indexed USING (paper_id)""", "catalog")
def landing(s: SparkSession, d: str) -> DataFrame:
    c, w = M.citations(s, d), M.works(s, d)
    counts = c.groupBy("cited_id").agg(F.count(F.lit(1)).alias("k")).join(w, F.col("cited_id") == F.col("work_id"))
    stats = cohort_stats(s, d)
    top = counts.select(F.col("work_id").alias("id"), F.col("k").alias("n")).orderBy(F.desc("n"), "id").limit(50)
    years = counts.groupBy(F.col("year").cast("long").alias("id")).agg(F.sum("k").alias("n"))
    named = lambda df, part: df.select(F.lit(part).alias("part"), "id", "n")
    one = lambda column: stats.select(F.lit(None).cast("long").alias("id"), F.col(column).alias("n"))
    return named(top, "foundation").union(named(years, "cited year")).union(named(one("citations"), "citations")).union(named(one("readable_papers"), "readable papers"))


@register("GRF04_foundation_detail", """, co AS (SELECT o.cited_id AS id, count(*) AS n FROM citations a JOIN citations o ON a.citing_id = o.citing_id AND a.cited_id <> o.cited_id WHERE a.cited_id = 7 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8),
ci AS (SELECT paper_id, pid FROM catalog SEMI JOIN indexed USING (paper_id) WHERE paper_id IN (SELECT citing_id FROM citations WHERE cited_id = 7)),
sc AS (SELECT paper_id FROM ci UNION SELECT paper_id FROM indexed WHERE paper_id = 7)
SELECT 'co-cited' AS part, id, n FROM co UNION ALL SELECT 'indexed citer', paper_id, NULL FROM (FROM ci ORDER BY pid DESC LIMIT 8)
UNION ALL SELECT 'scope size', NULL, count(*) FROM sc UNION ALL SELECT 'total citers', 7, count(*) FROM citations JOIN works ON work_id = cited_id WHERE cited_id = 7""", "catalog")
def foundation_detail(s: SparkSession, d: str) -> DataFrame:
    c, p, i = M.citations(s, d), M.catalog(s, d), _indexed(s, d)
    null = F.lit(None).cast("long")
    co = R.co_cited(c, 7, 8).select(F.lit("co-cited").alias("part"), F.col("cited_id").alias("id"), F.col("together").alias("n"))
    citers = N.indexed_citers(c, p, i, 7, 8).select(F.lit("indexed citer"), "paper_id", null)
    scope = R.scope(c, i, 7).agg(F.count(F.lit(1)).alias("n")).select(F.lit("scope size"), null, "n")
    total = N.foundation(c, M.works(s, d), 7).select(F.lit("total citers"), "work_id", "cited_by")
    return co.union(citers).union(scope).union(total)
