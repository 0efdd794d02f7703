"""Queries of ordered operators, samples and author facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.functions import text as T
from lakelens.operators import ordered as O
from lakelens.plans import mapping as M
from lakelens.plans.registry import register


def _sized(s: SparkSession, d: str) -> DataFrame:
    return M.catalog(s, d).withColumn("bytes", F.floor("size").cast("long"))


_SIZED = ", sized AS (SELECT *, CAST(floor(size) AS BIGINT) AS bytes FROM catalog)"


@register("WIN06_budget_prefix", _SIZED + "SELECT pid, CAST(running AS BIGINT) AS running FROM (SELECT pid, sum(bytes) OVER (ORDER BY month DESC, pid DESC) AS running FROM sized) WHERE running <= 50000000", "catalog")
def budget_prefix(s: SparkSession, d: str) -> DataFrame:
    return O.global_prefix(_sized(s, d), "month", [F.desc("pid")], "bytes", 50_000_000).select("pid", "running")


_MIRROR = "mirror AS (SELECT l_orderkey AS paper_id, l_linenumber AS version, CAST(floor(l_extendedprice) AS BIGINT) AS bytes, CAST(l_shipdate AS DATE) AS written FROM lineitem)"


def _mirror(s: SparkSession, d: str) -> DataFrame:
    return M.load(s, d, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("version"), F.floor("l_extendedprice").cast("long").alias("bytes"), F.to_date("l_shipdate").alias("written"))


_LATEST = f", {_MIRROR}, latest AS (SELECT paper_id, version, max(bytes) AS bytes FROM mirror JOIN (SELECT paper_id, max(version) AS version FROM mirror GROUP BY 1) USING (paper_id, version) GROUP BY 1, 2)"


def _latest(s: SparkSession, d: str) -> DataFrame:
    return O.latest(_mirror(s, d), ["paper_id"], "version", "bytes")


@register("AGG28_latest_version", _LATEST + "FROM latest")
def latest_version(s: SparkSession, d: str) -> DataFrame:
    return _latest(s, d)


@register("SMP03_latest_first", _LATEST + "SELECT paper_id, version, CAST(running AS BIGINT) AS running FROM (SELECT paper_id, version, sum(bytes) OVER (ORDER BY month DESC, paper_id DESC) AS running FROM latest JOIN papers USING (paper_id) WHERE category <> '5-LOW') WHERE running <= 20000000")
def latest_first(s: SparkSession, d: str) -> DataFrame:
    rows = _latest(s, d).join(M.papers(s, d).filter("category <> '5-LOW'").select("paper_id", "month"), "paper_id")
    return O.global_prefix(rows, "month", [F.desc("paper_id")], "bytes", 20_000_000).select("paper_id", "version", "running")


@register("AGG39_mirror_status", f", {_MIRROR} SELECT count(DISTINCT paper_id) AS ids, count(*) AS files, max(written) AS newest, (SELECT count(*) FROM papers WHERE has_text) AS held, (SELECT max(paper_id) FROM papers WHERE has_text) AS newest_held FROM mirror")
def mirror_status(s: SparkSession, d: str) -> DataFrame:
    m = _mirror(s, d).groupBy("paper_id").agg(F.count(F.lit(1)).alias("k"), F.max("written").alias("w")).agg(F.count(F.lit(1)).alias("ids"), F.sum("k").alias("files"), F.max("w").alias("newest"))
    held = M.papers(s, d).filter("has_text").agg(F.count(F.lit(1)).alias("held"), F.max("paper_id").alias("newest_held"))
    return m.join(F.broadcast(held))  # single rows


@register("WIN10_even_sample", "SELECT month, paper_id FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY paper_id) - 1 AS ps, count(*) OVER (PARTITION BY month) AS n FROM papers) WHERE n <= 5 OR list_contains(list_transform(range(5), lambda i: CAST(round_even(i * (n - 1) / 4.0, 0) AS BIGINT)), ps)")
def even_sample(s: SparkSession, d: str) -> DataFrame:
    return O.even_sample(M.papers(s, d).select("month", "paper_id"), ["month"], [F.asc("paper_id")], F.lit(5))


@register("SMP02_temporal_sample", "SELECT paper_id, CAST(running AS BIGINT) AS running FROM (SELECT *, sum(bytes) OVER (ORDER BY month, paper_id) AS running FROM (SELECT month, paper_id, CAST(floor(size) AS BIGINT) AS bytes, row_number() OVER (PARTITION BY month ORDER BY paper_id) - 1 AS ps, count(*) OVER (PARTITION BY month) AS n FROM papers) WHERE n <= 7 OR list_contains(list_transform(range(7), lambda i: CAST(round_even(i * (n - 1) / 6.0, 0) AS BIGINT)), ps)) WHERE running <= 30000000")
def temporal_sample(s: SparkSession, d: str) -> DataFrame:
    rows = M.papers(s, d).select("month", "paper_id", F.floor("size").cast("long").alias("bytes"))
    picked = O.even_sample(rows, ["month"], [F.asc("paper_id")], F.lit(7))
    return O.global_prefix(picked, "month", [F.asc("paper_id")], "bytes", 30_000_000, descending=False).select("paper_id", "running")


@register("WIN11_round_robin", "SELECT doc_id, source, CAST(turn AS INTEGER) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('s' || doc_id), doc_id) AS turn FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id // 3 ORDER BY md5('s' || doc_id), doc_id) <= 1)) ORDER BY turn, source, doc_id LIMIT 50", views=False)
def round_robin(s: SparkSession, d: str) -> DataFrame:
    docs = M.load(s, d, "documents").select("doc_id", "source", F.expr("doc_id div 3").alias("paper"))
    return O.round_robin(docs, "source", "paper", "doc_id", 50, 1, "s").select("doc_id", "source", "turn")


@register("WIN13_relabel", "SELECT label, n, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS INTEGER) AS place FROM (SELECT label, count(*) AS n FROM embeddings WHERE label <> 0 GROUP BY 1)", views=False)
def relabel(s: SparkSession, d: str) -> DataFrame:
    return O.relabel(M.load(s, d, "embeddings"), "label", 0)


_TURNS = "t AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS turn_no FROM conversations)"


def _turned(s: SparkSession, d: str) -> DataFrame:
    return O.turns(M.load(s, d, "conversations"), "conv_id", [F.asc("turn")], F.col("role") == "user")


@register("WIN15_turn_assignment", f"WITH {_TURNS} SELECT conv_id, turn, turn_no FROM t", views=False)
def turn_assignment(s: SparkSession, d: str) -> DataFrame:
    return _turned(s, d).select("conv_id", "turn", "turn_no")


@register("WIN16_titles", "SELECT conv_id, max_by(title, priority * 1000000 + turn) AS title FROM (SELECT conv_id, turn, text[1:80] AS title, CASE role WHEN 'system' THEN 2 WHEN 'assistant' THEN 1 ELSE 0 END AS priority FROM conversations) WHERE priority > 0 AND title <> '' GROUP BY 1", views=False)
def titles(s: SparkSession, d: str) -> DataFrame:
    priority = F.when(F.col("role") == "system", 2).when(F.col("role") == "assistant", 1).otherwise(0)
    return O.best_title(M.load(s, d, "conversations"), "conv_id", F.substring("text", 1, 80), priority, F.col("turn"))


_PACK = """WITH RECURSIVE r AS (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
p(conv_id, i, turn, grp, used, k) AS (SELECT conv_id, i, turn, 0, size, 1 FROM r WHERE i = 1 UNION ALL
SELECT r.conv_id, r.i, r.turn, CASE WHEN used + size > {most} OR k >= {items} THEN grp + 1 ELSE grp END, CASE WHEN used + size > {most} OR k >= {items} THEN size ELSE used + size END, CASE WHEN used + size > {most} OR k >= {items} THEN 1 ELSE k + 1 END
FROM p JOIN r ON r.conv_id = p.conv_id AND r.i = p.i + 1) SELECT conv_id, turn, grp AS "group" FROM p"""


def _lengths(s: SparkSession, d: str) -> DataFrame:
    return M.load(s, d, "conversations").select("conv_id", "turn", F.length("text").alias("size"))


@register("WIN07_greedy_packing", _PACK.format(most=900, items=10**9), views=False)
def greedy_packing(s: SparkSession, d: str) -> DataFrame:
    return O.greedy_groups(_lengths(s, d), "conv_id", "turn", "size", 900)


@register("WIN08_greedy_batches", _PACK.format(most=2000, items=3), views=False)
def greedy_batches(s: SparkSession, d: str) -> DataFrame:
    return O.greedy_groups(_lengths(s, d), "conv_id", "turn", "size", 2000, 3)


@register("WIN18_evict_oldest", """SELECT conv_id, turn, may AND total - before > 800 AS evicted FROM (SELECT *, coalesce(sum(CASE WHEN may THEN n - 10 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM (SELECT *, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id) AS total, role = 'assistant' AND turn < max(turn) OVER (PARTITION BY conv_id) AS may FROM conversations))""", views=False)
def evictions(s: SparkSession, d: str) -> DataFrame:
    c = M.load(s, d, "conversations").withColumn("n", F.length("text"))
    return O.evict_oldest(c, "conv_id", "turn", "n", 10, F.col("role") == "assistant", 800).select("conv_id", "turn", "evicted")


# ---------------------------------------------------------------- facets of papers and their authors

_EDGES = """indeg AS (SELECT cited_id AS paper_id, count(*) AS k FROM citations GROUP BY 1),
names AS (SELECT paper_id, year, unnest(string_split_regex(authors, ', | and ')) AS author FROM catalog JOIN (SELECT paper_id, year FROM papers) USING (paper_id) WHERE authors <> ''),
keys AS (SELECT DISTINCT paper_id, year, lower(string_split(author, ' ')[2]) || '|' || lower(author[1]) AS key FROM names)"""
_FACETS = _EDGES + """, old AS (SELECT key, CAST(coalesce(sum(k), 0) AS BIGINT) AS authority FROM keys LEFT JOIN indeg USING (paper_id) WHERE year <= 1996 GROUP BY 1),
tags AS (SELECT paper_id, unnest(list_distinct(list_filter([category, venue, license], lambda x: x IS NOT NULL))) AS tag FROM catalog), df AS (SELECT tag, count(*) AS df FROM tags GROUP BY 1),
niche AS (SELECT paper_id, ln((SELECT count(*) FROM catalog)::DOUBLE / coalesce(min(df), (SELECT count(*) FROM catalog))) AS niche FROM catalog LEFT JOIN tags USING (paper_id) LEFT JOIN df USING (tag) GROUP BY 1),
novel AS (SELECT paper_id, avg(CASE WHEN o.key IS NULL THEN 1.0 ELSE 0.0 END) AS novelty, max(coalesce(o.authority, 0)) AS best FROM keys k LEFT JOIN old o ON o.key = k.key GROUP BY 1),
facets AS (SELECT c.paper_id, month, CAST(CASE WHEN p.year <= 1994 THEN coalesce(k, 0) ELSE coalesce(best, 0) END AS DOUBLE) AS authority, niche, coalesce(novelty, 0.0) AS novelty, CAST(floor(c.size) AS BIGINT) AS bytes
  FROM catalog c JOIN (SELECT paper_id, year FROM papers) p USING (paper_id) LEFT JOIN indeg USING (paper_id) LEFT JOIN niche USING (paper_id) LEFT JOIN novel USING (paper_id))"""


def _keys(s: SparkSession, d: str) -> DataFrame:
    """paper_id, year and key, distinct. Keys of a paper stay one list until it has met its year: rows of single keys would be held by the million to tell them apart."""
    years = M.papers(s, d).select("paper_id", "year")

    def key(name: Column) -> Column:
        part = F.split(name, " ")
        return T.author_key(F.try_element_at(part, F.lit(2)), F.try_element_at(part, F.lit(1)))

    papers = M.catalog(s, d).filter("authors <> ''").select("paper_id", F.array_distinct(F.transform(F.split("authors", ", | and "), key)).alias("keys"))
    lists = papers.join(years, "paper_id").groupBy("paper_id", "year").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"))
    return lists.select("paper_id", "year", F.explode("keys").alias("key"))


def _old(s: SparkSession, d: str) -> DataFrame:
    indeg = M.citations(s, d).groupBy(F.col("cited_id").alias("paper_id")).agg(F.count(F.lit(1)).alias("k"))
    return _keys(s, d).filter("year <= 1996").join(indeg, "paper_id", "left").groupBy("key").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("authority"))


def paper_facets(s: SparkSession, d: str) -> DataFrame:
    """authority, niche, novelty of every paper: a table made once for the papers and citations as they are."""
    return M.prepared(s, d, ("orders", "lineitem"), "facets", lambda: _facets(s, d))


def _facets(s: SparkSession, d: str) -> DataFrame:
    indeg = M.citations(s, d).groupBy(F.col("cited_id").alias("paper_id")).agg(F.count(F.lit(1)).alias("k"))
    old = _old(s, d)
    c = M.catalog(s, d)
    n_docs = c.count()
    tags = c.select("paper_id", F.explode(F.array_distinct(F.array_compact(F.array("category", "venue", "license")))).alias("tag"))
    df = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("df"))
    niche = tags.join(df, "tag").groupBy("paper_id").agg(F.min("df").alias("df"))
    novel = _keys(s, d).join(old, "key", "left").groupBy("paper_id").agg(F.avg(F.when(F.col("authority").isNull(), 1.0).otherwise(0.0)).alias("novelty"), F.max(F.coalesce("authority", F.lit(0))).alias("best"))
    out = c.join(M.papers(s, d).select("paper_id", "year"), "paper_id").join(indeg, "paper_id", "left").join(niche, "paper_id", "left").join(novel, "paper_id", "left")
    own = F.when(F.col("year") <= 1994, F.coalesce("k", F.lit(0))).otherwise(F.coalesce("best", F.lit(0)))
    return out.select("paper_id", "month", own.cast("double").alias("authority"), F.log(F.lit(n_docs) / F.coalesce("df", F.lit(n_docs))).alias("niche"), F.coalesce("novelty", F.lit(0.0)).alias("novelty"), F.floor("size").cast("long").alias("bytes"))


@register("AGG25_author_authority", f", {_FACETS} SELECT key, authority FROM old", "catalog")
def author_authority(s: SparkSession, d: str) -> DataFrame:
    return _old(s, d)


for _id, _c in (("AGG24_niche_idf", "niche"), ("AGG26_author_novelty", "novelty"), ("AGG27_authority", "authority")):
    register(_id, f", {_FACETS} SELECT paper_id, round({_c}, 6) AS {_c} FROM facets", "catalog")(lambda s, d, c=_c: paper_facets(s, d).select("paper_id", F.round(c, 6).alias(c)))


def _rank_sql(column: str) -> str:
    return f"CASE WHEN count(*) OVER m = 1 THEN 0.5 ELSE (2 * (rank() OVER (PARTITION BY month ORDER BY {column}) - 1) + count(*) OVER (PARTITION BY month, {column}) - 1) / 2.0 / (count(*) OVER m - 1) END"


_ROUNDED = ", rounded AS (SELECT paper_id, month, bytes, authority, round(niche, 9) AS niche, round(novelty, 9) AS novelty, paper_id % 4 + 1 AS revisions, paper_id % 3 AS venue FROM facets)"
_COMPOSITE = f", {_FACETS}{_ROUNDED}, scored AS (SELECT paper_id, month, bytes, round(({' + '.join(f'{w} * ({_rank_sql(k)})' for k, w in O.WEIGHTS.items())})::DOUBLE, 9) AS score FROM rounded WINDOW m AS (PARTITION BY month))"


def _scored(s: SparkSession, d: str) -> DataFrame:
    f = paper_facets(s, d)
    columns = {"authority": F.col("authority"), "niche": F.round("niche", 9), "novelty": F.round("novelty", 9), "revisions": F.col("paper_id") % 4 + 1, "venue": F.col("paper_id") % 3}
    return O.composite(f, "month", columns)


@register("MTH01_composite_score", f"{_COMPOSITE} SELECT paper_id, score FROM scored", "catalog")
def composite_score(s: SparkSession, d: str) -> DataFrame:
    return _scored(s, d).select("paper_id", "score")


@register("SMP01_diverse_sample", f"""{_COMPOSITE}, have AS (SELECT month, count(*) AS have FROM papers WHERE has_text AND paper_id % 50 = 0 GROUP BY 1),
c AS (SELECT s.*, 12 - coalesce(have, 0) AS k, row_number() OVER (PARTITION BY month ORDER BY score, paper_id) - 1 AS ps, count(*) OVER (PARTITION BY month) AS n FROM scored s LEFT JOIN have USING (month) WHERE paper_id % 50 <> 0 AND bytes >= 50000),
p AS (SELECT * FROM c WHERE k > 0 AND (n <= k OR (k = 1 AND ps = n // 2) OR (k > 1 AND list_contains(list_transform(range(k), lambda i: CAST(round_even(i * (n - 1) / (k - 1)::DOUBLE, 0) AS BIGINT)), ps))))
SELECT paper_id, CAST(running AS BIGINT) AS running FROM (SELECT *, sum(bytes) OVER (ORDER BY month, score, paper_id) AS running FROM p) WHERE running <= 100000000""", "catalog")
def diverse_sample(s: SparkSession, d: str) -> DataFrame:
    have = M.papers(s, d).filter("has_text and paper_id % 50 = 0").groupBy("month").agg(F.count(F.lit(1)).alias("have"))
    rows = _scored(s, d).filter("paper_id % 50 <> 0 and bytes >= 50000").join(F.broadcast(have), "month", "left")  # a row a month
    picked = O.even_sample(rows, ["month"], [F.asc("score"), F.asc("paper_id")], F.lit(12) - F.coalesce("have", F.lit(0)))
    return O.global_prefix(picked, "month", [F.asc("score"), F.asc("paper_id")], "bytes", 100_000_000, descending=False).select("paper_id", "running")


@register("SMP05_missing_ids", "SELECT month, count(*) FILTER (has_text) AS held, count(*) FILTER (NOT has_text) AS missing, min(pid) FILTER (NOT has_text) AS first_missing FROM catalog GROUP BY month", "catalog")
def missing_ids(s: SparkSession, d: str) -> DataFrame:
    c, held = M.catalog(s, d), M.papers(s, d).filter("has_text").select("paper_id", F.lit(True).alias("held"))
    lacks = F.col("held").isNull()
    return c.join(held, "paper_id", "left").groupBy("month").agg(F.count("held").alias("held"), F.count_if(lacks).alias("missing"), F.min(F.when(lacks, F.col("pid"))).alias("first_missing"))


@register("SMP06_named_ids", f", {_MIRROR} SELECT w.paper_id, coalesce(m.version, x.version) AS version FROM (SELECT paper_id, CAST(paper_id % 9 AS INTEGER) AS version FROM papers WHERE NOT has_text) w JOIN (SELECT paper_id, max(version) AS version FROM mirror GROUP BY 1) x USING (paper_id) LEFT JOIN (SELECT DISTINCT paper_id, version FROM mirror) m ON m.paper_id = w.paper_id AND m.version = w.version")
def named_ids(s: SparkSession, d: str) -> DataFrame:
    wanted = M.papers(s, d).filter("not has_text").select("paper_id", (F.col("paper_id") % 9).cast("int").alias("version"))
    m = _mirror(s, d)
    there = m.select("paper_id", "version", F.col("version").alias("exact")).distinct()
    newest = m.groupBy("paper_id").agg(F.max("version").alias("newest"))
    return wanted.join(newest, "paper_id").join(there, ["paper_id", "version"], "left").select("paper_id", F.coalesce("exact", "newest").alias("version"))


@register("SMP07_backfill_window", "SELECT pid FROM (SELECT pid, sum(CAST(floor(size) AS BIGINT)) OVER (ORDER BY month DESC, pid DESC) AS running FROM catalog WHERE NOT has_text AND (published = '' OR published BETWEEN '1995-03-01' AND '1996-02-28') AND category[1:1] IN ('1', '2')) WHERE running <= 15000000", "catalog")
def backfill_window(s: SparkSession, d: str) -> DataFrame:
    c = _sized(s, d).filter("published = '' or (published >= '1995-03-01' and published <= '1996-02-28')").filter(F.substring("category", 1, 1).isin("1", "2"))
    todo = c.join(M.papers(s, d).filter("has_text").select("paper_id"), "paper_id", "left_anti")
    return O.global_prefix(todo, "month", [F.desc("pid")], "bytes", 15_000_000).select("pid")
