"""Queries of stores, indexes kept up to date, drafts, and the tools: what is written is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens import facade
from lakelens.operators import golden as G
from lakelens.operators.traces import REDACTIONS
from lakelens.plans import mapping as M
from lakelens.plans import ordered, retrieval
from lakelens.plans.registry import register
from lakelens.sources import versions, writers


def _place(s: SparkSession, name: str) -> str:
    return f"{M._folder(s)}/{name}-{uuid.uuid4().hex}"


@register("SNK01_versioned_corpus", "SELECT paper_id, CASE WHEN returned THEN 'returned' ELSE category END AS category, size FROM papers LEFT JOIN (SELECT DISTINCT paper_id, true AS returned FROM chunks WHERE section = 'R') USING (paper_id) WHERE has_text")
def versioned_corpus(s: SparkSession, d: str) -> DataFrame:
    """Papers as a version, those with returned chunks changed and those without text taken out as the next, which is read."""
    papers = M.papers(s, d).select("paper_id", "category", "size")
    store = versions.Store(s, _place(s, "corpus"))
    store.write(papers=(papers, "paper_id"))
    returned = M.chunks(s, d).filter("section = 'R'").select("paper_id")
    changed = papers.join(returned, "paper_id", "left_semi").withColumn("category", F.lit("returned"))
    store.merge("papers", changed, M.papers(s, d).filter("not has_text").select("paper_id"))
    return store.read("papers")


@register("SNK06_merged_shards", "SELECT l_orderkey AS paper_id, min_by(l_partkey, (l_linenumber, l_partkey)) AS cited_id FROM lineitem GROUP BY 1", views=False)
def merged_shards(s: SparkSession, d: str) -> DataFrame:
    """A shard for each line number, written one by one and merged: of each paper the work of its first line."""
    rows = M.load(s, d, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_partkey").alias("cited_id"), "l_linenumber")
    shards, place = rows.agg(F.max("l_linenumber")).first()[0] or 0, _place(s, "shards")
    for k in range(shards):  # as many as an order has lines
        writers.write_shard(rows.filter(F.col("l_linenumber") == k + 1).drop("l_linenumber"), place, k)
    target = _place(s, "merged")
    writers.merge_shards(s, place, target, "paper_id", shards)
    return s.read.parquet(target)


_REDACTED = "text"
for _kind, _pattern in REDACTIONS.items():
    _REDACTED = f"regexp_replace({_REDACTED}, '{_pattern}', '[{_kind}]', 'g')"


@register("TRN02_transcript_index", f"""WITH RECURSIVE c AS (SELECT conv_id, turn, role, {_REDACTED} AS text FROM conversations),
t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM c),
u AS (SELECT conv_id, CAST(turn_no AS BIGINT) AS turn_no, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS text FROM t WHERE turn_no > 0 GROUP BY 1, 2), r AS (SELECT *, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn_no) AS i FROM u),
p(conv_id, i, turn_no, text, grp, used) AS (SELECT conv_id, i, turn_no, text, 0, size FROM r WHERE i = 1 UNION ALL SELECT r.conv_id, r.i, r.turn_no, r.text, CASE WHEN used + size > 1500 THEN grp + 1 ELSE grp END, CASE WHEN used + size > 1500 THEN size ELSE used + size END FROM p JOIN r ON r.conv_id = p.conv_id AND r.i = p.i + 1)
SELECT conv_id || '#' || grp AS chunk_id, conv_id AS doc_id, min(turn_no) AS pos_start, max(turn_no) AS pos_end, substr(sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn_no)), 1, 16) AS hash FROM p GROUP BY conv_id, grp""", views=False)
def transcript_index(s: SparkSession, d: str) -> DataFrame:
    """The index is built of what users said alone, then refreshed from whole conversations; what it holds after."""
    c = M.load(s, d, "conversations")
    store = versions.Store(s, _place(s, "transcripts"))
    versions.refresh_transcripts(store, c.filter("role = 'user'"))
    versions.refresh_transcripts(store, c)
    return store.read("transcripts").select("chunk_id", "doc_id", "pos_start", "pos_end", "hash")


@register("SMP08_facet_table", f", {ordered._FACETS} SELECT paper_id, month, authority, round(niche, 6) AS niche, round(novelty, 6) AS novelty, bytes FROM facets", "catalog")
def facet_table(s: SparkSession, d: str) -> DataFrame:
    """The stored table of facets, under a name made of its inputs."""
    return ordered.paper_facets(s, d).withColumns({c: F.round(c, 6) for c in ("niche", "novelty")})


@register("EVL02_reused_drafts", "SELECT user_id AS id, max(event_id) AS at FROM events WHERE event_type = 'view' GROUP BY 1", views=False)
def reused_drafts(s: SparkSession, d: str) -> DataFrame:
    drafts = M.load(s, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("signature"), F.col("event_id").alias("at"))
    return G.reusable(drafts, "view").select("id", "at")


_WORDS = "list_transform(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{3,}'), lambda x: regexp_replace(x, 's$', ''))"


@register("EVL03_checked_records", rf"SELECT item_id, CASE WHEN item_id % 2 = 0 THEN contains(lower(text), 'thou') ELSE NOT (list_contains({_WORDS}, 'thou') OR list_contains({_WORDS}, 'ther')) END AS lexical_rule, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) BETWEEN 5 AND 40 AS question_length, true AS span_verbatim FROM benchmark WHERE text IS NOT NULL", views=False)
def checked_records(s: SparkSession, d: str) -> DataFrame:
    """Benchmark items as questions about themselves, every other one an exact match on a word."""
    b = M.load(s, d, "benchmark").filter("text is not null")
    records = b.select("item_id", F.when(F.col("item_id") % 2 == 0, "exact_match").otherwise("single_hop").alias("type"), F.col("text").alias("question"), F.array("text").alias("spans"), F.array("text").alias("texts"), F.array(F.lit("thou"), F.lit("ther")).alias("rare_terms"), F.lit("thou").alias("anchor"))
    return G.checked(records).select("item_id", "lexical_rule", "question_length", "span_verbatim")


def _corpus(s: SparkSession, d: str) -> facade.Corpus:
    indexed = M.chunks(s, d).filter("section = 'R'").select("paper_id").distinct().withColumn("indexed", F.lit(True))
    flagged = M.papers(s, d).join(indexed, "paper_id", "left").withColumn("indexed", F.coalesce("indexed", F.lit(False)))
    return facade.Corpus(flagged, M.chunks(s, d), retrieval._hybrid(s, d))


@register("MET01_corpus_stats", "SELECT count(*) AS papers, min(year) AS first_year, max(year) AS last_year, count(DISTINCT category) AS categories, (SELECT count(*) FROM chunks) AS chunks FROM papers SEMI JOIN indexed USING (paper_id)")
def corpus_stats(s: SparkSession, d: str) -> DataFrame:
    return facade.Registry(_corpus(s, d)).call("query_metadata", {"op": "corpus_stats"})


@register("RET19_search_corpus", retrieval._HYBRID + " SELECT doc_id, score, leg, rank FROM r WHERE rank <= 10", views=False)
def search_corpus(s: SparkSession, d: str) -> DataFrame:
    args = {"query": retrieval._QUERY, "k": 10, "category": "en", "year_min": 2021, "year_max": 2023}
    return facade.Registry(_corpus(s, d)).call("search_corpus", args).select("doc_id", "score", "leg", "rank")
