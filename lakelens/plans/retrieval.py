"""Queries of lexical, vector and hybrid retrieval, and of their evaluation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelens.operators import evals as E
from lakelens.operators import hybrid as H
from lakelens.operators import inverted, latent, reranker
from lakelens.operators import lexical as L
from lakelens.operators.relational import once
from lakelens.plans import mapping as M
from lakelens.plans.registry import register

_SPACE = r"[^ \t\n\x0B\f\r]+"
#: Windows of 200 words with 30 in common, as chunks of documents.
CHUNKED = rf"""w AS (SELECT doc_id, lang, source, regexp_extract_all(text, '{_SPACE}') AS w FROM documents),
chunked AS (SELECT doc_id, lang, source, CAST(i // 170 AS INTEGER) AS seq, doc_id || '#' || (i // 170) AS chunk_id, array_to_string(w[i + 1:i + 200], ' ') AS text, CAST(least(200, len(w) - i) AS INTEGER) AS n_tokens
  FROM (SELECT *, unnest(range(0, greatest(len(w) - 30, 1), 170)) AS i FROM w WHERE len(w) > 0)),
tok AS (SELECT chunk_id, doc_id, lang, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS t FROM chunked)"""


def chunked(s: SparkSession, d: str) -> DataFrame:
    w = F.regexp_extract_all("text", F.lit(f"({_SPACE})"))
    docs = once(M.load(s, d, "documents").select("doc_id", "lang", "source", "text"), "w", w).drop("text").filter("size(w) > 0")
    starts = docs.withColumn("i", F.explode(F.expr("sequence(0, greatest(size(w) - 30, 1) - 1, 170)")))
    seq = F.expr("i div 170").cast("int")
    return starts.select("doc_id", "lang", "source", seq.alias("seq"), F.concat(F.col("doc_id").cast("string"), F.lit("#"), seq.cast("string")).alias("chunk_id"), F.array_join(F.expr("slice(w, i + 1, 200)"), " ").alias("text"), F.expr("least(200, size(w) - i)").alias("n_tokens"))


def bm25_sql(phrases: list[list[str]], source: str, key: str, k: int | None, scope: str = "true", every: bool = False) -> str:
    """The same scores in SQL; source has the columns key and t (tokens)."""
    distinct = list(dict.fromkeys(map(tuple, phrases)))
    lists = ["[" + ", ".join(f"'{w}'" for w in p) + "]" for p in distinct]
    f = ", ".join(f"len(list_filter(range(1, len(t) - {len(p)} + 2), lambda i: t[i:i + {len(p) - 1}] = {x})) AS f{i}" for i, (p, x) in enumerate(zip(distinct, lists, strict=True)))
    stats = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(distinct)))
    score = " + ".join(f"{phrases.count(list(p))} * greatest(ln((nd - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i, p in enumerate(distinct))
    test = (" AND " if every else " OR ").join(f"f{i} > 0" for i in range(len(distinct)))
    rank = "" if k is None else f", CAST(row_number() OVER (ORDER BY score DESC, {key}) AS INTEGER) AS rank"
    return f"""(SELECT {key}, score{rank} FROM (SELECT {key}, round((({score})::DOUBLE), 6) AS score FROM (SELECT *, len(t) AS n, {f} FROM {source}), (SELECT count(*)::DOUBLE AS nd, avg(n) AS mean, {stats} FROM (SELECT len(t) AS n, {f} FROM {source})) WHERE ({test}) AND ({scope})){'' if k is None else f' QUALIFY rank <= {k}'})"""


_QUERY = "thou eratsh  the-and thou"
_PHRASES = L.any_phrases(_QUERY)


def _index(s: SparkSession, d: str) -> inverted.Index:
    return M.indexed(s, d, "documents", "chunk-index", lambda: chunked(s, d), "chunk_id", "string", "text")


def _documents(s: SparkSession, d: str, key: str = "doc_id") -> inverted.Index:
    index = M.indexed(s, d, "documents", "document-index", lambda: M.load(s, d, "documents"), "doc_id", "bigint", "text")
    return replace(index, key=key)


def _titles(s: SparkSession, d: str) -> inverted.Index:
    return M.indexed(s, d, "orders", "title-index", lambda: M.catalog(s, d), "pid", "string", "title", "authors")


#: Built before any search, as in production: by name, for the bench to time.
INDEXES = {"chunks": _index, "documents": _documents, "titles": _titles, "neighbours": M.neighbours}


@register("RET05_tokens", rf"WITH {CHUNKED} SELECT doc_id, count(*) AS n_chunks, CAST(sum(len(t)) AS BIGINT) AS n_tokens FROM tok GROUP BY 1", views=False)
def tokens(s: SparkSession, d: str) -> DataFrame:
    return L.token_index(chunked(s, d).withColumn("key", F.col("doc_id")), "key", "text").groupBy(F.col("key").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n").alias("n_tokens"))


@register("RET05_porter_tokens")
def porter(s: SparkSession, d: str) -> DataFrame:
    """How often each stem occurs; held against published stems in the tests, since no SQL stems."""
    stems = L.token_index(M.load(s, d, "benchmark"), "item_id", "text", tokenizer="porter")
    return stems.select(F.explode("tokens").alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


@register("RET03_bm25", f"WITH {CHUNKED} FROM {bm25_sql(_PHRASES, 'tok', 'chunk_id', 20)}", views=False)
def bm25(s: SparkSession, d: str) -> DataFrame:
    return L.bm25(_index(s, d), "chunk_id", _PHRASES, 20)


@register("FLT04_bm25_scoped", f"WITH {CHUNKED} FROM " + bm25_sql(_PHRASES, "tok", "chunk_id", 20, scope="lang = 'en' AND doc_id % 2 = 0"), views=False)
def bm25_scoped(s: SparkSession, d: str) -> DataFrame:
    scope = chunked(s, d).filter("lang = 'en' and doc_id % 2 = 0").select("chunk_id")
    return L.bm25(_index(s, d), "chunk_id", _PHRASES, 20, scope)


_TITLES = ", ti AS (SELECT pid, regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+') || regexp_extract_all(lower(authors), '[\\p{L}\\p{N}]+') AS t FROM catalog)"
_TITLE_PHRASES = [["graph"], ["red"], ["lin"]]


@register("RET04_catalog_relevance", f"{_TITLES} FROM {bm25_sql(_TITLE_PHRASES, 'ti', 'pid', 30, every=True)}", "catalog")
def catalog_relevance(s: SparkSession, d: str) -> DataFrame:
    return L.bm25(_titles(s, d), "pid", _TITLE_PHRASES, 30, every=True)


@register("RET02_catalog_match", f"{_TITLES} SELECT pid FROM {bm25_sql([['graph'], ['ada', 'lin']], 'ti', 'pid', None, every=True)}", "catalog")
def catalog_match(s: SparkSession, d: str) -> DataFrame:
    return L.bm25(_titles(s, d), "pid", L.all_phrases('graph "ada lin"'), None, every=True).select("pid")


@register("JOI06_matched_rows", f"{_TITLES} SELECT pid, title, category, score FROM catalog JOIN {bm25_sql([['sparse'], ['index']], 'ti', 'pid', None, every=True)} USING (pid) WHERE has_text", "catalog")
def matched_rows(s: SparkSession, d: str) -> DataFrame:
    found = L.bm25(_titles(s, d), "pid", L.all_phrases("sparse index"), None, every=True)
    return M.catalog(s, d).filter("has_text").join(found, "pid").select("pid", "title", "category", "score")


@register("SNK02_index_terms", f"WITH {CHUNKED} SELECT term, count(DISTINCT chunk_id) AS n_docs, count(*) AS n_times FROM (SELECT chunk_id, unnest(t) AS term FROM tok) GROUP BY term", views=False)
def index_terms(s: SparkSession, d: str) -> DataFrame:
    """The vocabulary of the chunk index, from the heads of its lists."""
    return _index(s, d).terms().drop("n_blocks")


@register("RET03_phrases", f"WITH {CHUNKED} FROM {bm25_sql([['the', 'and'], ['thou']], 'tok', 'chunk_id', 20, every=True)}", views=False)
def phrases(s: SparkSession, d: str) -> DataFrame:
    return L.bm25(_index(s, d), "chunk_id", L.all_phrases('"the and" thou'), 20, every=True)


@register("FLT07_blank_query")
def blank(s: SparkSession, d: str) -> DataFrame:
    """A query of white space finds nothing, whatever the table."""
    return L.bm25(_index(s, d), "chunk_id", L.any_phrases(" \t "), 20)


# ---------------------------------------------------------------- vectors: document doc_id has vector vec_id = doc_id

_COSINE = "round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6)"


def knn_sql(query: int, k: int, scope: str = "true") -> str:
    return f"(SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM (SELECT e.vec_id, {_COSINE} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {query}) q WHERE {scope}) QUALIFY rank <= {k})"


def _query_vector(s: SparkSession, d: str, key: int) -> list[float]:
    return [float(x) for x in M.load(s, d, "embeddings").filter(F.col("vec_id") == key).first()["embedding"]]


@register("FLT05_knn_scoped", f"FROM {knn_sql(3, 15, 'e.label IN (1, 2, 3) AND e.vec_id >= 100')}", views=False)
def knn_scoped(s: SparkSession, d: str) -> DataFrame:
    e = M.load(s, d, "embeddings")
    return H.knn(e, "vec_id", _query_vector(s, d, 3), 15, e.filter("label in (1, 2, 3) and vec_id >= 100"))


@register("RET06_knn_all", f"""SELECT query_id, vec_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
FROM (SELECT q.vec_id AS query_id, e.vec_id, {_COSINE} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)) WHERE rank <= 10""", views=False)
def knn_all(s: SparkSession, d: str) -> DataFrame:
    """Every fiftieth vector asks all vectors, in blocks of queries of a bounded size."""
    e = M.load(s, d, "embeddings")
    return E.knn_batch(e.filter("vec_id % 50 = 0"), e, 10)


@register("RET06_ann_neighbours")
def ann_neighbours(s: SparkSession, d: str) -> DataFrame:
    """Every fiftieth vector asks the index of approximate neighbours; tests measure its recall against the exact search."""
    asked = M.load(s, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return M.neighbours(s, d).search(asked, 10)


@register("SNK03_indexed_vectors", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS width FROM embeddings WHERE list_dot_product(embedding, embedding) > 0", views=False)
def indexed_vectors(s: SparkSession, d: str) -> DataFrame:
    """What the lists of the index hold: every vector that has a direction, once."""
    return M.neighbours(s, d).lists().select("vec_id", F.size("x").alias("width"))


_DOCTOK = r"dt AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents)"


def _legs(s: SparkSession, d: str) -> dict[str, DataFrame]:
    e = M.load(s, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return {"vector": H.knn(e, "doc_id", _query_vector(s, d, 0), 50), "bm25": L.bm25(_documents(s, d), "doc_id", _PHRASES, 50)}


_FUSED = f"""v AS (SELECT vec_id AS doc_id, rank FROM {knn_sql(0, 50)}), b AS (SELECT doc_id, rank FROM {bm25_sql(_PHRASES, 'dt', 'doc_id', 50)}),
fused AS (SELECT doc_id, round(coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 12) AS score, CASE WHEN v.rank IS NULL THEN 'bm25' WHEN b.rank IS NULL THEN 'vector' ELSE 'both' END AS leg,
  v.rank AS rv, b.rank AS rb FROM v FULL JOIN b USING (doc_id)),
r AS (SELECT doc_id, score, leg, CAST(row_number() OVER (ORDER BY score DESC, rv NULLS LAST, rb NULLS LAST) AS INTEGER) AS rank FROM fused)"""


@register("RET07_fused_legs", f"WITH {_DOCTOK}, {_FUSED} FROM r", views=False)
def fused_legs(s: SparkSession, d: str) -> DataFrame:
    return H.fuse(_legs(s, d), "doc_id")


@register("WIN01_leg_ranks", f"WITH {_DOCTOK}, {_FUSED} SELECT 'vector' AS leg, doc_id, rank FROM v UNION ALL SELECT 'bm25', doc_id, rank FROM b", views=False)
def leg_ranks(s: SparkSession, d: str) -> DataFrame:
    parts = [leg.select(F.lit(name).alias("leg"), "doc_id", "rank") for name, leg in _legs(s, d).items()]
    return parts[0].unionByName(parts[1])


@register("SRT04_top_by_score", f"WITH {_DOCTOK}, {_FUSED} SELECT doc_id, score FROM r WHERE rank <= 10", views=False)
def top_by_score(s: SparkSession, d: str) -> DataFrame:
    return H.fuse(_legs(s, d), "doc_id", 10).select("doc_id", "score")


def _hybrid(s: SparkSession, d: str) -> H.HybridIndex:
    docs = M.load(s, d, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", "source", "text")
    documents = docs.select("doc_id", F.substring("text", 1, 20).alias("title"), (F.lit(20200101) + F.col("doc_id") % 5 * 10000).alias("day"), F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string")).alias("version"))
    facets = docs.select("doc_id", F.lit("category").alias("key"), F.col("lang").alias("value"))
    vectors = M.load(s, d, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    return H.HybridIndex(chunks, documents, facets, _documents(s, d, "chunk_id"), vectors, lambda q: _query_vector(s, d, 0))


_HYBRID_SCOPE = "doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en' AND 20200101 + doc_id % 5 * 10000 BETWEEN 20210101 AND 20231231)"
_HYBRID = f"WITH {_DOCTOK}, {_FUSED.replace(knn_sql(0, 50), knn_sql(0, 10, _HYBRID_SCOPE.replace('doc_id IN', 'e.vec_id IN'))).replace(bm25_sql(_PHRASES, 'dt', 'doc_id', 50), bm25_sql(_PHRASES, 'dt', 'doc_id', 10, scope=_HYBRID_SCOPE))}"


@register("RET08_hybrid_search", _HYBRID + " SELECT doc_id, source, sha256(text) AS digest, score, leg, rank, text[1:20] AS title, 'v' || (doc_id % 3) AS version FROM r JOIN documents USING (doc_id) WHERE rank <= 10", views=False)
def hybrid(s: SparkSession, d: str) -> DataFrame:
    rows = H.search(_hybrid(s, d), _QUERY, 10, H.Filters.of_papers("en", 2021, 2023))
    return rows.select("doc_id", "source", F.sha2("text", 256).alias("digest"), "score", "leg", "rank", "title", "version")


@register("FLT08_paper_filters", "SELECT doc_id FROM documents WHERE lang = 'de' AND 20200101 + doc_id % 5 * 10000 BETWEEN 20210101 AND 20221231", views=False)
def paper_filters(s: SparkSession, d: str) -> DataFrame:
    i = _hybrid(s, d)
    return H.Filters.of_papers("de", 2021, 2022).documents(i.documents, i.facets)


@register("JOI07_hydrate", f"WITH {_DOCTOK}, {_FUSED} SELECT rank, doc_id, leg, sha256(text) AS digest, 'v' || (doc_id % 3) AS version FROM r JOIN documents USING (doc_id)", views=False)
def hydrated(s: SparkSession, d: str) -> DataFrame:
    i = _hybrid(s, d)
    rows = H.hydrate(H.fuse(_legs(s, d), "doc_id").withColumnRenamed("doc_id", "chunk_id"), i.chunks, i.documents)
    return rows.select("rank", "doc_id", "leg", F.sha2("text", 256).alias("digest"), "version")


_ASKED = "['" + "', '".join(dict.fromkeys(w for p in _PHRASES for w in p)) + "']"


@register("RET09_rerank", f"""WITH {_DOCTOK}, {_FUSED} SELECT doc_id, rank AS fused_rank, s AS rerank_score, CAST(row_number() OVER (ORDER BY s DESC, rank) AS INTEGER) AS rank
FROM (SELECT r.doc_id, rank, round(len(list_intersect({_ASKED}, t)) / len({_ASKED}), 6) AS s FROM r JOIN dt USING (doc_id)) QUALIFY row_number() OVER (ORDER BY s DESC, fused_rank) <= 10""", views=False)
def reranked(s: SparkSession, d: str) -> DataFrame:
    i = _hybrid(s, d)
    rows = H.hydrate(H.fuse(_legs(s, d), "doc_id").withColumnRenamed("doc_id", "chunk_id"), i.chunks, i.documents)
    return H.rerank(rows, _QUERY, 10).select("doc_id", "fused_rank", "rerank_score", "rank")


@register("RET12_hash_embedding", rf"""WITH {_DOCTOK}, h AS (SELECT doc_id, ('0x' || md5(x)[1:4])::INT % 64 AS dim, count(*) AS n FROM (SELECT doc_id, unnest(t) AS x FROM dt) GROUP BY 1, 2)
SELECT doc_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS x FROM h""", views=False)
def hash_embedding(s: SparkSession, d: str) -> DataFrame:
    return E.hash_embedding(L.token_index(M.load(s, d, "documents"), "doc_id", "text"), "doc_id", 64)


@register("RET13_embedding_plan", f"WITH {CHUNKED} SELECT count(*) AS n_chunks, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, round(sum(n_tokens) * 0.02 / 1000000, 9) AS usd FROM chunked WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)", views=False)
def embedding_plan(s: SparkSession, d: str) -> DataFrame:
    done = M.load(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return E.embedding_plan(chunked(s, d), done, "doc_id", 0.02)


@register("RET15_stale_vectors", f"WITH {CHUNKED} SELECT chunk_id, CASE WHEN seq % 3 = 0 THEN 'kept' WHEN seq % 3 = 1 THEN 'changed' ELSE 'gone' END AS state FROM chunked", views=False)
def stale_vectors(s: SparkSession, d: str) -> DataFrame:
    now = chunked(s, d)
    k = F.col("seq") % 3
    stored = now.select("chunk_id", E.content_hash(F.when(k == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return E.vector_state(stored, now.filter(k != 2), "chunk_id")


@register("RET18_payload_mapping", f"WITH {CHUNKED} SELECT chunk_id, doc_id AS paper_id, seq * 170 + 1 AS page_start, seq * 170 + n_tokens AS page_end FROM chunked", views=False)
def payload(s: SparkSession, d: str) -> DataFrame:
    generic = chunked(s, d).select("chunk_id", "doc_id", (F.col("seq") * 170 + 1).alias("pos_start"), (F.col("seq") * 170 + F.col("n_tokens")).alias("pos_end"))
    return generic.withColumnsRenamed({"doc_id": "paper_id", "pos_start": "page_start", "pos_end": "page_end"})


# ---------------------------------------------------------------- evaluation: an order asks, its lines are the ranking, returned ones are expected

RANKED = """ranked AS (SELECT l_orderkey AS question, CASE l_linestatus WHEN 'F' THEN 'bm25' ELSE 'vector' END AS config, o_orderpriority AS type, l_partkey AS chunk,
  CAST(row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, l_partkey, l_quantity) AS INTEGER) AS rank FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
expected AS (SELECT DISTINCT l_orderkey AS question, l_partkey AS chunk FROM lineitem WHERE l_returnflag = 'R'),
asked AS (SELECT DISTINCT question, config, type, n FROM ranked JOIN (SELECT question, count(*) AS n FROM expected GROUP BY 1) USING (question)),
hits AS (SELECT a.question, a.config, a.type, a.n, r.chunk, r.rank, e.chunk IS NOT NULL AND r.rank <= 3 AS hit, p.question IS NOT NULL AND r.rank <= 3 AS near FROM asked a JOIN ranked r USING (question, config)
  LEFT JOIN expected e ON e.question = a.question AND e.chunk = r.chunk LEFT JOIN (SELECT DISTINCT question, chunk % 100 AS paper FROM expected) p ON p.question = a.question AND p.paper = r.chunk % 100),
scores AS (SELECT question, config, type, count(DISTINCT chunk) FILTER (hit) / max(n) AS recall, coalesce(1.0::DOUBLE / min(rank) FILTER (hit), 0.0) AS mrr,
  coalesce(sum(1 / log2(rank + 1)) FILTER (hit), 0.0) / CASE least(max(n), 3) WHEN 1 THEN 1.0 WHEN 2 THEN 1 + 1 / log2(3) ELSE 1.5 + 1 / log2(3) END AS ndcg, max(CASE WHEN near THEN 1.0 ELSE 0.0 END)::DOUBLE AS paper_recall
  FROM hits GROUP BY question, config, type)"""


def rankings(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    li = M.load(s, d, "lineitem").join(M.load(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    w = Window.partitionBy("l_orderkey", "l_linestatus").orderBy("l_linenumber", "l_partkey", "l_quantity")
    ranked = li.select(F.col("l_orderkey").alias("question"), F.when(F.col("l_linestatus") == "F", "bm25").otherwise("vector").alias("config"), F.col("o_orderpriority").alias("type"), F.col("l_partkey").alias("chunk"), F.row_number().over(w).alias("rank"))
    expected = M.load(s, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("question"), F.col("l_partkey").alias("chunk")).distinct()
    return ranked, expected


def _scores(s: SparkSession, d: str) -> DataFrame:
    ranked, expected = rankings(s, d)
    return E.scores(ranked, expected, 3, F.col("chunk") % 100)


for _id, _metric in (("MTH02_recall", "recall"), ("MTH03_ndcg", "ndcg"), ("MTH04_mrr", "mrr"), ("MTH05_paper_recall", "paper_recall")):
    register(_id, f"WITH {RANKED} SELECT question, config, round({_metric}, 6) AS {_metric} FROM scores", views=False)(lambda s, d, m=_metric: _scores(s, d).select("question", "config", F.round(m, 6).alias(m)))


@register("MTH06_rank_of", f"WITH {RANKED} SELECT question, e.chunk, (SELECT min(rank) FROM ranked r WHERE r.question = e.question AND r.chunk = e.chunk AND config = 'bm25') AS place FROM expected e", views=False)
def rank_of(s: SparkSession, d: str) -> DataFrame:
    ranked, expected = rankings(s, d)
    return E.rank_of(ranked.filter("config = 'bm25'"), expected)


@register("MTH06_grades", f"WITH {RANKED} SELECT question, config, chunk, rank, CASE WHEN chunk IN (SELECT chunk FROM expected e WHERE e.question = r.question) THEN 2 WHEN chunk % 100 IN (SELECT chunk % 100 FROM expected e WHERE e.question = r.question) THEN 1 ELSE 0 END AS grade FROM ranked r", views=False)
def grades(s: SparkSession, d: str) -> DataFrame:
    ranked, expected = rankings(s, d)
    return E.grades(ranked, expected, F.col("chunk") % 100).select("question", "config", "chunk", "rank", "grade")


@register("AGG31_metric_means", f"WITH {RANKED} SELECT config, coalesce(type, 'all') AS type, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr, round(avg(paper_recall), 6) AS paper_recall FROM scores GROUP BY GROUPING SETS ((config), (config, type))", views=False)
def metric_means(s: SparkSession, d: str) -> DataFrame:
    return E.means(_scores(s, d))


@register("AGG33_bootstrap")
def bootstrap(s: SparkSession, d: str) -> DataFrame:
    """95 % intervals of each configuration's recall; drawn by a hash, so tests hold their properties."""
    return E.bootstrap(_scores(s, d), "recall", 200)


@register("RET20_eval_configs", f"WITH {RANKED} SELECT question, config, depth, rank, chunk FROM (SELECT *, unnest([3, 5]) AS depth FROM ranked) WHERE rank <= depth", views=False)
def eval_configs(s: SparkSession, d: str) -> DataFrame:
    ranked, _ = rankings(s, d)
    return E.at_depths(ranked, [3, 5]).select("question", "config", "depth", "rank", "chunk")


@register("VAL03_stale_golden", f"WITH {RANKED} SELECT question, chunk FROM expected ANTI JOIN (SELECT DISTINCT l_partkey AS chunk FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1) USING (chunk)", views=False)
def stale_golden(s: SparkSession, d: str) -> DataFrame:
    _, expected = rankings(s, d)
    index = M.load(s, d, "lineitem").filter("l_returnflag = 'A' and l_linenumber = 1").select(F.col("l_partkey").alias("chunk"))
    return expected.join(index, "chunk", "left_anti").select("question", "chunk")


@register("RET12_latent_embedding")
def latent_embedding(s: SparkSession, d: str) -> DataFrame:
    """Vectors of all documents by factors learnt from them; tests hold singular values against numpy and neighbours against hashed words."""
    docs = M.load(s, d, "documents").select("doc_id", "text")
    model = latent.learn(docs, "doc_id", "text", M.keep(s), rank=32)
    return model.embed(docs, "doc_id", "text").select("doc_id", F.transform("embedding", lambda x: F.round(x, 3)).alias("embedding"))


@register("RET11_learned_rerank")
def learned_rerank(s: SparkSession, d: str) -> DataFrame:
    """What users said asks for the answers within five turns, of which the next is right; every held-out question's gain before and after."""
    c = M.load(s, d, "conversations")
    asked = c.filter("role = 'user'").select("conv_id", F.col("turn").alias("at"), F.concat_ws(" ", "conv_id", "turn", "text").alias("question"))
    said = c.filter("role = 'assistant'").select("conv_id", "turn", "text")
    near = asked.join(said, "conv_id").filter("turn between at - 5 and at + 5")  # ten answers a question at most
    rank = F.row_number().over(Window.partitionBy("conv_id", "at").orderBy("turn"))
    rows = M.keep(s)(near.select("question", "text", rank.alias("rank"), (F.col("turn") == F.col("at") + 1).cast("int").alias("grade")), "candidates")
    out = reranker.measured(reranker.learn(rows, trees=20), rows)
    return out.select("question", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))
