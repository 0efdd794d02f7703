"""Queries of chunking, citation extraction, the answer guard, traces, transcripts and themes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelens.functions import text as T
from lakelens.operators import evals as E
from lakelens.operators import guard as G
from lakelens.operators import ingest as I
from lakelens.operators import manifold, selection
from lakelens.operators import ordered as O
from lakelens.operators import relational as R
from lakelens.operators import themes as H
from lakelens.operators import traces as C
from lakelens.operators.density import clusters
from lakelens.plans import mapping as M
from lakelens.plans.registry import register
from lakelens.plans.retrieval import CHUNKED, chunked
from lakelens.sources import readers, writers

_WS = r"[ \t\n\x0B\f\r]"


# ---------------------------------------------------------------- words, terms, samples of sources


@register("FLT12_source_chunks", rf"WITH {CHUNKED}, named AS (SELECT *, CASE seq % 4 WHEN 0 THEN 'Method' WHEN 1 THEN 'REFERENCES' WHEN 2 THEN 'Acknowledgements' ELSE 'Results' END AS section FROM chunked) SELECT chunk_id, section FROM named WHERE n_tokens >= 100 AND NOT regexp_matches(lower(section), 'reference|bibliograph|acknowledg|__paper__')", views=False)
def source_chunks(s: SparkSession, d: str) -> DataFrame:
    k = F.col("seq") % 4
    section = F.when(k == 0, "Method").when(k == 1, "REFERENCES").when(k == 2, "Acknowledgements").otherwise("Results")
    return chunked(s, d).withColumn("section", section).filter((F.col("n_tokens") >= 100) & ~T.skipped_section(F.col("section"))).select("chunk_id", "section")


@register("FLT13_golden", "SELECT doc_id FROM labels WHERE quality = 1 AND NOT toxic = 1 AND doc_id % 7 <> 3", views=False)
def golden(s: SparkSession, d: str) -> DataFrame:
    checks = F.create_map(*[x for name in readers.CHECKS for x in (F.lit(name), F.lit(True) if name != "natural" else F.col("quality") == 1)], F.lit("type_ok"), F.lit(True), F.lit("closed_book_correct"), (F.col("toxic") == 1) | (F.col("doc_id") % 7 == 3))
    return readers.counted(M.load(s, d, "labels").withColumn("checks", checks)).select("doc_id")


_WORDS = rf"wd AS (SELECT chunk_id, doc_id, lang, source, unnest(list_distinct(list_transform(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{{3,}}'), lambda x: regexp_replace(x, 's$', '')))) AS word FROM chunked)"


def chunk_words(s: SparkSession, d: str) -> DataFrame:
    """chunk_id, doc_id, seq, word and in how many chunks the word stands (df): a table made once of the documents, rare words together."""

    def build() -> DataFrame:
        words = M.keep(s)(chunked(s, d).select("chunk_id", "doc_id", "seq", F.explode(T.words(F.col("text"))).alias("word")), "words")
        df = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
        return words.join(df, "word").sortWithinPartitions("df", "word")

    return M.prepared(s, d, "documents", "chunk-words", build)


@register("AGG22_chunk_frequency", f"WITH {CHUNKED}, {_WORDS} SELECT word, count(*) AS df FROM wd GROUP BY 1", views=False)
def chunk_frequency(s: SparkSession, d: str) -> DataFrame:
    return chunk_words(s, d).groupBy("word").agg(F.count(F.lit(1)).alias("df"))


@register("AGG23_term_papers", f"WITH {CHUNKED}, {_WORDS} SELECT word, count(*) AS df, count(DISTINCT doc_id) AS papers FROM wd GROUP BY 1", views=False)
def term_papers(s: SparkSession, d: str) -> DataFrame:
    per = chunk_words(s, d).groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("word").agg(F.sum("k").alias("df"), F.count(F.lit(1)).alias("papers"))


@register("JOI08_chunk_facets", f"WITH {CHUNKED}, facets AS (SELECT doc_id, 'category' AS key, lang AS value FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents) SELECT chunk_id, value AS stratum FROM chunked JOIN facets USING (doc_id) WHERE key = 'source'", views=False)
def chunk_facets(s: SparkSession, d: str) -> DataFrame:
    docs = M.load(s, d, "documents")
    facets = docs.select("doc_id", F.lit("category").alias("key"), F.col("lang").alias("value")).unionByName(docs.select("doc_id", F.lit("source").alias("key"), F.col("source").alias("value")))
    return chunked(s, d).drop("source").join(facets.filter("key = 'source'").select("doc_id", F.col("value").alias("stratum")), "doc_id").select("chunk_id", "stratum")


def _rare(s: SparkSession, d: str) -> DataFrame:
    return chunk_words(s, d).filter("df <= 3")


_RARE = f"WITH {CHUNKED}, {_WORDS}, df AS (SELECT word, count(*) AS df FROM wd GROUP BY 1 HAVING count(*) <= 3), rare AS (SELECT * FROM wd JOIN df USING (word))"


@register("SRT06_rarest_term", f"{_RARE} SELECT chunk_id, min_by(word, (df, word)) AS term FROM rare GROUP BY 1", views=False)
def rarest_term(s: SparkSession, d: str) -> DataFrame:
    return _rare(s, d).groupBy("chunk_id").agg(F.min(F.struct("df", "word")).alias("m")).select("chunk_id", F.col("m.word").alias("term"))


@register("JOI16_partner_chunks", f"{_RARE}, p AS (SELECT a.chunk_id, b.chunk_id AS partner, count(*) AS shared FROM rare a JOIN rare b ON a.doc_id = b.doc_id AND a.word = b.word AND a.chunk_id <> b.chunk_id GROUP BY 1, 2 HAVING count(*) >= 2) SELECT chunk_id, max(shared) AS shared, min(partner) FILTER (shared = best) AS partner FROM (SELECT *, max(shared) OVER (PARTITION BY chunk_id) AS best FROM p) GROUP BY 1", views=False)
def partner_chunks(s: SparkSession, d: str) -> DataFrame:
    """Pairs meet in a rare word of one document: a word stands in three chunks at most, so pairs stay few."""
    rare = _rare(s, d).select("chunk_id", "doc_id", "word")
    met = rare.join(rare.withColumnRenamed("chunk_id", "partner"), ["doc_id", "word"]).filter("chunk_id <> partner").groupBy("chunk_id", "partner").agg(F.count(F.lit(1)).alias("shared")).filter("shared >= 2")
    best = met.groupBy("chunk_id").agg(F.min(F.struct((-F.col("shared")).alias("k"), "partner")).alias("m"))
    return best.select("chunk_id", (-F.col("m.k")).alias("shared"), F.col("m.partner").alias("partner"))


@register("SET04_shared_terms", f"{_RARE} SELECT chunk_id, list_sort(list(word)) AS words FROM rare JOIN (SELECT DISTINCT unnest(list_transform(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{{3,}}'), lambda x: regexp_replace(x, 's$', ''))) AS word FROM benchmark) USING (word) GROUP BY 1", views=False)
def shared_terms(s: SparkSession, d: str) -> DataFrame:
    asked = M.load(s, d, "benchmark").select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    return _rare(s, d).join(asked, "word", "left_semi").groupBy("chunk_id").agg(F.array_sort(F.collect_set("word")).alias("words"))  # a chunk's own words


_QUOTAS = {"exact_match": 20, "known_hard": 10, "single_hop": 30}


@register("SMP04_golden_sources")
def golden_sources(s: SparkSession, d: str) -> DataFrame:
    """Chunks by type under quotas, one type after another, no chunk twice; drawn by hash, so tests hold the properties."""
    rows = chunked(s, d).withColumn("hard", T.is_known_hard(F.col("text"))).withColumn("anchor", F.size(T.distinctive_terms(F.col("text"))) > 0)
    pools = {"exact_match": "not hard and anchor", "known_hard": "hard", "single_hop": "not hard"}
    out = None
    for kind, test in pools.items():
        pool = rows.filter(test)
        if out is not None:
            pool = pool.join(F.broadcast(out.select("chunk_id")), "chunk_id", "left_anti")  # at most the sum of the quotas
        part = O.round_robin(pool, "source", "doc_id", "chunk_id", _QUOTAS[kind], 1, kind).select("chunk_id", "doc_id", "source", F.lit(kind).alias("type"))
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- chunks and citations

_MARKED = r"regexp_replace(regexp_replace(html, '<h([1-6])[^>]*>', chr(10) || '## ', 'g'), '</h[1-6]>', chr(10), 'g')"
_SECTIONS = rf"""md AS (SELECT page_id, {_MARKED} AS markdown FROM pages WHERE html IS NOT NULL),
ln AS (SELECT page_id, "at", line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY page_id ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT page_id, unnest(string_split(markdown, chr(10))) AS line, unnest(range(len(string_split(markdown, chr(10))))) AS "at" FROM md)),
hd AS (SELECT page_id, start, regexp_extract(line, '^#{{1,6}}[ \t\x0B\f\r]+(.+?)[ \t\x0B\f\r]*$', 1) AS section FROM ln WHERE regexp_matches(line, '^#{{1,6}}[ \t\x0B\f\r]+(.+?)[ \t\x0B\f\r]*$')),
st AS (SELECT * FROM hd UNION ALL SELECT page_id, 0, '__preamble__' FROM md WHERE page_id NOT IN (SELECT page_id FROM hd WHERE start = 0)),
sp AS (SELECT page_id, section, start AS char_start, coalesce(lead(start) OVER (PARTITION BY page_id ORDER BY start), length(markdown)) AS char_end FROM st JOIN md USING (page_id)),
sections AS (SELECT * FROM sp WHERE char_end > char_start)"""


def _markdown(s: SparkSession, d: str) -> DataFrame:
    marked = F.regexp_replace(F.regexp_replace("html", "<h([1-6])[^>]*>", "\n## "), "</h[1-6]>", "\n")
    return M.load(s, d, "pages").filter("html is not null").select("page_id", marked.alias("markdown"))


@register("WIN14_section_spans", f"WITH {_SECTIONS} SELECT page_id, section, char_start, char_end FROM sections", views=False)
def section_spans(s: SparkSession, d: str) -> DataFrame:
    return I.sections(_markdown(s, d), "page_id")


@register("JOI14_page_of_offset", f"WITH {_SECTIONS} SELECT page_id, char_start, CASE WHEN char_start < 2700 THEN char_start // 900 + 1 ELSE 3 END AS page FROM sections", views=False)
def page_of_offset(s: SparkSession, d: str) -> DataFrame:
    pages = F.transform(F.array(*[F.lit(x).cast("long") for x in range(3)]), lambda k: F.struct((k + 1).alias("page"), (k * 900).alias("char_start"), (k * 900 + 900).alias("char_end")))
    return O.within_span(section_spans(s, d), pages, F.col("char_start"), "page").select("page_id", "char_start", "page")


@register("JOI15_aligned_sections", f"WITH {_SECTIONS}, h AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY start) - 1 AS \"at\", section FROM hd) SELECT page_id, CAST(\"at\" AS INTEGER) AS \"at\", section AS heading, CASE WHEN \"at\" % 3 = 0 THEN '__preamble__' ELSE upper(section) END AS section FROM h", views=False)
def aligned_sections(s: SparkSession, d: str) -> DataFrame:
    lines = O.lines_with_offsets(_markdown(s, d), "page_id", "markdown").filter(F.col("line").rlike(I._HEADING))
    heads = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("start", F.regexp_extract("line", I._HEADING, 1).alias("h")))).alias("l")).select("page_id", F.col("l.h").alias("h"))
    stored = F.concat(F.array(F.lit("lead")), F.transform("h", lambda x, i: F.when(i % 3 == 0, "").otherwise(F.upper(x))))
    rows = heads.select("page_id", F.posexplode(I.aligned(F.col("h"), stored)).alias("at", "p"))
    return rows.select("page_id", "at", "p.heading", "p.section")


_CHUNK_SQL = rf"""WITH {_SECTIONS}, tk AS (SELECT page_id, section, char_start, regexp_extract_all(substr(markdown, char_start + 1, char_end - char_start), '{_WS}*[^ \t\n\x0B\f\r]+|{_WS}+$') AS t FROM sections JOIN md USING (page_id)),
wn AS (SELECT page_id, section, char_start AS section_start, CAST(i AS BIGINT) AS i, char_start + length(array_to_string(t[1:i], '')) AS char_start, array_to_string(t[i + 1:i + 60], '') AS text, least(60, len(t) - i) AS n_tokens FROM (SELECT *, unnest(range(0, greatest(len(t) - 9, 1), 51)) AS i FROM tk WHERE len(t) > 0)),
ck AS (SELECT * FROM wn WHERE trim(regexp_replace(text, '{_WS}+', ' ', 'g')) <> ''),
al AS (SELECT page_id, '__paper__' AS section, -1 AS section_start, -1 AS i, trim(coalesce(url, '') || chr(10) || chr(10) || 'page') AS text, 1 AS page_start, 1 AS page_end FROM pages UNION ALL
  SELECT page_id, section, section_start, i, text, char_start // 900 + 1, greatest(char_start, char_start + length(text) - 1) // 900 + 1 FROM ck)
SELECT page_id || '#' || (row_number() OVER (PARTITION BY page_id ORDER BY section_start, i) - 1) AS chunk_id, page_id, section, page_start, page_end, sha256(text) AS digest FROM al"""


@register("CHK01_section_chunks", _CHUNK_SQL, views=False)
def section_chunks(s: SparkSession, d: str) -> DataFrame:
    papers = M.load(s, d, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("title"), F.lit("page").alias("abstract"))
    rows = I.chunk_papers(papers, _markdown(s, d), "page_id", 900, 60)
    return rows.select("chunk_id", "page_id", "section", "page_start", "page_end", F.sha2("text", 256).alias("digest"))


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register("CHK01_token_chunks")
def token_chunks(s: SparkSession, d: str) -> DataFrame:
    """Sections in windows of byte-pair tokens; no SQL encodes, so tests hold offsets against decoded prefixes."""
    papers = M.load(s, d, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("title"), F.lit("page").alias("abstract"))
    rows = I.chunk_papers(papers, _markdown(s, d), "page_id", 900, 60, vocabulary=_vocabulary())
    return rows.select("chunk_id", "page_id", "section", "page_start", "page_end", "n_tokens", F.sha2("text", 256).alias("digest"))


@register("CHK02_byte_pair_counts")
def byte_pair_counts(s: SparkSession, d: str) -> DataFrame:
    return M.load(s, d, "documents").select("doc_id", I.token_counts(_vocabulary())(F.col("text")).alias("n_tokens"))


@register("WIN09_token_windows")
def token_windows(s: SparkSession, d: str) -> DataFrame:
    """Windows of 512 byte-pair tokens of every document, 15 % shared, as places in its text."""
    return I.token_windows(M.load(s, d, "documents"), ["doc_id"], "text", _vocabulary(), 512, 0.15)


@register("CHK02_token_counts", rf"SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS n_tokens FROM documents", views=False)
def token_counts(s: SparkSession, d: str) -> DataFrame:
    return M.load(s, d, "documents").select("doc_id", F.size(I.tokenizer()(F.col("text"))).cast("long").alias("n_tokens"))


@register("WIN09_token_windows", rf"SELECT doc_id, unnest(range(0, greatest(n - 30, 1), 170)) AS start FROM (SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS n FROM documents) WHERE n > 0", views=False)
def token_windows(s: SparkSession, d: str) -> DataFrame:
    n = F.size(I.tokenizer()(F.col("text")))
    return M.load(s, d, "documents").select("doc_id", F.explode(I.window_starts(n, 200, 0.15)).alias("start")).select("doc_id", F.col("start").cast("long").alias("start"))


def _citing(s: SparkSession, d: str) -> DataFrame:
    """Papers whose texts name the papers they cite, some bare, some marked, with numbers around that are no ids."""
    c = M.catalog(s, d).withColumn("pid", M.short_id(F.col("paper_id")))
    cited = M.citations(s, d).join(c.select(F.col("paper_id").alias("cited_id"), F.col("pid").alias("cited")), "cited_id")
    named = F.when(F.col("cited_id") % 2 == 0, F.concat(F.lit("arXiv:"), "cited")).otherwise(F.concat(F.lit("see "), "cited", F.lit(".")))
    texts = cited.groupBy(F.col("citing_id").alias("paper_id")).agg(F.array_join(F.array_sort(F.collect_list(named)), " ").alias("refs"))
    rows = c.join(texts, "paper_id", "left")
    return rows.select("pid", F.concat(F.lit("2013.12345 0.9505.12345 "), "pid", F.lit(" "), F.coalesce("refs", F.lit(""))).alias("text"))


_EDGE_SQL = f", c AS (SELECT * REPLACE ({M.SHORT_ID} AS pid) FROM catalog), newest AS (SELECT max(pid[1:4]) AS m FROM c), e AS (SELECT DISTINCT a.pid AS citing_id, b.pid AS cited_id FROM citations x JOIN c a ON a.paper_id = x.citing_id JOIN c b ON b.paper_id = x.cited_id, newest WHERE a.pid <> b.pid AND b.pid[1:4] BETWEEN '0704' AND m)"


@register("GRF01_citation_edges", f"{_EDGE_SQL} FROM e", "catalog")
def citation_edges(s: SparkSession, d: str) -> DataFrame:
    return I.citation_edges(_citing(s, d))


@register("AGG20_extraction_stats", f"{_EDGE_SQL} SELECT (SELECT count(*) FROM c) AS papers_scanned, count(DISTINCT citing_id) AS papers_with_citations, count(*) AS edges, count(DISTINCT cited_id) AS distinct_cited FROM e", "catalog")
def extraction_stats(s: SparkSession, d: str) -> DataFrame:
    texts = _citing(s, d)
    return I.edge_stats(texts, I.citation_edges(texts))


@register("SET02_match_union", f"{_EDGE_SQL} SELECT pid, coalesce(list_sort(list(cited_id) FILTER (cited_id IS NOT NULL)), []) AS cited FROM c LEFT JOIN e ON citing_id = pid GROUP BY pid", "catalog")
def match_union(s: SparkSession, d: str) -> DataFrame:
    texts = _citing(s, d)
    newest = texts.agg(F.max(F.substring("pid", 1, 4)).alias("newest"))
    return texts.join(F.broadcast(newest)).select("pid", I.cited_ids(F.col("text"), F.col("pid"), F.col("newest")).alias("cited"))


@register("STR11_citation_ids", f"{_EDGE_SQL} SELECT pid, count(cited_id) AS n FROM c LEFT JOIN e ON citing_id = pid GROUP BY pid", "catalog")
def citation_ids(s: SparkSession, d: str) -> DataFrame:
    return match_union(s, d).select("pid", F.size("cited").cast("long").alias("n"))


@register("GRF02_frontier_sample", ", t AS (SELECT l_partkey AS cited_id, count(*) AS edges FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50) SELECT DISTINCT citing_id FROM (SELECT citing_id, row_number() OVER (PARTITION BY cited_id ORDER BY citing_id DESC) AS k FROM citations SEMI JOIN t USING (cited_id)) WHERE k <= 8")
def frontier_sample(s: SparkSession, d: str) -> DataFrame:
    top = M.load(s, d, "lineitem").groupBy(F.col("l_partkey").alias("cited_id")).agg(F.count(F.lit(1)).alias("edges")).orderBy(F.desc("edges"), "cited_id").limit(50)
    return R.newest_of(M.citations(s, d), F.broadcast(top.select("cited_id")), 8).select("citing_id").distinct()


@register("AGG17_snapshot_census", "SELECT month, count(*) AS cs_papers FROM catalog WHERE category[1:1] IN ('1', '2', '3') GROUP BY 1", "catalog")
def snapshot_census(s: SparkSession, d: str) -> DataFrame:
    rows = M.catalog(s, d).filter(F.substring("category", 1, 1).isin("1", "2", "3") & M.short_id(F.col("paper_id")).rlike(r"^[0-9]{4}\.[0-9]{4,5}$"))
    return rows.groupBy("month").agg(F.count(F.lit(1)).alias("cs_papers"))


@register("AGG19_ingest_stats", f"WITH {CHUNKED} SELECT 'documents' AS artifact, count(*) AS n FROM documents UNION ALL SELECT 'chunks', count(*) FROM chunked UNION ALL SELECT 'papers with chunks', count(DISTINCT doc_id) FROM chunked UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL SELECT 'skipped: ' || CASE WHEN n_chars < 200 THEN 'short' ELSE 'blank line' END, count(*) FROM documents WHERE n_chars < 200 OR contains(text, chr(10) || chr(10)) GROUP BY 1", views=False)
def ingest_stats(s: SparkSession, d: str) -> DataFrame:
    docs, chunks = M.load(s, d, "documents"), chunked(s, d)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("artifact"), "n")
    reason = F.when(F.col("n_chars") < 200, "skipped: short").when(F.contains("text", F.lit("\n\n")), "skipped: blank line")
    skipped = docs.select(reason.alias("artifact")).filter("artifact is not null").groupBy("artifact").agg(F.count(F.lit(1)).alias("n"))
    out = one(docs, "documents").union(one(chunks, "chunks")).union(one(chunks.select("doc_id").distinct(), "papers with chunks"))
    return out.union(one(M.load(s, d, "embeddings"), "vectors")).union(skipped)


# ---------------------------------------------------------------- the answer guard: benchmark texts are sources, documents answers

_SHINGLES = r"""wo AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents), wb AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
so AS (SELECT doc_id, i - 1 AS "at", array_to_string(w[i:i + 14], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - 13)) AS i FROM wo)), sb AS (SELECT DISTINCT array_to_string(w[i:i + 14], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - 13)) AS i FROM wb)),
mt AS (SELECT doc_id, "at" FROM so SEMI JOIN sb USING (x))"""


def _matches(s: SparkSession, d: str) -> DataFrame:
    sources = M.load(s, d, "benchmark").select(F.col("item_id").alias("source_id"), "text")
    return G.matches(M.load(s, d, "documents").select("doc_id", "text"), "doc_id", sources, 15)


@register("ARR01_shingles", r"""WITH wb AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark) SELECT item_id, i - 1 AS "at", md5(array_to_string(w[i:i + 14], ' ')) AS digest FROM (SELECT *, unnest(range(1, len(w) - 13)) AS i FROM wb)""", views=False)
def shingles(s: SparkSession, d: str) -> DataFrame:
    words = R.once(M.load(s, d, "benchmark"), "w", G.answer_words(F.col("text")))
    return words.select("item_id", F.posexplode(G.shingles(F.col("w"), 15)).alias("at", "x")).select("item_id", F.col("at").cast("long").alias("at"), F.md5("x").alias("digest"))


@register("JOI17_shingle_probe", f"WITH {_SHINGLES} SELECT doc_id, \"at\" FROM mt", views=False)
def shingle_probe(s: SparkSession, d: str) -> DataFrame:
    return _matches(s, d).select("doc_id", F.col("at").cast("long").alias("at"))


_ISLANDS = "isl AS (SELECT doc_id, min(\"at\") AS first, max(\"at\") AS last FROM (SELECT doc_id, \"at\", \"at\" - row_number() OVER (PARTITION BY doc_id ORDER BY \"at\") AS g FROM mt) GROUP BY doc_id, g)"


@register("WIN17_islands", f"WITH {_SHINGLES}, {_ISLANDS} SELECT doc_id, first, last FROM isl", views=False)
def islands(s: SparkSession, d: str) -> DataFrame:
    return O.islands(shingle_probe(s, d), ["doc_id"], "at")


@register("WIN17_verbatim_runs", f"WITH RECURSIVE {_SHINGLES}, {_ISLANDS}, r(doc_id, first, stop) AS (SELECT doc_id, min(first), min_by(last, first) + 15 FROM isl GROUP BY 1 UNION ALL SELECT doc_id, a, z + 15 FROM (SELECT r.doc_id, min(\"at\") AS a, min_by(last, \"at\") AS z FROM r JOIN mt ON mt.doc_id = r.doc_id AND \"at\" >= stop JOIN isl ON isl.doc_id = r.doc_id AND \"at\" BETWEEN isl.first AND last GROUP BY r.doc_id)) SELECT doc_id, first, stop FROM r", views=False)
def verbatim_runs(s: SparkSession, d: str) -> DataFrame:
    runs = G.verbatim_runs(_matches(s, d), "doc_id", 15)
    return runs.select("doc_id", F.col("first").cast("long").alias("first"), F.col("stop").cast("long").alias("stop"))


@register("GRD01_hardened_answers")
def hardened_answers(s: SparkSession, d: str) -> DataFrame:
    """Documents as answers, each against the benchmark texts it shares a run with; held against cases in the tests."""
    b = M.load(s, d, "benchmark").select(F.col("item_id").cast("string").alias("source_id"), "text")
    docs = M.load(s, d, "documents").select("doc_id", "text")
    owners = G.shingle_places(b, "source_id", "text", 15).select("hash", "source_id").distinct()
    met = G.shingle_places(docs, "doc_id", "text", 15).select("doc_id", "hash").join(owners, "hash").select("doc_id", "source_id").distinct()
    sources = met.join(b, "source_id").groupBy("doc_id").agg(F.collect_list("source_id").alias("papers"), F.collect_list("text").alias("texts"))  # sources of one answer
    rows = docs.join(sources, "doc_id").select("doc_id", G.hardened("text", "papers", "texts", F.array().cast("array<string>")).alias("h"))
    return rows.select("doc_id", F.sha2("h.text", 256).alias("digest"), F.size("h.stripped").alias("stripped"), "h.capped", "h.dropped")


_CALLS = f"""{CHUNKED}, runs AS (SELECT event_id AS run_id, event_id % 5 <> 0 AS ok, CASE WHEN event_id % 3 = 0 THEN 'read_paper' ELSE 'search_corpus' END AS name, CASE WHEN event_id % 3 = 0 THEN user_id END AS paper_id, CASE WHEN event_id % 3 <> 0 THEN (user_id + 3) || '#0' END AS chunk_id FROM events),
calls AS (SELECT run_id // 4 AS run_id, ok, name, paper_id, chunk_id FROM runs)"""


def _calls(s: SparkSession, d: str) -> DataFrame:
    e = M.load(s, d, "events")
    read = F.col("event_id") % 3 == 0
    return e.select(F.expr("event_id div 4").alias("run_id"), (F.col("event_id") % 5 != 0).alias("ok"), F.when(read, "read_paper").otherwise("search_corpus").alias("name"), F.when(read, F.col("user_id")).alias("paper_id"), F.when(~read, F.concat((F.col("user_id") + 3).cast("string"), F.lit("#0"))).alias("chunk_id"))


def _paper_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunked(s, d).select("chunk_id", F.col("doc_id").alias("paper_id"), "text", F.col("seq").alias("page_start"))


@register("GRD02_guard_sources", f"WITH {_CALLS}, rd AS (SELECT DISTINCT run_id, paper_id FROM calls WHERE ok AND name = 'read_paper') SELECT run_id, doc_id AS paper_id, md5(text) AS digest FROM rd JOIN chunked ON doc_id = paper_id UNION ALL SELECT c.run_id, doc_id, md5(text) FROM (SELECT DISTINCT run_id, chunk_id FROM calls WHERE ok AND chunk_id IS NOT NULL) c JOIN chunked USING (chunk_id) WHERE NOT EXISTS (FROM rd WHERE rd.run_id = c.run_id AND rd.paper_id = doc_id)", views=False)
def guard_sources(s: SparkSession, d: str) -> DataFrame:
    return G.guard_sources(_calls(s, d), _paper_chunks(s, d)).select("run_id", "paper_id", F.md5("text").alias("digest"))


@register("AGG37_retrieved_papers", f"WITH {_CALLS} SELECT DISTINCT run_id, doc_id AS paper_id FROM (SELECT run_id, chunk_id FROM calls WHERE ok AND chunk_id IS NOT NULL) JOIN chunked USING (chunk_id) UNION SELECT run_id, paper_id FROM calls WHERE ok AND name = 'read_paper'", views=False)
def retrieved_papers(s: SparkSession, d: str) -> DataFrame:
    return G.retrieved_papers(_calls(s, d), _paper_chunks(s, d))


@register("GRD03_excerpts", rf"WITH {CHUNKED}, a AS (SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS place FROM chunked) SELECT chunk_id, array_to_string(string_split(text, ' ')[1:50], ' ') AS excerpt, len(string_split(text, ' ')) > 50 AS truncated FROM chunked JOIN a USING (chunk_id, doc_id) WHERE place <= 3", views=False)
def excerpts(s: SparkSession, d: str) -> DataFrame:
    c = chunked(s, d)
    asked = c.select(F.col("doc_id").alias("paper_id"), "chunk_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("seq"))).alias("place"))
    return G.excerpts(asked, _paper_chunks(s, d)).select("chunk_id", "excerpt", "truncated")


@register("GRD04_paper_detail", f"WITH {CHUNKED} SELECT doc_id, source, lang, n_chars, count(*) AS n_chunks FROM documents JOIN (SELECT doc_id FROM chunked) USING (doc_id) GROUP BY ALL", views=False)
def paper_detail(s: SparkSession, d: str) -> DataFrame:
    n = chunked(s, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return M.load(s, d, "documents").select("doc_id", "source", "lang", "n_chars").join(n, "doc_id")


@register("GRD05_read_pages", "SELECT paper_id, seq, spans_available, max(running) OVER (PARTITION BY paper_id) AS tokens_used, count(*) OVER (PARTITION BY paper_id) < spans_available AS truncated FROM (SELECT paper_id, seq, CAST(sum(n_tokens) OVER w AS BIGINT) AS running, row_number() OVER w AS k, count(*) OVER (PARTITION BY paper_id) AS spans_available FROM (SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY seq, n_tokens) AS seq, n_tokens, page_end FROM chunks) WHERE page_end >= 2 AND page_end <= 6 WINDOW w AS (PARTITION BY paper_id ORDER BY page_end, seq, n_tokens ROWS UNBOUNDED PRECEDING)) WHERE k = 1 OR running <= 60")
def read_pages(s: SparkSession, d: str) -> DataFrame:
    c = M.chunks(s, d).withColumn("page_start", F.col("page_end")).withColumn("seq", F.row_number().over(Window.partitionBy("paper_id").orderBy("seq", "n_tokens")))
    return G.read_pages(c, 2, 6, 60).select("paper_id", F.col("seq").cast("long").alias("seq"), "spans_available", "tokens_used", "truncated")


# ---------------------------------------------------------------- traces

for _name, _by in (("session", ["session_id"]), ("network_day", ["network", "day"])):
    register(f"AGG21_spend_by_{_name}", f"SELECT {', '.join(_by)}, coalesce(sum(CAST(round(cost * 1000000000) AS BIGINT)), 0)::DOUBLE / 1000000000 AS usd, CAST(coalesce(sum(CAST(round(cost * 100) AS BIGINT)), 0) AS BIGINT) AS cents, count(*) AS runs FROM (SELECT *, session_id % 7 AS network FROM runs) GROUP BY {', '.join(_by)}")(lambda s, d, by=_by: C.spend(M.runs(s, d).withColumn("network", F.col("session_id") % 7), *by))


@register("AGG32_latency_cost", "SELECT tool, median(cost) AS p50, list_sort(list(cost))[greatest(1, CAST(floor(0.95 * count(*)) AS BIGINT))] AS p95, max(cost) AS worst, round(avg(cost), 6) AS mean FROM runs GROUP BY tool")
def latency_cost(s: SparkSession, d: str) -> DataFrame:
    return selection.latency(M.runs(s, d), "tool", "cost", M.keep(s))


@register("BUD01_budget_gate", """SELECT run_id, messages, CASE WHEN messages >= 15 THEN 'deny: session' WHEN ip_cents / 100 >= 0.1 THEN 'deny: network' WHEN day_cents / 100 >= 0.5 THEN 'replay' ELSE 'allow' END AS verdict FROM (SELECT run_id, count(*) OVER (PARTITION BY session_id ORDER BY ts, run_id ROWS UNBOUNDED PRECEDING) AS messages,
sum(cents) OVER (PARTITION BY session_id % 400, day ORDER BY ts, run_id ROWS UNBOUNDED PRECEDING) AS ip_cents, sum(cents) OVER (PARTITION BY day ORDER BY ts, run_id ROWS UNBOUNDED PRECEDING) AS day_cents FROM (SELECT *, CAST(round(coalesce(cost, 0.0) * 100 * 0.005) AS BIGINT) AS cents FROM runs))""")
def budget_gate(s: SparkSession, d: str) -> DataFrame:
    return C.budget_gate(M.runs(s, d).withColumn("network", F.col("session_id") % 400), 0.005)


@register("AGG38_turn_cost", """SELECT turn_id, CAST(sum(fresh + cached) AS BIGINT) AS tokens_in, CAST(sum(o) AS BIGINT) AS tokens_out, bool_and(reported IS NOT NULL AND reported >= 0) AS every_call_priced,
round(CASE WHEN bool_and(reported IS NOT NULL AND reported >= 0) THEN sum(reported) ELSE (sum(fresh) * 0.1 + sum(o) * 0.5 + sum(cached) * 0.01) / 1000000 END + sum(tools), 9) AS usd FROM (SELECT event_id // 3 AS turn_id, user_id * 10 AS fresh, event_id % 50 AS o, user_id % 9 AS cached, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN -1.0 ELSE value / 1000 END AS reported, CASE WHEN event_type = 'error' THEN 0.001 ELSE 0.0 END AS tools FROM events) GROUP BY 1""", views=False)
def turn_cost(s: SparkSession, d: str) -> DataFrame:
    e = M.load(s, d, "events")
    reported = F.when(F.col("event_id") % 11 == 0, F.lit(None).cast("double")).when(F.col("event_id") % 13 == 0, F.lit(-1.0)).otherwise(F.col("value") / 1000)
    return C.turn_costs(e.select(F.expr("event_id div 3").alias("turn_id"), (F.col("user_id") * 10).alias("fresh_in"), (F.col("event_id") % 50).alias("out"), (F.col("user_id") % 9).alias("cache_read"), reported.alias("reported"), F.when(F.col("event_type") == "error", 0.001).otherwise(0.0).alias("tool_usd")))


_JSON = """'[{"name":"' || event_type || '","ok":true,"args":' || props || CASE WHEN event_id % 2 = 0 THEN ',"citations":[{"chunk_id":"' || (user_id % 3) || '#1","paper_id":"' || (user_id % 3) || '"},{"chunk_id":"' || (user_id % 3 + event_id % 2) || '#0","paper_id":"' || (user_id % 3) || '"},{"chunk_id":"9#9","paper_id":"9"}]' ELSE '' END || '}]'"""


def _json_runs(s: SparkSession, d: str) -> DataFrame:
    return M.load(s, d, "events").select(F.col("event_id").alias("run_id"), C.tool_calls(F.expr(_JSON)).alias("calls"))


@register("ARR02_tool_calls", "SELECT event_id AS run_id, event_type AS name, CAST(CASE WHEN event_id % 2 = 0 THEN 3 ELSE 0 END AS INTEGER) AS n_citations, json_extract_string(props, '$.k') AS k FROM events", views=False)
def parsed_calls(s: SparkSession, d: str) -> DataFrame:
    return _json_runs(s, d).select("run_id", F.explode("calls").alias("c")).select("run_id", "c.name", F.size("c.citations").alias("n_citations"), F.try_element_at("c.args", F.lit("k")).alias("k"))


@register("AGG36_citations_by_paper", "SELECT event_id AS run_id, CAST(user_id % 3 AS VARCHAR) AS paper_id, 1 AS place, [(user_id % 3) || '#1', (user_id % 3) || '#0'] AS chunk_ids FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, '9', 2, ['9#9'] FROM events WHERE event_id % 2 = 0", views=False)
def citations_by_paper(s: SparkSession, d: str) -> DataFrame:
    return C.citations_by_paper(_json_runs(s, d).select("run_id", F.flatten("calls.citations").alias("citations")))


@register("RPL01_replay", "SELECT event_id AS run_id, unnest(range(5)) AS seq, unnest(['call ' || event_type, 'result ' || event_type, 'text ' || props, 'cost ' || (event_id % 7), 'done']) AS event FROM events", views=False)
def replayed(s: SparkSession, d: str) -> DataFrame:
    e = M.load(s, d, "events").select(F.col("event_id").alias("run_id"), F.array("event_type").alias("calls"), F.col("props").alias("answer"), (F.col("event_id") % 7).alias("usd"))
    return C.replay(e).select("run_id", F.col("seq").cast("long").alias("seq"), "event")


@register("SES01_live_sessions", "SELECT session_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS \"end\", count(*) AS runs FROM (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT session_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM runs)) GROUP BY session_id, k")
def live_sessions(s: SparkSession, d: str) -> DataFrame:
    return C.live_sessions(M.runs(s, d))


@register("AGG34_redactions", rf"""SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest(['email', 'key', 'ip']) AS kind, unnest([len(regexp_extract_all(text, '{C.REDACTIONS["email"]}')), len(regexp_extract_all(text, '{C.REDACTIONS["key"]}')), len(regexp_extract_all(text, '{C.REDACTIONS["ip"]}'))]) AS n FROM documents) GROUP BY kind""", views=False)
def redaction_counts(s: SparkSession, d: str) -> DataFrame:
    return C.redactions(M.load(s, d, "documents"), "text")


@register("AGG35_transcript_stats", "WITH t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM conversations) SELECT count(DISTINCT conv_id) AS sessions, count(DISTINCT (conv_id, turn_no)) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM t WHERE turn_no > 0", views=False)
def transcript_stats(s: SparkSession, d: str) -> DataFrame:
    t = O.turns(M.load(s, d, "conversations"), "conv_id", [F.asc("turn")], F.col("role") == "user").filter("turn_no > 0")
    per = t.groupBy("conv_id", "turn_no").agg(F.sum(F.length("text")).alias("c")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum("c").alias("c"))
    return per.agg(F.count(F.lit(1)).alias("sessions"), F.sum("turns").alias("turns"), F.sum("c").alias("chars"))


@register("TRN01_transcript_chunks", """WITH RECURSIVE t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM conversations),
u AS (SELECT conv_id, CAST(turn_no AS BIGINT) AS turn_no, CAST(sum(length(text)) AS BIGINT) AS size, min_by(text, turn)[1:80] AS prompt FROM t WHERE turn_no > 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_no) AS i FROM u),
p(conv_id, i, turn_no, prompt, grp, used) AS (SELECT conv_id, i, turn_no, prompt, 0, size FROM r WHERE i = 1 UNION ALL SELECT r.conv_id, r.i, r.turn_no, r.prompt, CASE WHEN used + size > 1500 THEN grp + 1 ELSE grp END, CASE WHEN used + size > 1500 THEN size ELSE used + size END FROM p JOIN r ON r.conv_id = p.conv_id AND r.i = p.i + 1)
SELECT conv_id || '#' || grp AS chunk_id, min_by(prompt, turn_no) AS section, min(turn_no) AS pos_start, max(turn_no) AS pos_end FROM p GROUP BY conv_id, grp""", views=False)
def transcript_chunks(s: SparkSession, d: str) -> DataFrame:
    t = O.turns(M.load(s, d, "conversations"), "conv_id", [F.asc("turn")], F.col("role") == "user").filter("turn_no > 0")
    u = t.groupBy("conv_id", F.col("turn_no").cast("long").alias("turn_no")).agg(F.sum(F.length("text")).alias("size"), F.substring(F.min_by("text", "turn"), 1, 80).alias("prompt"))
    g = O.greedy_groups(u, "conv_id", "turn_no", "size", 1500).join(u.select("conv_id", "turn_no", "prompt"), ["conv_id", "turn_no"])
    name = F.concat(F.col("conv_id").cast("string"), F.lit("#"), F.col("group").cast("string"))
    return g.groupBy(name.alias("chunk_id")).agg(F.min_by("prompt", "turn_no").alias("section"), F.min("turn_no").alias("pos_start"), F.max("turn_no").alias("pos_end"))


# ---------------------------------------------------------------- themes

_STOP = "[" + ", ".join(f"'{w}'" for w in H.STOP_WORDS) + "]"


@register("AGG29_class_words", rf"""WITH w AS (SELECT doc_id, lang, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({_STOP}, x)) AS w FROM documents),
t AS (SELECT doc_id, lang, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS t FROM w),
df AS (SELECT term FROM (SELECT unnest(list_distinct(t)) AS term FROM t) GROUP BY 1 HAVING count(*) >= greatest(1, least(20, (SELECT count(*) FROM documents) // 50))),
a AS (SELECT lang AS label, term, count(*) AS c FROM (SELECT lang, unnest(t) AS term FROM t) SEMI JOIN df USING (term) GROUP BY 1, 2),
u AS (SELECT term FROM a GROUP BY 1 ORDER BY sum(c) DESC, term LIMIT 40000), b AS (SELECT * FROM a SEMI JOIN u USING (term)), l AS (SELECT label, sum(c) AS n FROM b GROUP BY 1), g AS (SELECT term, sum(c) AS n FROM b GROUP BY 1)
SELECT label, term, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, term) AS place FROM (SELECT b.label, b.term, round(c / l.n * ln(1 + (SELECT avg(n) FROM l) / (g.n + 1)), 9) AS score FROM b JOIN l USING (label) JOIN g USING (term))) WHERE place <= 8""", views=False)
def class_words(s: SparkSession, d: str) -> DataFrame:
    return H.class_words(M.load(s, d, "documents"), "lang", "text", keep=M.keep(s))


@register("AGG30_medians", "SELECT label, round(median(embedding[1]::DOUBLE), 6) AS x, round(median(embedding[2]::DOUBLE), 6) AS y, min_by(kind, (-n, kind)) AS top, CAST(sum(n1) AS BIGINT) AS n FROM (SELECT label, vec_id % 3 AS kind, embedding, count(*) OVER (PARTITION BY label, vec_id % 3) AS n, 1 AS n1 FROM embeddings) GROUP BY label", views=False)
def medians(s: SparkSession, d: str) -> DataFrame:
    e = M.load(s, d, "embeddings").select("label", (F.col("vec_id") % 3).alias("kind"), F.col("embedding")[0].alias("a"), F.col("embedding")[1].alias("b"))
    top = e.groupBy("label", "kind").agg(F.count(F.lit(1)).alias("k")).groupBy("label").agg(F.min(F.struct((-F.col("k")).alias("m"), "kind")).alias("t"), F.sum("k").alias("n"))
    x, y = (selection.median(e, "label", c, M.keep(s)).select("label", F.round("median", 6).alias(n)) for c, n in (("a", "x"), ("b", "y")))
    xy = x.join(y, "label")
    return xy.join(top, "label").select("label", "x", "y", F.col("t.kind").alias("top"), "n")


@register("MTH07_quantize", "SELECT vec_id, CAST(round_even((embedding[1]::DOUBLE - lo) / (hi - lo) * 65535, 0) AS INTEGER) AS x FROM embeddings, (SELECT min(embedding[1])::DOUBLE AS lo, max(embedding[1])::DOUBLE AS hi FROM embeddings)", views=False)
def quantize(s: SparkSession, d: str) -> DataFrame:
    return H.quantized(M.load(s, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x")), ["x"])


@register("MTH08_unit_vectors", "SELECT vec_id, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS x FROM (SELECT vec_id, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE * (vec_id + 1) AS x FROM embeddings)", views=False)
def unit_vectors(s: SparkSession, d: str) -> DataFrame:
    from lakelens.operators.hybrid import unit

    grown = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 1))
    rows = M.load(s, d, "embeddings").select("vec_id", unit(grown).alias("v")).select("vec_id", F.posexplode("v").alias("dim", "x"))
    return rows.select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@register("CLU01_layout")
def layout(s: SparkSession, d: str) -> DataFrame:
    """Principal coordinates in place of a neighbour embedding; tests hold variance and axes."""
    return H.layout(M.load(s, d, "embeddings"), "vec_id").select("vec_id", F.round(F.col("z")[0], 6).alias("x"), F.round(F.col("z")[1], 6).alias("y"))


@register("CLU01_neighbour_layout")
def neighbour_layout(s: SparkSession, d: str) -> DataFrame:
    """A map on which nearest neighbours stay together; tests hold its trustworthiness against the principal axes."""
    vectors = M.load(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    at = manifold.layout(M.neighbours(s, d), vectors, H.layout(vectors, "id"), M.keep(s))
    return at.select(F.col("id").alias("vec_id"), F.round(F.col("z")[0], 6).alias("x"), F.round(F.col("z")[1], 6).alias("y"))


@register("CLU02_regions")
def regions(s: SparkSession, d: str) -> DataFrame:
    """Regions of density on ten principal axes; tests hold labels against a plain hierarchy over all pairs."""
    vectors = M.load(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return clusters(H.layout(vectors, "id", 10).select("id", F.col("z").alias("x")), 15, 5, M.keep(s)).select(F.col("id").alias("vec_id"), "label")


# ---------------------------------------------------------------- sources, sinks and checks that are table operations

@register("SRC05_snapshot_window", "SELECT pid, published FROM catalog WHERE published = '' OR published BETWEEN '1995-01-01' AND '1995-12-31'", "catalog")
def snapshot_window(s: SparkSession, d: str) -> DataFrame:
    c = M.catalog(s, d)
    created = F.when(F.col("published") != "", F.concat(F.date_format(F.to_date(F.when(F.col("published") != "", F.col("published"))), "E, d MMM yyyy"), F.lit(" 10:00:00 GMT"))).otherwise("")
    records = c.select("pid", "title", F.lit(" a  b ").alias("abstract"), F.lit(None).cast("string").alias("update_date"), F.array(F.struct(F.lit("v1").alias("version"), created.alias("created"))).alias("versions"))
    return readers.snapshot_papers(records, "1995-01-01", "1995-12-31").select("pid", "published")


@register("SRC04_wanted_records", "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey % 9 = 0", views=False)
def wanted_records(s: SparkSession, d: str) -> DataFrame:
    snapshot = M.load(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber")
    return readers.read_records(snapshot, M.load(s, d, "orders").filter("o_orderkey % 9 = 0").select(F.col("o_orderkey").alias("id"))).select("id")


@register("SRC12_core_tiers", "SELECT lower(p_name) AS acronym, max(CASE WHEN upper(r) IN ('A*', 'A') THEN 3 ELSE 2 END) AS tier FROM (SELECT p_name, ['A*', 'A', 'B', 'C', 'Unranked', 'a'][p_partkey % 6 + 1] AS r FROM part) WHERE upper(r) IN ('A*', 'A', 'B', 'C') GROUP BY 1", views=False)
def core_tiers(s: SparkSession, d: str) -> DataFrame:
    rank = F.element_at(F.array(*[F.lit(x) for x in ("A*", "A", "B", "C", "Unranked", "a")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return readers.core_tiers(M.load(s, d, "part").select(F.concat(F.lit(" "), F.upper("p_name")).alias("acronym"), rank.alias("rank")))


@register("SRC13_indegrees", "SELECT CAST(l_partkey AS VARCHAR) AS pid, count(*) AS n FROM lineitem GROUP BY 1", views=False)
def indegrees(s: SparkSession, d: str) -> DataFrame:
    value = F.concat(F.lit('{"'), F.col("l_orderkey").cast("string"), F.lit('": ["'), F.col("l_partkey").cast("string"), F.lit('"]}'))
    return readers.indegrees(M.load(s, d, "lineitem").select(value.alias("value")))


@register("SRC14_mirror_months", "SELECT strftime(o_orderdate, '%y%m') AS month, count(DISTINCT l_orderkey) AS ids, max(l_linenumber) AS newest FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1", views=False)
def mirror_months(s: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.col("pid"), F.lit("v"), F.col("l_linenumber").cast("string"), F.lit(".pdf"))
    files = M.load(s, d, "lineitem").join(M.catalog(s, d).select(F.col("paper_id").alias("l_orderkey"), "pid"), "l_orderkey").select(name.alias("name"))
    pattern = r"(\d{4}\.\d{4,})v(\d+)\.pdf$"
    rows = files.select(F.regexp_extract("name", pattern, 1).alias("pid"), F.regexp_extract("name", pattern, 2).cast("int").alias("v"))
    per = rows.groupBy("pid").agg(F.max("v").alias("v"))
    return per.groupBy(F.substring("pid", 1, 4).alias("month")).agg(F.count(F.lit(1)).alias("ids"), F.max("v").alias("newest"))


@register("SNK07_upsert", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'new' END ELSE 'old' END AS facet FROM orders", views=False)
def upserted(s: SparkSession, d: str) -> DataFrame:
    o = M.load(s, d, "orders")
    old = o.select(F.col("o_orderkey").alias("key"), F.lit("old").alias("facet"), F.lit(1).alias("at"))
    new = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 2 == 0, "new").alias("facet"), F.lit(2).alias("at"))
    return writers.upsert(old, new, "key", "at").select("key", "facet")


@register("SRC17_latest_runs", "SELECT user_id AS id, max(event_id) AS run_id FROM events GROUP BY 1", views=False)
def latest_runs(s: SparkSession, d: str) -> DataFrame:
    e = M.load(s, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("run_id"))
    return e.groupBy("id").agg(F.max("run_id").alias("run_id"))


@register("SET05_concatenate", "SELECT vec_id, min(part) AS part, count(*) AS n FROM (SELECT vec_id, 0 AS part FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id, 1 FROM embeddings WHERE vec_id % 3 = 0) GROUP BY 1", views=False)
def concatenated(s: SparkSession, d: str) -> DataFrame:
    e = M.load(s, d, "embeddings").select("vec_id")
    both = e.filter("vec_id % 2 = 0").withColumn("part", F.lit(0)).unionByName(e.filter("vec_id % 3 = 0").withColumn("part", F.lit(1)))
    return both.groupBy("vec_id").agg(F.min("part").alias("part"), F.count(F.lit(1)).alias("n"))


@register("VAL01_index_violations", f"WITH {CHUNKED} SELECT 'orphan chunk' AS kind, count(*) AS n FROM chunked WHERE doc_id % 50 = 0 UNION ALL SELECT 'chunk without vector', count(*) FROM chunked WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'malformed chunk id', count(*) FROM chunked WHERE seq = 3", views=False)
def violations(s: SparkSession, d: str) -> DataFrame:
    c = chunked(s, d).withColumn("chunk_id", F.when(F.col("seq") == 3, F.concat("chunk_id", F.lit("x"))).otherwise(F.col("chunk_id")))
    docs = M.load(s, d, "documents").filter("doc_id % 50 <> 0")
    vectors = c.join(M.load(s, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select("chunk_id")
    found = writers.index_violations(docs, c, vectors)
    parts = [found[k].agg(F.count(F.lit(1)).alias("n")).select(F.lit(k.replace("_", " ")).alias("kind"), "n") for k in ("orphan_chunk", "chunk_without_vector", "malformed_chunk_id")]
    return parts[0].union(parts[1]).union(parts[2])


@register("VAL02_corpus_violations", ", p AS (SELECT * FROM papers WHERE paper_id % 10 <> 0) SELECT 'unknown citing paper' AS kind, count(*) AS n FROM citations ANTI JOIN p ON p.paper_id = citing_id UNION ALL SELECT 'unknown cited work', count(*) FROM citations WHERE cited_id NOT IN (SELECT work_id FROM works WHERE year > 2) UNION ALL SELECT 'chunk of unknown paper', count(*) FROM chunks ANTI JOIN p USING (paper_id)")
def corpus_violations(s: SparkSession, d: str) -> DataFrame:
    papers = M.papers(s, d).filter("paper_id % 10 <> 0")
    found = writers.corpus_violations(papers, M.citations(s, d), M.works(s, d).filter("year > 2"), M.chunks(s, d), [])
    parts = [found[k].agg(F.count(F.lit(1)).alias("n")).select(F.lit(k.replace("_", " ")).alias("kind"), "n") for k in ("unknown_citing_paper", "unknown_cited_work", "chunk_of_unknown_paper")]
    return parts[0].union(parts[1]).union(parts[2])
