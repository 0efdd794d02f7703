"""Queries of the scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.functions import scalars as X
from lakelens.functions import text as T
from lakelens.plans import mapping as M
from lakelens.plans.registry import register

_WS = r"[ \t\n\x0B\f\r]+"
_CODES = [*list(T.CATEGORY_NAMES), "math.NA", "cs.ZZ"]


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _docs(s: SparkSession, d: str) -> DataFrame:
    return M.load(s, d, "documents")


@register("STR01_id_month", "SELECT pid[1:4] AS month, count(*) AS n FROM catalog GROUP BY 1", "catalog")
def id_month(s: SparkSession, d: str) -> DataFrame:
    return M.catalog(s, d).groupBy(F.substring("pid", 1, 4).alias("month")).agg(F.count(F.lit(1)).alias("n"))


@register("STR03_trim_authors", "SELECT pid, CASE WHEN authors = '' THEN authors ELSE array_to_string(names[1:3], ', ') || CASE WHEN len(names) > 3 THEN ' +' || (len(names) - 3) ELSE '' END END AS authors FROM (SELECT *, list_filter(list_transform(string_split_regex(authors, ',| and '), lambda x: trim(x)), lambda x: x <> '') AS names FROM catalog)", "catalog")
def trimmed_authors(s: SparkSession, d: str) -> DataFrame:
    return M.catalog(s, d).select("pid", T.trim_authors(F.col("authors"), 3).alias("authors"))


@register("STR04_category_name", f"SELECT p_partkey, code, map_extract(MAP {{{', '.join(chr(39) + k + chr(39) + ': ' + chr(39) + v + chr(39) for k, v in T.CATEGORY_NAMES.items())}}}, code)[1] AS name FROM (SELECT p_partkey, {_sql_list(_CODES)}[p_partkey % {len(_CODES)} + 1] AS code FROM part)", views=False)
def category_names(s: SparkSession, d: str) -> DataFrame:
    code = F.element_at(F.array(*[F.lit(c) for c in _CODES]), (F.col("p_partkey") % len(_CODES) + 1).cast("int"))
    return M.load(s, d, "part").select("p_partkey", code.alias("code"), T.category_name(code).alias("name"))


@register("STR05_primary_category", "SELECT pid, string_split_regex(trim(coalesce(category, '') || '  ' || coalesce(venue, '')), ' +')[1] AS primary_category FROM catalog", "catalog")
def primary(s: SparkSession, d: str) -> DataFrame:
    return M.catalog(s, d).select("pid", T.primary_category(F.concat(F.coalesce("category", F.lit("")), F.lit("  "), F.coalesce("venue", F.lit("")))).alias("primary_category"))


_YEAR = "CASE WHEN published <> '' THEN CAST(published[1:4] AS INTEGER) WHEN CAST(pid[1:2] AS INTEGER) >= 90 THEN 1900 + CAST(pid[1:2] AS INTEGER) ELSE 2000 + CAST(pid[1:2] AS INTEGER) END"


@register("STR06_paper_year", f"SELECT pid, {_YEAR} AS year FROM catalog", "catalog")
def paper_year(s: SparkSession, d: str) -> DataFrame:
    return M.catalog(s, d).select("pid", X.paper_year(F.col("published"), F.col("pid")).alias("year"))


@register("STR07_paper_day", f"SELECT pid, CASE WHEN length(published) >= 10 THEN CAST(replace(published, '-', '') AS INTEGER) ELSE ({_YEAR}) * 10000 + 101 END AS day FROM catalog", "catalog")
def paper_day(s: SparkSession, d: str) -> DataFrame:
    return M.catalog(s, d).select("pid", X.paper_day(F.col("published"), F.col("pid")).alias("day"))


@register("STR08_latex_to_text")
def latex(s: SparkSession, d: str) -> DataFrame:
    """Names with accents and formats put in; checked in the tests, since no SQL composes characters."""
    raw = F.concat(F.lit(r"\textsc{"), "title", F.lit(r"} by {\'E}douard \v{S}krtel, Universit\'e $\alpha_1$ \& Stra\ss e "), "authors")
    return M.catalog(s, d).select("pid", T.latex_to_text(raw).alias("text"))


_HEADED = r"regexp_replace(regexp_replace(html, '<h([1-6])[^>]*>', chr(10) || '## **', 'g'), '</h[1-6]>', '** ' || chr(10), 'g')"


def _markdown(s: SparkSession, d: str) -> DataFrame:
    marked = F.regexp_replace(F.regexp_replace("html", "<h([1-6])[^>]*>", "\n## **"), "</h[1-6]>", "** \n")
    return M.load(s, d, "pages").select("page_id", marked.alias("markdown"))


@register("STR10_headings", rf"SELECT page_id, unnest(regexp_extract_all(m, '(?m)^#{{1,6}}[ \t\n\x0B\f\r]+(.+?)[ \t\n\x0B\f\r]*$', 1)) AS title FROM (SELECT page_id, {_HEADED} AS m FROM pages)", views=False)
def headings(s: SparkSession, d: str) -> DataFrame:
    return _markdown(s, d).select("page_id", F.explode(T.headings(F.col("markdown"))).alias("title"))


@register("STR09_clean_heading", rf"SELECT page_id, trim(trim(trim(regexp_replace(replace(t, '**', ''), '</?(u|i|b|sup|sub)>', '', 'g'), E' \t\n\x0B\f\r'), '*_'), E' \t\n\x0B\f\r') AS title FROM (SELECT page_id, unnest(regexp_extract_all(m, '(?m)^#{{1,6}}[ \t\n\x0B\f\r]+(.+?)[ \t\n\x0B\f\r]*$', 1)) AS t FROM (SELECT page_id, {_HEADED} AS m FROM pages))", views=False)
def clean_headings(s: SparkSession, d: str) -> DataFrame:
    return headings(s, d).select("page_id", T.clean_heading(F.col("title")).alias("title"))


@register("STR12_newest_month", "SELECT coalesce(max(month), '0704') AS newest FROM papers WHERE has_text")
def newest_month(s: SparkSession, d: str) -> DataFrame:
    return M.papers(s, d).filter("has_text").agg(F.coalesce(F.max("month"), F.lit("0704")).alias("newest"))


@register("STR14_paper_text", rf"SELECT doc_id, sha256(trim(string_split(text, chr(10))[1]) || '. ' || trim(regexp_replace(text, '{_WS}', ' ', 'g'))) AS digest FROM documents", views=False)
def paper_texts(s: SparkSession, d: str) -> DataFrame:
    title = F.substring_index("text", "\n", 1)
    return _docs(s, d).select("doc_id", F.sha2(T.paper_text(title, F.col("text")), 256).alias("digest"))


_BLOCKS = ["system-reminder", "local-command-stdout", "local-command-stderr", "local-command-caveat"]
_DROPPED = "raw"
for _b in _BLOCKS:
    _DROPPED = f"regexp_replace({_DROPPED}, '<{_b}>.*?</{_b}>', ' ', 'gs')"


@register("STR16_clean_prompt", rf"SELECT conv_id, turn, sha256(trim(regexp_replace(regexp_replace({_DROPPED}, '</?[a-zA-Z][\w-]*([ \t\n\x0B\f\r][^<>]*)?>', ' ', 'g'), '{_WS}', ' ', 'g'))) AS digest FROM (SELECT *, '<system-reminder>' || role || chr(10) || '</system-reminder> <b class=\"x\">' || text || '</b> <local-command-stdout>out</local-command-stdout>' AS raw FROM conversations)", views=False)
def clean_prompts(s: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("<system-reminder>"), "role", F.lit('\n</system-reminder> <b class="x">'), "text", F.lit("</b> <local-command-stdout>out</local-command-stdout>"))
    return M.load(s, d, "conversations").select("conv_id", "turn", F.sha2(T.clean_prompt(raw), 256).alias("digest"))


@register("STR16_tool_line", "SELECT event_id, rtrim('[' || event_type || '] ' || CASE WHEN length(x) > 24 THEN x[1:21] || '...' ELSE x END) AS line FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN props ELSE props || ' | user ' || user_id END AS x FROM events)", views=False)
def tool_lines(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    fields = [F.when(k != 0, F.col("props")), F.lit("  "), F.when(k >= 2, F.concat(F.lit("user   "), F.col("user_id").cast("string"))), F.when(k != 0, F.lit(None).cast("string"))]
    return M.load(s, d, "events").select("event_id", T.tool_line(F.col("event_type"), fields, 24).alias("line"))


@register("STR17_words", "SELECT doc_id, len(w) AS n, sha256(array_to_string(list_sort(w), ' ')) AS digest FROM (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{3,}'), lambda x: regexp_replace(x, 's$', ''))) AS w FROM documents)", views=False)
def word_sets(s: SparkSession, d: str) -> DataFrame:
    w = T.words(F.col("text"))
    return _docs(s, d).select("doc_id", F.size(w).cast("long").alias("n"), F.sha2(F.array_join(F.array_sort(w), " "), 256).alias("digest"))


@register("STR18_distinctive_terms")
def terms(s: SparkSession, d: str) -> DataFrame:
    """The terms of each document; the pattern looks ahead, which the SQL engine's patterns cannot."""
    return _docs(s, d).select("doc_id", F.array_sort(T.distinctive_terms(F.col("text"))).alias("terms"))


@register("STR19_known_hard", r"SELECT doc_id, len(regexp_extract_all(raw, '(?m)^[ \t]*\|')) >= 3 OR length(raw) - length(regexp_replace(raw, '[$\\]', '', 'g')) >= 12 AS hard FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN replace(text, chr(10), chr(10) || ' | ') WHEN 1 THEN replace(text, ', ', ' $ ') ELSE text END AS raw FROM documents)", views=False)
def known_hard(s: SparkSession, d: str) -> DataFrame:
    raw = F.expr("CASE doc_id % 5 WHEN 0 THEN replace(text, '\\n', '\\n | ') WHEN 1 THEN replace(text, ', ', ' $ ') ELSE text END")
    return _docs(s, d).select("doc_id", T.is_known_hard(raw).alias("hard"))


_NORMAL = rf"lower(trim(regexp_replace(regexp_replace({{}}, '[*_#`>|]+', ' ', 'g'), '{_WS}', ' ', 'g')))"


@register("STR20_verbatim", rf"SELECT doc_id, len(p) > 0 AND list_count(list_filter(p, lambda x: contains(t, x))) = len(p) AS verbatim FROM (SELECT doc_id, {_NORMAL.format('text')} AS t, list_filter(list_transform(string_split_regex('**' || text[1:20] || '** … ' || text[41:70] || CASE WHEN doc_id % 3 = 0 THEN '...zq' ELSE '' END, '…|\.\.\.'), lambda x: {_NORMAL.format('x')}), lambda x: x <> '') AS p FROM documents)", views=False)
def verbatim(s: SparkSession, d: str) -> DataFrame:
    span = F.concat(F.lit("**"), F.substring("text", 1, 20), F.lit("** … "), F.substring("text", 41, 30), F.when(F.col("doc_id") % 3 == 0, "...zq").otherwise(""))
    return _docs(s, d).select("doc_id", T.spans_verbatim(F.array(span), F.array(F.col("text"))).alias("verbatim"))


_COMMENTS = ["Accepted at NeurIPS 2024", "12 pages", "a note on ICML", "", "To appear in Proc. of SIGMOD", "Submitted to KDD"]
_JOURNALS = ["", "Journal of Odd Things, vol. 3", "Trans. JMLR 12", " , none"]
_DOIS = ["", "10.1145/123", "10.1038/x.y", "10.9999/1", "doi:10.1145/1", "10.1103/5"]


def _venue_sql() -> str:
    token = "|".join(sorted(T.TOP_VENUES, key=len, reverse=True))
    label = " ".join(f"WHEN '{k}' THEN '{n}'" for k, (n, _) in T.DOI_PREFIXES.items())
    tier = " ".join(f"WHEN '{k}' THEN {t}" for k, (_, t) in T.DOI_PREFIXES.items())
    cue = T.ACCEPTED
    return rf"""SELECT paper_id, CASE WHEN b = 0 THEN NULL WHEN t1 = b THEN v1 WHEN t2 = b THEN v2 ELSE v3 END AS venue, b AS rigor FROM (
SELECT *, greatest(t1, t2, t3) AS b FROM (SELECT paper_id,
 upper(regexp_extract(c, '(?i)\b({token})\b', 1)) AS v1, CASE WHEN regexp_extract(c, '(?i)\b({token})\b', 1) = '' THEN 0 WHEN regexp_matches(c, '(?i){cue}') THEN 3 ELSE 2 END AS t1,
 CASE WHEN regexp_extract(j, '(?i)\b({token})\b', 1) <> '' THEN upper(regexp_extract(j, '(?i)\b({token})\b', 1)) ELSE nullif(trim(string_split(j, ',')[1])[1:60], '') END AS v2,
 CASE WHEN regexp_extract(j, '(?i)\b({token})\b', 1) <> '' THEN 3 WHEN j <> '' THEN 1 ELSE 0 END AS t2,
 CASE WHEN doi[1:3] = '10.' THEN CASE string_split(doi, '/')[1] {label} ELSE 'published' END END AS v3, CASE WHEN doi[1:3] = '10.' THEN CASE string_split(doi, '/')[1] {tier} ELSE 1 END ELSE 0 END AS t3
FROM (SELECT paper_id, {_sql_list(_COMMENTS)}[paper_id % 6 + 1] AS c, {_sql_list(_JOURNALS)}[paper_id // 6 % 4 + 1] AS j, {_sql_list(_DOIS)}[paper_id // 24 % 6 + 1] AS doi FROM catalog)))"""


def _venues(s: SparkSession, d: str) -> DataFrame:
    pick = lambda words, at: F.element_at(F.array(*[F.lit(w) for w in words]), (F.expr(at) + 1).cast("int"))
    found = T.venue(pick(_JOURNALS, "paper_id div 6 % 4"), pick(_DOIS, "paper_id div 24 % 6"), pick(_COMMENTS, "paper_id % 6"))
    return M.catalog(s, d).select("paper_id", found.alias("v")).select("paper_id", "v.venue", "v.rigor")


@register("STR21_extract_venue", _venue_sql(), "catalog")
def venues(s: SparkSession, d: str) -> DataFrame:
    return _venues(s, d)


@register("AGG40_rigor_histogram", f"SELECT rigor, count(*) AS n FROM ({_venue_sql()}) GROUP BY rigor", "catalog")
def rigor_histogram(s: SparkSession, d: str) -> DataFrame:
    return _venues(s, d).groupBy("rigor").agg(F.count(F.lit(1)).alias("n"))


@register("STR22_author_key", "SELECT DISTINCT lower(string_split(n, ' ')[2]) || '|' || lower(string_split(n, ' ')[1][1]) AS key FROM (SELECT unnest(string_split_regex(authors, ', | and ')) AS n FROM catalog WHERE authors <> '')", "catalog")
def author_keys(s: SparkSession, d: str) -> DataFrame:
    name = F.split("name", " ")
    names = M.catalog(s, d).filter("authors <> ''").select(F.explode(F.split("authors", ", | and ")).alias("name"))
    return names.select(T.author_key(F.element_at(name, 2), F.element_at(name, 1)).alias("key")).distinct()


_STAMP = "CASE WHEN o_custkey % 17 = 0 THEN 'bad' ELSE strftime(o_orderdate, '%a, %-d %b %Y %H:%M:%S GMT') END"


def _stamped(s: SparkSession, d: str) -> DataFrame:
    stamp = F.when(F.col("o_custkey") % 17 == 0, F.lit("bad")).otherwise(F.concat(F.date_format("o_orderdate", "E, d MMM yyyy HH:mm:ss"), F.lit(" GMT")))
    return M.load(s, d, "orders").select("o_orderkey", "o_custkey", stamp.alias("created"))


@register("STR23_submitted_date", f"SELECT o_orderkey, CASE WHEN created = 'bad' THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM (SELECT *, {_STAMP} AS created FROM orders)", views=False)
def submitted(s: SparkSession, d: str) -> DataFrame:
    return _stamped(s, d).select("o_orderkey", T.submitted_date(F.col("created")).alias("day"))


@register("STR24_versions", f"SELECT o_orderkey, CASE WHEN created <> 'bad' THEN CAST(year(o_orderdate) AS INTEGER) END AS year, CASE WHEN o_custkey % 6 > 0 THEN 'v' || (o_custkey % 6) END AS version FROM (SELECT *, {_STAMP} AS created FROM orders)", views=False)
def versions(s: SparkSession, d: str) -> DataFrame:
    tags = F.transform(F.slice(F.array(*[F.lit(k) for k in range(1, 6)]), 1, (F.col("o_custkey") % 6).cast("int")), lambda k: F.concat(F.lit("v"), k.cast("string")))
    return _stamped(s, d).select("o_orderkey", T.first_version_year(F.col("created")).alias("year"), F.try_element_at(tags, F.lit(-1)).alias("version"))


_IP = "CASE event_id % 3 WHEN 0 THEN '10.' || (user_id % 250) || '.7.' || (event_id % 250) WHEN 1 THEN '::ffff:192.0.2.' || (event_id % 250) ELSE '2001:DB8:0:' || (user_id % 90 + 1) || ':0:0:0:' || (event_id % 90 + 1) END"


@register("STR25_hashed_address", f"SELECT event_id, sha256('salt:' || CASE event_id % 3 WHEN 0 THEN ip WHEN 1 THEN ip[8:] ELSE '2001:db8:0:' || (user_id % 90 + 1) || '::/64' END) AS ip_hash FROM (SELECT *, {_IP} AS ip FROM events)", views=False)
def hashed_addresses(s: SparkSession, d: str) -> DataFrame:
    return M.load(s, d, "events").select("event_id", F.expr(_IP).alias("ip")).select("event_id", T.hashed_address(F.col("ip"), "salt").alias("ip_hash"))


@register("STR26_client_ip", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '203.0.113.9' WHEN event_id % 4 = 1 THEN '10.0.0.1' WHEN event_id % 4 = 2 THEN '198.51.100.' || (event_id % 200) ELSE '10.1.1.1' END AS client FROM events", views=False)
def clients(s: SparkSession, d: str) -> DataFrame:
    e = M.load(s, d, "events").withColumn("k", F.col("event_id") % 4)
    peer = F.when(F.col("k") == 0, "203.0.113.9").otherwise("10.0.0.1")
    hop = F.concat(F.lit("198.51.100."), (F.col("event_id") % 200).cast("string"))
    forwarded = F.when(F.col("k") == 0, "1.2.3.4").when(F.col("k") == 2, F.concat(F.lit("junk, "), hop, F.lit(" , 10.2.2.2"))).when(F.col("k") == 3, "10.1.1.1, 10.2.2.2")
    return e.select("event_id", T.client_ip(peer, forwarded, ["10.0.0.0/8"]).alias("client"))


_CITED = "'see ' || pid || 'v2 and 9901.00001, but 1.' || pid || ' stays'"


@register("STR27_strip_unretrieved", f"SELECT pid, 'see ' || CASE WHEN paper_id % 2 = 0 THEN pid || 'v2' ELSE '[citation removed: not retrieved this turn]' END || ' and [citation removed: not retrieved this turn], but 1.' || pid || ' stays' AS answer FROM (SELECT * REPLACE ({M.SHORT_ID} AS pid) FROM catalog)", "catalog")
def stripped(s: SparkSession, d: str) -> DataFrame:
    allowed = F.when(F.col("paper_id") % 2 == 0, F.array("pid")).otherwise(F.array().cast("array<string>"))
    return M.catalog(s, d).withColumn("pid", M.short_id(F.col("paper_id"))).select("pid", T.strip_unretrieved(F.expr(_CITED), allowed).alias("answer"))


@register(
    "STR28_fence",
    r"""SELECT page_id, sha256('<data>' || chr(10) || replace(replace('{"url":"' || url || '","html":"' || substr(regexp_replace(html, '["\\\x00-\x1f]', ' ', 'g'), 1, 200) || '"}', '<', '\u003c'), '>', '\u003e') || chr(10) || '</data>') AS digest
FROM pages WHERE html IS NOT NULL AND url IS NOT NULL""",
    views=False,
)
def fenced(s: SparkSession, d: str) -> DataFrame:
    plain = F.substring(F.regexp_replace("html", r'["\\\x00-\x1f]', " "), 1, 200)
    json = F.to_json(F.struct("url", plain.alias("html")))
    return M.load(s, d, "pages").filter("html is not null and url is not null").select("page_id", F.sha2(T.fence(json, "data"), 256).alias("digest"))


@register("STR29_display", """SELECT event_id, CAST(floor(value / 100 * 100 + 0.5) AS BIGINT) || '%' AS share, event_id % 130 || CASE WHEN event_id % 100 BETWEEN 11 AND 13 AND event_id % 130 = event_id % 100 OR event_id % 130 BETWEEN 111 AND 113 THEN 'th' WHEN event_id % 130 % 10 = 1 AND event_id % 130 NOT IN (11, 111) THEN 'st' WHEN event_id % 130 % 10 = 2 AND event_id % 130 NOT IN (12, 112) THEN 'nd' WHEN event_id % 130 % 10 = 3 AND event_id % 130 NOT IN (13, 113) THEN 'rd' ELSE 'th' END AS place,
CASE WHEN event_id % 7 = 0 THEN 'miss' WHEN event_id % 7 = 1 THEN 'first' WHEN event_id % 7 <= 3 THEN 'near' ELSE 'inside' END AS band,
CASE WHEN event_id % 7 = 0 AND event_id % 5 = 0 THEN 'missed' WHEN event_id % 5 = 0 THEN 'down' WHEN event_id % 7 = 0 OR event_id % 5 < event_id % 7 THEN 'up' WHEN event_id % 5 = event_id % 7 THEN 'same' ELSE 'down' END AS move,
strftime(ts, '%B %Y') AS month FROM events""", views=False)
def display(s: SparkSession, d: str) -> DataFrame:
    e = M.load(s, d, "events")
    rank = lambda k: F.when(F.col("event_id") % k != 0, F.col("event_id") % k)
    return e.select("event_id", T.pct(F.col("value") / 100).alias("share"), T.ordinal(F.col("event_id") % 130).alias("place"), T.rank_band(rank(7)).alias("band"), T.rerank_move(rank(7), rank(5)).alias("move"), T.month_name(F.date_format("ts", "yyMM")).alias("month"))


@register("STR29_best_of_board", """SELECT tool, year, round(mean, 6) AS mean, n, floor(mean * 100 + 0.5) = min(floor(mean * 100 + 0.5)) OVER (PARTITION BY year) AS cheapest, n = max(n) OVER (PARTITION BY year) AS busiest
FROM (SELECT tool, CAST(session_id % 10 AS INTEGER) AS year, CAST(sum(CAST(round(cost * 1000) AS BIGINT)) AS DOUBLE) / count(*) / 1000 AS mean, count(*) AS n FROM runs GROUP BY ALL)""")
def best_of_board(s: SparkSession, d: str) -> DataFrame:
    """Boards of tools, one for each last digit of a session: which is cheapest as printed, which has most runs."""
    runs = M.runs(s, d).select("tool", (F.col("session_id") % 10).cast("int").alias("year"), F.round(F.col("cost") * 1000).cast("long").alias("m"))
    board = runs.groupBy("tool", "year").agg((F.sum("m").cast("double") / F.count(F.lit(1)) / 1000).alias("mean"), F.count(F.lit(1)).alias("n"))
    return board.select("tool", "year", F.round("mean", 6).alias("mean"), "n", T.is_best(F.col("mean"), ["year"], lower=True).alias("cheapest"), T.is_best(F.col("n"), ["year"], exact=True).alias("busiest"))
