"""The thin queries of the operators; `oracles` holds SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakelens.llm.shared import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakelens.llm.suffixes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakelens.llm.secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakelens.llm.search import search

    return search(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakelens.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).drop("path", "offset")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakelens.llm.lm import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakelens.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakelens.llm.jaccard import join_similar

    return join_similar(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakelens.llm.decontam import find_contamination

    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lakelens.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakelens.llm.ring import shard_rows

    return shard_rows(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lakelens.llm.align import align_tokens

    return align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakelens.llm.audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakelens.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


OP4 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to
FROM f
"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS8 = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_WORDS7 = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"

OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS7} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS g
      FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 85 * (a.n + b.n - o)),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT r.x AS doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.y) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.x GROUP BY r.x
"""

OP8 = f"""
WITH d AS (SELECT doc_id, {_WORDS8} AS w FROM documents),
b AS (SELECT item_id, {_WORDS8} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
       FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, s)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


_WORDS12 = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Every order is walked: the first of its filters that a row fails removes the row.
OP12 = f"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS12} AS w FROM documents),
good AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, doc_id, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
             100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
             coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
g AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN good USING (doc_id) GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS o FROM l p, l q, l r, l s, l t
      WHERE p.x NOT IN (q.x, r.x, s.x, t.x) AND q.x NOT IN (r.x, s.x, t.x) AND r.x NOT IN (s.x, t.x) AND s.x <> t.x),
k AS (SELECT part, n, good, toxic, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
             || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails FROM g),
z AS (SELECT part, n, good, toxic, fails, o, list_min(list_transform(string_split(fails, ''), lambda x: instr(o, x))) AS place FROM k, o WHERE fails <> ''
      UNION ALL SELECT part, n, good, toxic, fails, o, 6 FROM k, o WHERE fails = ''),
m AS (SELECT part, o, step, substr(o, step, 1) AS x, sum(CASE WHEN place > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN place = step THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN place < step AND contains(fails, substr(o, step, 1)) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = substr(o, step, 1) THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN place = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN place = step THEN toxic ELSE 0 END) AS toxic_lost
      FROM z, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step) GROUP BY part, o, step)
SELECT part, o AS filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM m
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": OP4, "op7_jaccard_join": OP7, "op8_decontamination": OP8, "op12_filter_audit": OP12}
