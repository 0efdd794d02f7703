"""The answer guard: verbatim runs against sources, quote budgets, unretrieved citations, excerpts, page reads."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lakelens.operators.relational import once, within_budget

MARK, REMOVED = "[…]", "[citation removed: not retrieved this turn]"
QUOTE_WORDS, QUOTE_LEAST, QUOTES_A_PAPER = 50, 15, 3


def answer_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"))


def shingles(words: Column, n: int) -> Column:
    """All runs of n words, in order, none of a shorter list."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def shingle_places(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """key, at (from 0) and hash of every run of n words; words are hashed once, runs are hashes of their words' hashes."""
    words = once(df.select(key, text), "_words", F.transform(answer_words(F.col(text)), lambda w: F.xxhash64(w)))
    starts = F.when(F.size("_words") >= n, F.sequence(F.lit(1), F.size("_words") - n + 1)).otherwise(F.array().cast("array<int>"))
    return words.select(key, F.posexplode(F.transform(starts, lambda i: F.xxhash64(F.slice("_words", i, F.lit(n))))).alias("at", "hash"))


def matches(answers: DataFrame, key: str, sources: DataFrame, n: int) -> DataFrame:
    """key and at of every run of n words of an answer that a source has: an inverted-index probe.

    Sources' runs are made distinct before the join, so a run that many sources have does not multiply rows.
    """
    held = shingle_places(sources, "source_id", "text", n).select("hash").distinct()
    return shingle_places(answers, key, "text", n).join(held, "hash", "left_semi").select(key, "at")


_RUN = "struct<first:int,stop:int>"


def verbatim_runs(found: DataFrame, key: str, n: int) -> DataFrame:
    """key, first and stop (words, exclusive) of maximal verbatim runs, left to right; one resumes where the last ended.

    Matches of an answer are folded in order; their number is bounded by the answer's own length.
    """
    ordered = found.groupBy(key).agg(F.array_sort(F.collect_set(F.col("at").cast("int"))).alias("at"))
    none = F.struct(F.array().cast(f"array<{_RUN}>").alias("runs"), F.lit(-1).alias("first"), F.lit(-2).alias("last"), F.lit(0).alias("resume"))

    def close(s: Column) -> Column:
        run = F.struct(s["first"].alias("first"), (s["last"] + n).alias("stop"))
        return F.when(s["first"] >= 0, F.concat(s["runs"], F.array(run))).otherwise(s["runs"])

    def step(s: Column, p: Column) -> Column:
        resume = F.when(s["first"] >= 0, s["last"] + n).otherwise(s["resume"])
        grown = F.struct(s["runs"].alias("runs"), s["first"].alias("first"), p.alias("last"), s["resume"].alias("resume"))
        opened = F.struct(close(s).alias("runs"), p.alias("first"), p.alias("last"), resume.alias("resume"))
        return F.when((s["first"] >= 0) & (p == s["last"] + 1), grown).when(p >= resume, opened).otherwise(s)

    runs = F.aggregate("at", none, step, close)
    return ordered.select(key, F.explode(runs).alias("r")).select(key, "r.first", "r.stop")


@dataclass(frozen=True)
class Hardened:
    text: str
    stripped: tuple[str, ...] = ()
    capped: int = 0
    dropped: int = 0


_TOKEN = re.compile(r"\w+")
_ID = re.compile(r"(?<![\w.])(\d{4}\.\d{4,5})(v\d+)?(?!\d)")


def _runs(words: list[str], held: dict[tuple, set], n: int) -> list[tuple[int, int, set]]:
    out, at = [], 0
    while at + n <= len(words):
        owners = held.get(tuple(words[at : at + n]))
        if not owners:
            at += 1
            continue
        owners, end = set(owners), at + n
        while end < len(words) and (more := held.get(tuple(words[end - n + 1 : end + 1]))):
            owners |= more
            end += 1
        out.append((at, end, owners))
        at = end
    return out


@lru_cache(maxsize=4)
def _held(sources: tuple[tuple[str, tuple[str, ...]], ...], n: int) -> dict[tuple, set]:
    """Runs of n words and the papers that have them; answers that follow one another often share their sources."""
    out: dict[tuple, set] = {}
    for paper, texts in sources:
        for text in texts:
            words = _TOKEN.findall(text.lower())
            for i in range(len(words) - n + 1):
                out.setdefault(tuple(words[i : i + n]), set()).add(paper)
    return out


def harden(text: str, sources: dict[str, list[str]], allowed: Iterable[str], most: int = QUOTE_WORDS, least: int = QUOTE_LEAST, quotes: int = QUOTES_A_PAPER) -> Hardened:
    """An answer with runs beyond `most` words cut, no more than `quotes` quotes a paper, and ids that were not retrieved struck out.

    A quote of several papers counts once for each and goes only if all of them are used up.
    """
    if not text.strip():
        return Hardened(text)

    def cut(text: str, runs: list[tuple[int, int]], keep: int) -> str:
        places = [m.span() for m in _TOKEN.finditer(text)]
        for first, end in sorted(runs, reverse=True):
            text = text[: places[first + keep][0]] + MARK + text[places[end - 1][1] :]
        return text

    words = lambda t: [w.lower() for w in _TOKEN.findall(t)]
    named = tuple((p, tuple(x)) for p, x in sources.items())
    long = [(a, z) for a, z, _ in _runs(words(text), _held(named, most + 1), most + 1)]
    text = cut(text, long, most)
    used: dict[str, int] = {}
    over = []
    for a, z, owners in _runs(words(text), _held(named, least), least):
        if all(used.get(p, 0) >= quotes for p in owners):
            over.append((a, z))
        else:
            for p in owners:
                used[p] = used.get(p, 0) + 1
    text = cut(text, over, 0)
    allowed, struck = set(allowed), []

    def check(m: re.Match) -> str:
        if m[1] in allowed:
            return m[0]
        if m[1] not in struck:
            struck.append(m[1])
        return REMOVED

    return Hardened(_ID.sub(check, text), tuple(struck), len(long), len(over))


_HARDENED = StructType([StructField("text", StringType()), StructField("stripped", ArrayType(StringType())), StructField("capped", IntegerType()), StructField("dropped", IntegerType())])


@F.pandas_udf(_HARDENED)
def hardened(text: pd.Series, papers: pd.Series, texts: pd.Series, allowed: pd.Series) -> pd.DataFrame:
    """harden() for columns: papers and texts are arrays side by side, a source each."""
    out = []
    for t, p, x, a in zip(text, papers, texts, allowed, strict=True):
        sources: dict[str, list[str]] = {}
        for paper, source in zip(p, x, strict=True):
            sources.setdefault(paper, []).append(source)
        h = harden(t or "", sources, a)
        out.append((h.text, list(h.stripped), h.capped, h.dropped))
    return pd.DataFrame(out, columns=["text", "stripped", "capped", "dropped"])


def guard_sources(calls: DataFrame, chunks: DataFrame) -> DataFrame:
    """run_id, paper_id, text: all chunks of papers that were read, and cited chunks of others; calls that failed do not count.

    calls: run_id, ok, name, paper_id (of a read), chunk_id (of a citation); chunks: chunk_id, paper_id, text.
    """
    good = calls.filter("ok")
    read = good.filter("name = 'read_paper' and cast(paper_id as string) <> ''").select("run_id", "paper_id").distinct()
    cited = good.filter("chunk_id is not null").select("run_id", "chunk_id").distinct().join(chunks, "chunk_id")
    whole = read.join(chunks, "paper_id").select("run_id", "paper_id", "text")
    return whole.unionByName(cited.join(read, ["run_id", "paper_id"], "left_anti").select("run_id", "paper_id", "text"))


def retrieved_papers(calls: DataFrame, chunks: DataFrame) -> DataFrame:
    """run_id and paper_id of what a turn may cite: papers of citations and papers read, of calls that went well."""
    good = calls.filter("ok")
    cited = good.filter("chunk_id is not null").select("run_id", "chunk_id").join(chunks.select("chunk_id", "paper_id"), "chunk_id").select("run_id", "paper_id")
    read = good.filter("name = 'read_paper' and cast(paper_id as string) <> ''").select("run_id", "paper_id")
    return cited.unionByName(read).distinct()


def excerpts(asked: DataFrame, chunks: DataFrame, most: int = 3, words: int = 50) -> DataFrame:
    """Of each paper the first `most` chunks asked for, by page, cut to `words` words.

    asked: paper_id, chunk_id, place (from 1); chunks: chunk_id, paper_id, page_start, text.
    """
    first = asked.filter(F.col("place") <= most)
    w = F.split(F.trim(F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", " ")), " ")
    rows = chunks.join(first, ["paper_id", "chunk_id"])
    return rows.select("paper_id", "chunk_id", "page_start", F.array_join(F.slice(w, 1, words), " ").alias("excerpt"), (F.size(w) > words).alias("truncated"))


def read_pages(chunks: DataFrame, first: int | None, last: int | None, budget: int) -> DataFrame:
    """Chunks of a page range by page until the budget of tokens, with what there is, what was used and whether it was cut."""
    rows = chunks
    if first is not None:
        rows = rows.filter(F.col("page_end") >= first)
    if last is not None:
        rows = rows.filter(F.col("page_start") <= last)
    total = F.count(F.lit(1)).over(Window.partitionBy("paper_id"))
    kept = within_budget(rows.withColumn("spans_available", total), ["paper_id"], ["page_start", "seq"], "n_tokens", budget)
    kept_n = F.count(F.lit(1)).over(Window.partitionBy("paper_id"))
    return kept.withColumn("truncated", kept_n < F.col("spans_available")).withColumn("tokens_used", F.max("running").over(Window.partitionBy("paper_id")))
