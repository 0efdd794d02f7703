"""From texts to edges and chunks: citation ids, sections, pages, windows, tokenizers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from lakelens.operators.ordered import lines_with_offsets, spans
from lakelens.operators.relational import once

FIRST_MONTH = "0704"
PAPER, PREAMBLE = "__paper__", "__preamble__"
# How ids are written, with a marker or bare.
_MARKED = r"(?i)(?:arxiv\s*[.:/]?\s*(?:org)?\s*/?\s*(?:abs|pdf)?/?\s*|abs/|pdf/)(\d{4}\.\d{4,5})"
_BARE = r"(?<![\d.])(\d{4}\.\d{4,5})(?!\d)(?!\.\d)"


def cited_ids(text: Column, own: Column, newest: Column | str) -> Column:
    """Distinct ids that a text cites, sorted, without its own; their months exist and are not after the newest."""
    newest = F.lit(newest) if isinstance(newest, str) else newest
    found = F.array_union(F.regexp_extract_all(text, F.lit(_MARKED)), F.regexp_extract_all(text, F.lit(_BARE)))
    real = lambda i: (F.substring(i, 1, 4) >= FIRST_MONTH) & (F.substring(i, 1, 4) <= newest) & F.substring(i, 3, 2).between("01", "12")
    return F.array_sort(F.array_except(F.filter(found, real), F.array(own)))


def citation_edges(texts: DataFrame) -> DataFrame:
    """Distinct (citing_id, cited_id) of texts (pid, text); the newest month held bounds what can be cited."""
    newest = texts.agg(F.coalesce(F.max(F.substring("pid", 1, 4)), F.lit(FIRST_MONTH)).alias("newest"))
    rows = texts.join(F.broadcast(newest))  # a single row
    return rows.select(F.col("pid").alias("citing_id"), F.explode(cited_ids(F.col("text"), F.col("pid"), F.col("newest"))).alias("cited_id")).distinct()


def edge_stats(texts: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: papers scanned, papers with citations, edges, distinct cited works."""
    by = edges.groupBy("citing_id").agg(F.count(F.lit(1)).alias("k")).agg(F.count(F.lit(1)).alias("papers_with_citations"), F.coalesce(F.sum("k"), F.lit(0)).alias("edges"))
    works = edges.select("cited_id").distinct().agg(F.count(F.lit(1)).alias("distinct_cited"))
    return texts.agg(F.count(F.lit(1)).alias("papers_scanned")).join(F.broadcast(by)).join(F.broadcast(works))  # single rows


_HEADING = r"^#{1,6}[ \t\x0B\f\r]+(.+?)[ \t\x0B\f\r]*$"


def sections(markdown: DataFrame, key: str) -> DataFrame:
    """key, section, char_start and char_end: what runs from a heading to the next, and what leads up to the first."""
    lines = lines_with_offsets(markdown, key, "markdown")
    length = F.length("markdown").cast("long").alias("length")
    heads = lines.filter(F.col("line").rlike(_HEADING)).select(key, "start", F.regexp_extract("line", _HEADING, 1).alias("section"))
    lead = markdown.select(key, F.lit(0).cast("long").alias("start"), F.lit(PREAMBLE).alias("section"))
    lead = lead.join(heads.filter("start = 0").select(key), key, "left_anti")
    rows = lead.unionByName(heads).join(markdown.select(key, length), key)
    return spans(rows, key, "start", F.col("length")).select(key, "section", F.col("start").alias("char_start"), F.col("stop").alias("char_end")).filter("char_end > char_start")


def aligned(headings: Column, stored: Column) -> Column:
    """Stored sections beside the headings they come from, by position; one more stored section is a preamble. Other counts raise."""
    off = F.size(stored) - F.size(headings)
    own = F.when(off == 1, F.slice(stored, 2, F.size(headings) + 1)).when(off == 0, stored)
    checked = F.coalesce(own, F.raise_error(F.lit("sections and headings do not match")).cast("array<string>"))
    return F.zip_with(headings, checked, lambda h, t: F.struct(h.alias("heading"), F.coalesce(F.when(t != "", t), F.lit(PREAMBLE)).alias("section")))


def window_starts(n: Column, size: int, overlap: float) -> Column:
    """First tokens of windows of `size` with an overlap; the last window reaches the end."""
    step = max(1, size - round(size * overlap))
    return F.when(n <= 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(n - (size - step), F.lit(1)) - 1, F.lit(step)))


def word_chunks(markdown: DataFrame, key: str, size: int = 1000, overlap: float = 0.15) -> DataFrame:
    """key, section, char_start, char_end, text and n_tokens of windows of words; a token is a word and the white space before it."""
    text = F.expr("substring(markdown, char_start + 1, char_end - char_start)")
    s = sections(markdown, key).join(markdown, key).withColumn("body", text).drop("markdown")
    pieces = F.regexp_extract_all("body", F.lit(r"([ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$)"))
    s = once(s, "tokens", pieces).withColumn("i", F.explode(window_starts(F.size("tokens"), size, overlap)))
    s = s.withColumn("before", F.expr("length(array_join(slice(tokens, 1, i), ''))")).withColumn("text", F.expr(f"array_join(slice(tokens, i + 1, {size}), '')"))
    start = (F.col("char_start") + F.col("before")).cast("long")
    rows = s.select(key, "section", "i", F.col("char_start").alias("section_start"), start.alias("char_start"), (start + F.length("text")).alias("char_end"), "text", F.expr(f"least({size}, size(tokens) - i)").alias("n_tokens"))
    return rows.filter(F.trim(F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", " ")) != "")


_VOCABULARIES: dict = {}


def _vocabulary(path: str):
    """A byte-level vocabulary (.json), read once a process; strings of special tokens are plain text."""
    if path not in _VOCABULARIES:
        from tokenizers import Tokenizer

        _VOCABULARIES[path] = Tokenizer.from_file(path)
        _VOCABULARIES[path].encode_special_tokens = True
    return _VOCABULARIES[path]


#: Characters that are encoded at once; a longer text goes alone.
ENCODED = 1 << 18


def encoded(texts: list[str], path: str) -> Iterator[np.ndarray]:
    """The token ids of each text. Encodings of a few texts are in memory at a time: they take much more room than their ids."""
    vocabulary = _vocabulary(path)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ENCODED, side="right")))
        yield from (np.array(e.ids, np.int32) for e in vocabulary.encode_batch_fast(texts[at:end], add_special_tokens=False))
        at = end


def token_ends(texts: list[str], path: str) -> list[np.ndarray]:
    """For each text where its tokens end, in characters.

    A token's name has a character for each of its bytes. A token that ends inside a character ends after it, as the
    decoded prefix would.
    """
    vocabulary, out = _vocabulary(path), []
    for text, e in zip(texts, vocabulary.encode_batch(texts, add_special_tokens=False), strict=True):
        ends = np.cumsum([len(vocabulary.id_to_token(i)) for i in e.ids], dtype=np.int64)
        begun = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
        out.append(begun[ends - 1] if len(ends) else np.empty(0, np.int64))
    return out


def windows(n: int, size: int, overlap: float) -> np.ndarray:
    """First tokens of the windows of n tokens, as window_starts gives them."""
    step = max(1, size - round(size * overlap))
    return np.arange(0, max(n - (size - step), 1) if n else 0, step)


def token_windows(texts: DataFrame, key: list[str], text: str, path: str, size: int, overlap: float) -> DataFrame:
    """The key columns, i, char_start, char_end and n_tokens of windows of tokens, cut where tokens end; offsets are within the text, null texts have none."""
    kinds = dict(texts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for r, ends in enumerate(token_ends([t or "" for t in part.column(len(key)).to_pylist()], path)):
                    starts = np.concatenate([[0], ends])
                    rows += [(r, i, int(starts[i]), int(starts[min(i + size, len(ends))]), min(size, len(ends) - i)) for i in windows(len(ends), size, overlap).tolist()]
                owner, *columns = [pa.array([x[c] for x in rows], k) for c, k in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(owner) for c in range(len(key))), *columns], names=[*key, "i", "char_start", "char_end", "n_tokens"])

    return texts.select(*key, text).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", i int, char_start long, char_end long, n_tokens int")


def token_chunks(markdown: DataFrame, key: str, path: str, size: int = 1000, overlap: float = 0.15) -> DataFrame:
    """As word_chunks, in tokens of a vocabulary: sections are encoded by themselves, windows without a printing character are left out."""
    body = F.expr("substring(markdown, char_start + 1, char_end - char_start)")
    s = sections(markdown, key).join(markdown, key).select(key, "section", F.col("char_start").alias("section_start"), body.alias("body"))
    cut = token_windows(s, [key, "section", "section_start", "body"], "body", path, size, overlap)
    rows = cut.select(key, "section", "section_start", "i", F.expr("substring(body, char_start + 1, char_end - char_start)").alias("text"), (F.col("section_start") + F.col("char_start")).alias("char_start"), (F.col("section_start") + F.col("char_end")).alias("char_end"), "n_tokens")
    return rows.filter(F.col("text").rlike(r"\S"))


def chunk_papers(papers: DataFrame, markdown: DataFrame, key: str, page_chars: int, size: int = 1000, overlap: float = 0.15, vocabulary: str | None = None) -> DataFrame:
    """Chunks of papers: one of title and abstract, then windows of each section, numbered from 0, with their pages.

    Windows are of tokens of the vocabulary (a path); without one, of words.

    papers: key, title, abstract; markdown: key, markdown. Pages are of `page_chars` characters.
    """
    head = F.trim(F.concat("title", F.lit("\n\n"), "abstract"))
    first = papers.select(key, F.lit(PAPER).alias("section"), F.lit(-1).cast("long").alias("section_start"), F.lit(-1).alias("i"), head.alias("text"), (token_counts(vocabulary)(head).cast("int") if vocabulary else F.size(tokenizer()(head))).alias("n_tokens"), F.lit(1).cast("long").alias("page_start"), F.lit(1).cast("long").alias("page_end"))
    page = lambda c: F.floor(c / page_chars) + 1
    body = token_chunks(markdown, key, vocabulary, size, overlap) if vocabulary else word_chunks(markdown, key, size, overlap)
    body = body.select(key, "section", "section_start", "i", "text", "n_tokens", page(F.col("char_start")).alias("page_start"), page(F.greatest(F.col("char_start"), F.col("char_end") - 1)).alias("page_end"))
    seq = F.row_number().over(Window.partitionBy(key).orderBy("section_start", "i")) - 1
    rows = first.unionByName(body).withColumn("seq", seq)
    return rows.withColumn("chunk_id", F.concat(F.col(key).cast("string"), F.lit("#"), F.col("seq").cast("string"))).drop("section_start", "i")


def tokenizer(path: str | None = None) -> Callable[[Column], Column]:
    """Text to token ids by a tokenizer file, special strings as text; without one, words stand for tokens by hash."""
    if path is None:
        return lambda text: F.transform(F.regexp_extract_all(text, F.lit(r"([^ \t\n\x0B\f\r]+)")), lambda w: F.hash(w))

    @F.pandas_udf(ArrayType(IntegerType()))
    def ids(text: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(text), dtype=object)
        for i, x in enumerate(encoded(text.fillna("").tolist(), path)):
            out.iat[i] = x
        return out

    return ids


def token_counts(path: str) -> Callable[[Column], Column]:
    """Text to the number of its tokens by a tokenizer file, special strings as text; null has none. The ids stay in the task."""

    @F.pandas_udf(LongType())
    def counts(text: pd.Series) -> pd.Series:
        return pd.Series([len(x) for x in encoded(text.fillna("").tolist(), path)], dtype="int64")

    return counts
