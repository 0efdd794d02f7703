"""Lexical search: token index, phrase queries, BM25 with corpus-global statistics."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lakelens.operators.relational import once

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
_CONTROL = {i: None for i in (*range(0x20), 0x7F)}
_WORD = r"[\p{L}\p{N}]+"


# ---------------------------------------------------------------- tokens


def plain_tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case; no stems. A built-in expression."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({_WORD})"))


_VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    if w[i] == "y":
        return i == 0 or not _consonant(w, i - 1)
    return w[i] not in _VOWELS


def _measure(w: str) -> int:
    """How many times vowels are followed by consonants."""
    kinds = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", kinds))


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 1) and not _consonant(w, n - 2) and _consonant(w, n - 3) and w[-1] not in "wxy"


# The suffixes of steps 2 to 4 of the published stemming algorithm.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _longest(w: str, suffixes: list[str]) -> str | None:
    return max((x for x in suffixes if w.endswith(x)), key=len, default=None)


def stem(w: str) -> str:
    """The stem of an English word by M. F. Porter's algorithm (1980); short words and others' letters stay."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        end = next((x for x in ("ed", "ing") if w.endswith(x) and _has_vowel(w[: -len(x)])), None)
        if end:
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        end = _longest(w, list(table))
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = _longest(w, _STEP4)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)][-1:] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stemmed(text: str) -> list[str]:
    """Lower-case runs of letters and digits without accents, stemmed."""
    flat = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return [stem(w) for w in re.findall(r"[^\W_]+", flat)]


@F.pandas_udf(ArrayType(StringType()))
def stemmed_tokens(text: pd.Series) -> pd.Series:
    return text.fillna("").map(stemmed)


def plain(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


TOKENIZERS: dict[str, tuple[Callable[[Column], Column], Callable[[str], list[str]]]] = {"plain": (plain_tokens, plain), "porter": (stemmed_tokens, stemmed)}


# ---------------------------------------------------------------- queries


def any_phrases(query: str, tokenizer: str = "plain") -> list[list[str]]:
    """Each white-space term is a phrase, any of which may match; control characters go, a term without tokens too."""
    terms = [t.translate(_CONTROL) for t in query.split()]
    return [p for p in map(TOKENIZERS[tokenizer][1], terms) if p]


def all_phrases(query: str, tokenizer: str = "plain") -> list[list[str]] | None:
    """Quoted phrases and words, all of which must match; None when there is nothing to look for."""
    found = re.findall(r'"[^"]+"|[A-Za-z0-9][A-Za-z0-9.+-]*', query)
    return [p for p in map(TOKENIZERS[tokenizer][1], found) if p] or None


# ---------------------------------------------------------------- scores


def token_index(rows: DataFrame, key: str, *texts: str, tokenizer: str = "plain") -> DataFrame:
    """key, tokens and n of each row; the lengths of several texts add up. Write it once and search it often."""
    make = TOKENIZERS[tokenizer][0]
    parts = [make(F.col(t)) for t in texts]
    tokens = F.concat(*parts) if len(parts) > 1 else parts[0]
    return once(rows.select(key, *texts), "tokens", tokens).select(key, "tokens").withColumn("n", F.size("tokens"))


def _count(phrase: list[str]) -> Column:
    if len(phrase) == 1:
        return F.size(F.filter("tokens", lambda t: t == phrase[0]))
    whole = F.array(*[F.lit(w) for w in phrase])
    starts = F.when(F.col("n") >= len(phrase), F.sequence(F.lit(1), F.col("n") - len(phrase) + 1)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(starts, lambda i: F.slice("tokens", i, F.lit(len(phrase))) == whole))


class Postings(Protocol):
    """An index that gives the occurrences of phrases without a scan of all rows."""

    def counts(self, phrases: list[list[str]]) -> tuple[DataFrame, DataFrame]: ...


def _scanned(index: DataFrame, key: str, phrases: list[list[str]]) -> tuple[DataFrame, DataFrame]:
    """How often each phrase occurs in every row of a token index, and how many rows there are of what mean length."""
    counted = index.select(key, F.col("n").cast("double").alias("n"), *[_count(p).alias(f"f{i}") for i, p in enumerate(phrases)])
    return counted, counted.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("mean"))


def bm25(index: DataFrame | Postings, key: str, phrases: list[list[str]], k: int | None, scope: DataFrame | None = None, every: bool = False) -> DataFrame:
    """key, score and rank of the k best rows (all with k None); ties go to the smaller key.

    The index is a token index, which is scanned, or an inverted one, of which the phrases' buckets are read.
    N, document frequencies and the mean length are of the whole index: a scope (rows with `key`) narrows what is
    scored, never the statistics. A phrase in half of all rows or more still matches, at next to nothing. One that
    is asked twice counts twice. `every` keeps rows that hold all phrases.
    """
    distinct = [list(p) for p in dict.fromkeys(map(tuple, phrases))]
    times = [phrases.count(p) for p in distinct]
    f = [f"f{i}" for i in range(len(distinct))]
    counted, stats = _scanned(index, key, distinct) if isinstance(index, DataFrame) else index.counts(distinct)
    if not phrases:
        return counted.select(key, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    stats = F.broadcast(stats).join(F.broadcast(counted.agg(*[F.count_if(F.col(c) > 0).alias(f"d{c}") for c in f])))  # one row each
    hit = [F.col(c) > 0 for c in f]
    test = hit[0]
    for h in hit[1:]:
        test = test & h if every else test | h
    rows = counted.filter(test)
    if scope is not None:
        rows = rows.join(scope.select(key).distinct(), key, "left_semi")
    total = F.lit(0.0)
    for c, t in zip(f, times, strict=True):
        idf = F.greatest(F.log((F.col("n_docs") - F.col(f"d{c}") + 0.5) / (F.col(f"d{c}") + 0.5)), F.lit(LEAST_IDF))
        total = total + t * idf * F.col(c) * (K1 + 1) / (F.col(c) + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    scored = rows.join(F.broadcast(stats)).select(key, F.round(total, 6).alias("score"))  # the statistics are one row
    if k is None:
        return scored
    return ranked(scored.orderBy(F.desc("score"), key).limit(k), [F.desc("score"), F.asc(key)])


def ranked(top: DataFrame, order: list[Column]) -> DataFrame:
    """Ranks from 1 of a short list."""
    from pyspark.sql import Window

    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
