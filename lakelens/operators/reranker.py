"""A learned reranker: trees boosted by pairwise gradients over features of a question and a text.

Features are built-in expressions over both token lists, so they are worked out where the candidates
are. Trees are fitted on graded candidates of golden questions, at most about `most` rows of whole
questions, which is all that reaches the driver: for every pair of a question's candidates of unequal
grade the gradient pushes the better one up, by what their exchange would change in the discounted
gain. Which questions are held out is told by `held`, so that gains are measured on questions that
were not learnt from.

A question without words has no overlap with anything; a null text has no words. Equal scores keep
the order that the candidates came in. Without a pair of unequal grades all scores are zero.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakelens.operators import lexical as L
from lakelens.operators.relational import once

FEATURES = ("overlap", "pairs", "length", "first", "density", "longest", "place")
BINS, DEPTH = 32, 3


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0).cast("double")


def _pairs(tokens: Column) -> Column:
    following = F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1)))
    return F.filter(F.zip_with(tokens, following, lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull())


def vector(asked: Column, tokens: Column, place: Column) -> Column:
    """The features of a question's and a text's tokens and of the candidate's place."""
    words = F.array_distinct(asked)
    shared = F.array_intersect(words, tokens)
    wanted = F.array_distinct(_pairs(asked))
    first = F.array_min(F.transform(shared, lambda w: F.array_position(tokens, w)))
    values = {
        "overlap": _share(F.size(shared), F.size(words)),
        "pairs": _share(F.size(F.array_intersect(wanted, _pairs(tokens))), F.size(wanted)),
        "length": F.log1p(F.size(tokens).cast("double")),
        "first": F.coalesce(_share(first, F.size(tokens)), F.lit(2.0)),
        "density": _share(F.size(F.filter(tokens, lambda t: F.array_contains(words, t))), F.size(tokens)),
        "longest": F.coalesce(F.array_max(F.transform(shared, lambda w: F.length(w))), F.lit(0)).cast("double"),
        "place": (1.0 / (60 + place)).cast("double"),
    }
    return F.array(*[values[n] for n in FEATURES])


def features(candidates: DataFrame, tokenizer: str = "plain") -> DataFrame:
    """Candidates (question, text, rank) with x, their features."""
    make = L.TOKENIZERS[tokenizer][0]
    rows = once(once(candidates, "_asked", make(F.col("question"))), "_tokens", make(F.col("text")))
    return rows.withColumn("x", vector(F.col("_asked"), F.col("_tokens"), F.col("rank"))).drop("_asked", "_tokens")


def gradients(score: np.ndarray, grade: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairwise gradients and their curvature of one question's candidates."""
    order = np.lexsort((rank, -score))
    place = np.empty(len(score))
    place[order] = np.arange(len(score))
    gain, discount = 2.0**grade - 1, 1 / np.log2(place + 2)
    ideal = (np.sort(gain)[::-1] / np.log2(np.arange(len(gain)) + 2)).sum()
    better = grade[:, None] > grade[None]
    change = np.abs((gain[:, None] - gain[None]) * (discount[:, None] - discount[None])) / max(ideal, 1e-12)
    odds = 1 / (1 + np.exp(np.clip(score[:, None] - score[None], -50, 50)))
    push = np.where(better, change * odds, 0)
    bend = np.where(better, change * odds * (1 - odds), 0)
    return push.sum(1) - push.sum(0), bend.sum(1) + bend.sum(0)


def ndcg(score: np.ndarray, grade: np.ndarray, rank: np.ndarray, k: int = 10) -> float:
    order = np.lexsort((rank, -score))
    weight = 1 / np.log2(np.arange(len(grade)) + 2) * (np.arange(len(grade)) < k)
    ideal = ((2.0 ** np.sort(grade)[::-1] - 1) * weight).sum()
    return float(((2.0 ** grade[order] - 1) * weight).sum() / ideal) if ideal else 0.0


@dataclass
class Ranker:
    """Trees as arrays: at level l, node n of a tree asks whether feature `at` is above `cut`; leaves are in the order of their answers."""

    at: np.ndarray = field(default_factory=lambda: np.zeros((0, 2**DEPTH - 1), np.int64))
    cut: np.ndarray = field(default_factory=lambda: np.zeros((0, 2**DEPTH - 1)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 2**DEPTH)))

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for at, cut, leaf in zip(self.at, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(x)), at[node]] > cut[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out

    def column(self, x: Column) -> Column:
        """The score of a column of features."""
        own = self

        @F.pandas_udf("double")
        def scored(v: pd.Series) -> pd.Series:
            return pd.Series(own.score(np.array(v.tolist(), float).reshape(len(v), len(FEATURES))))

        return scored(x)

    def scorer(self, tokenizer: str = "plain") -> Callable[[str, Column], Column]:
        """For hybrid.rerank: a query and a text to a score; the candidate's rank is a feature too."""
        make, plain = L.TOKENIZERS[tokenizer]

        def score(query: str, text: Column) -> Column:
            asked = F.array(*[F.lit(w) for w in plain(query)]) if plain(query) else F.array().cast("array<string>")
            return self.column(vector(asked, make(text), F.col("rank")))

        return score


def _tree(bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, slow: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree by histograms of gradients, level by level; a node that gains nothing sends all to the left."""
    at, cut, node = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf), np.zeros(len(g), np.int64)
    for level in range(DEPTH):
        first = 2**level - 1
        here = node - first
        best = np.zeros(2**level)
        side = np.zeros(len(g), bool)
        for f in range(bins.shape[1]):
            flat = here * BINS + bins[:, f]
            sums = [np.bincount(flat, weights=w, minlength=2**level * BINS).reshape(-1, BINS).cumsum(1) for w in (g, h, np.ones(len(g)))]
            left_g, left_h, left_n = (s[:, :-1] for s in sums)
            all_g, all_h, all_n = (s[:, -1:] for s in sums)
            gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
            gain[(left_n < least) | (all_n - left_n < least) | (np.arange(BINS - 1)[None] >= len(edges[f]))] = 0
            top = gain.argmax(1)
            value = gain[np.arange(len(top)), top]
            for n in np.flatnonzero(value > best + 1e-12):
                best[n], at[first + n], cut[first + n] = value[n], f, edges[f][top[n]]
                mine = here == n
                side[mine] = bins[mine, f] > top[n]
        node = 2 * node + 1 + side
    leaf = node - (2**DEPTH - 1)
    total, bend = (np.bincount(leaf, weights=w, minlength=2**DEPTH) for w in (g, h))
    return at, cut, slow * total / (bend + 1)


def fit(question: np.ndarray, x: np.ndarray, grade: np.ndarray, rank: np.ndarray, trees: int = 60, slow: float = 0.3, least: int = 5) -> Ranker:
    """Trees over rows sorted by question."""
    if not len(x):
        return Ranker()
    starts = np.flatnonzero(np.diff(question, prepend=question[0] - 1))
    ends = np.append(starts[1:], len(question))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] for f, e in enumerate(edges)]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    made, score = [], np.zeros(len(x))
    for _ in range(trees):
        g, h = np.zeros(len(x)), np.zeros(len(x))
        for a, b in zip(starts, ends, strict=True):
            g[a:b], h[a:b] = gradients(score[a:b], grade[a:b], rank[a:b])
        made.append(_tree(bins, edges, g, h, slow, least))
        score += Ranker(*(np.array([v]) for v in made[-1])).score(x)
    return Ranker(*(np.array(v) for v in zip(*made, strict=True)))


def held(question: Column, one_in: int = 5) -> Column:
    return F.pmod(F.xxhash64(question), F.lit(one_in)) == 0


def learn(candidates: DataFrame, most: int = 200_000, trees: int = 60) -> Ranker:
    """A ranker from graded candidates (question, text, rank, grade) of questions that are not held out."""
    rows = candidates.filter(~held(F.col("question")))
    n = rows.count()
    share = min(1.0, most / max(n, 1))
    few = rows.filter(F.pmod(F.xxhash64("question", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)))  # whole questions
    got = features(few).select(F.xxhash64("question").alias("q"), "x", "grade", "rank").orderBy("q", "rank").toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(len(got), len(FEATURES))
    return fit(got["q"].to_numpy(), x, got["grade"].to_numpy().astype(float), got["rank"].to_numpy(), trees)


def measured(ranker: Ranker, candidates: DataFrame, k: int = 10) -> DataFrame:
    """question, and nDCG at k of the order that the candidates came in and of the ranker's, for held-out questions."""

    def one(t: pd.DataFrame) -> pd.DataFrame:
        grade, rank = t["grade"].to_numpy(float), t["rank"].to_numpy(float)
        score = ranker.score(np.array(t["x"].tolist(), float).reshape(len(t), len(FEATURES)))
        return pd.DataFrame({"question": [t["question"].iloc[0]], "before": [ndcg(-rank, grade, rank, k)], "after": [ndcg(score, grade, rank, k)]})

    rows = features(candidates.filter(held(F.col("question")))).select("question", "x", "grade", "rank")
    return rows.groupBy("question").applyInPandas(one, "question string, before double, after double")
