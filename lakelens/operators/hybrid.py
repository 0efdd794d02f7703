"""Hybrid retrieval: filters that reach both legs, exact cosine neighbours, rank fusion, hydration, reranking."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakelens.operators import lexical as L
from lakelens.operators.ann import Ann


@dataclass(frozen=True)
class Filters:
    """What documents may answer: a range of days, facet values, a scope of ids (None: all, empty: nothing)."""

    day_min: int | None = None
    day_max: int | None = None
    facets: tuple[tuple[str, str], ...] = ()
    doc_ids: tuple | None = None

    @classmethod
    def of_papers(cls, category: str | None = None, year_min: int | None = None, year_max: int | None = None, scope: Sequence | None = None) -> Filters:
        """Years become the first and the last day of a year, a category becomes a facet."""
        return cls(
            None if year_min is None else year_min * 10000 + 101,
            None if year_max is None else year_max * 10000 + 1231,
            () if category is None else (("category", category),),
            None if scope is None else tuple(scope),
        )

    def documents(self, documents: DataFrame, facets: DataFrame) -> DataFrame | None:
        """The doc_ids that pass, None when everything does. documents: doc_id, day; facets: doc_id, key, value."""
        if self == Filters():
            return None
        out = documents.select("doc_id", "day")
        if self.doc_ids is not None:
            if not self.doc_ids:
                return out.limit(0).select("doc_id")
            ids = documents.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(self.doc_ids)], f"doc_id {dict(documents.dtypes)['doc_id']}")
            out = out.join(ids, "doc_id", "left_semi")  # a join, whatever the length of the scope
        if self.day_min is not None:
            out = out.filter(F.col("day") >= self.day_min)
        if self.day_max is not None:
            out = out.filter(F.col("day") <= self.day_max)
        for key, value in self.facets:
            out = out.join(facets.filter((F.col("key") == key) & (F.col("value") == value)).select("doc_id"), "doc_id", "left_semi")
        return out.select("doc_id")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda x, y: x + y)


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays. The norm goes in as an element, so that it is worked out once."""
    pair = F.array(F.struct(F.sqrt(dot(v, v)).alias("n"), v.alias("v")))
    return F.flatten(F.transform(pair, lambda p: F.transform(p["v"], lambda x: F.when(p["n"] > 0, x.cast("double") / p["n"]).otherwise(F.lit(0.0)))))


def knn(vectors: DataFrame, key: str, query: Sequence[float], k: int, scope: DataFrame | None = None) -> DataFrame:
    """key, score and rank of the k rows of largest cosine, exactly; ties go to the smaller key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col("embedding")
    rows = vectors if scope is None else vectors.join(scope.select(key).distinct(), key, "left_semi")
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    score = F.round(dot(v, q) / F.sqrt(dot(v, v)) / F.lit(norm), 6)
    return L.ranked(rows.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k), [F.desc("score"), F.asc(key)])


def fuse(legs: dict[str, DataFrame], key: str, k: int | None = None, rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: key, score, leg ('both' if several found it) and rank.

    Equal scores keep the order of the legs as they are given: rank in the first, then in the second. Legs are top-k lists.
    """
    names = list(legs)
    rows = None
    for name, leg in legs.items():
        part = leg.select(key, F.lit(name).alias("leg"), "rank")
        rows = part if rows is None else rows.unionByName(part)
    places = [F.min(F.when(F.col("leg") == n, F.col("rank"))).alias(f"in_{n}") for n in names]
    found = F.when(F.count_distinct("leg") > 1, "both").otherwise(F.min("leg"))
    out = rows.groupBy(key).agg(F.round(F.sum(F.lit(1.0) / (rrf_k + F.col("rank"))), 12).alias("score"), found.alias("leg"), *places)
    order = [F.desc("score"), *[F.asc_nulls_last(f"in_{n}") for n in names]]
    if k is not None:
        out = out.orderBy(*order).limit(k)
    return L.ranked(out, order).select(key, "score", "leg", "rank")


def hydrate(top: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The ranked chunks with their text, place and their document's version; a short list on one side of each join."""
    top = F.broadcast(top)
    return chunks.join(top, "chunk_id").join(documents.select("doc_id", "title", "version"), "doc_id")


class RerankUnavailable(Exception):
    """The reranker is out of reach; the fused order stands."""


#: A query and a text column to a score column.
Scorer = Callable[[str, Column], Column]


def overlap_scorer(query: str, text: Column) -> Column:
    """The share of the query's distinct words that a text has: what is at hand without a model."""
    asked = F.array_distinct(F.array(*[F.lit(w) for p in L.any_phrases(query) for w in p]))
    return F.round(F.size(F.array_intersect(asked, L.plain_tokens(text))) / F.size(asked), 6)


def rerank(candidates: DataFrame, query: str, k: int, scorer: Scorer = overlap_scorer) -> DataFrame:
    """The k best of ranked candidates by the scorer; ties keep their order."""
    out = candidates.withColumn("rerank_score", scorer(query, F.col("text"))).withColumnRenamed("rank", "fused_rank")
    order = [F.desc("rerank_score"), F.asc("fused_rank")]
    return L.ranked(out.orderBy(*order).limit(k), order)


@dataclass
class HybridIndex:
    """What a search needs: chunks (chunk_id, doc_id, section, pos_start, pos_end, text), documents (doc_id, title, day, version),
    facets (doc_id, key, value), a token index or an inverted one by chunk_id, vectors (chunk_id, embedding) or an index of approximate neighbours of them, and an embedder of queries."""

    chunks: DataFrame
    documents: DataFrame
    facets: DataFrame
    tokens: DataFrame | L.Postings
    vectors: DataFrame | Ann
    embed: Callable[[str], Sequence[float]]
    tokenizer: str = "plain"
    unavailable: tuple[type[Exception], ...] = field(default=(OSError, TimeoutError))


def search(index: HybridIndex, query: str, k: int = 10, filters: Filters = Filters(), scorer: Scorer | None = None, pool: int = 50) -> DataFrame | None:
    """The k best chunks of both legs, fused, hydrated and, with a scorer, reranked; None for a blank query or an empty scope.

    An embedder that cannot be reached leaves the lexical leg alone to answer; any other failure is raised.
    """
    if not query.strip() or filters.doc_ids == ():
        return None
    scope = filters.documents(index.documents, index.facets)
    scope = None if scope is None else index.chunks.join(scope, "doc_id", "left_semi").select("chunk_id")
    depth = max(pool, k) if scorer else k
    legs = {}
    try:
        asked = index.embed(query)
        legs["vector"] = index.vectors.nearest(asked, depth, scope) if isinstance(index.vectors, Ann) else knn(index.vectors, "chunk_id", asked, depth, scope)
    except index.unavailable:
        pass
    legs["bm25"] = L.bm25(index.tokens, "chunk_id", L.any_phrases(query, index.tokenizer), depth, scope)
    rows = hydrate(fuse(legs, "chunk_id", depth), index.chunks, index.documents)
    if scorer:
        try:
            return rerank(rows, query, k, scorer)
        except RerankUnavailable:
            pass
    return rows.filter(F.col("rank") <= k)


def batches(texts: Sequence[str], send: Callable[[Sequence[str]], list], too_large: type[Exception]) -> list:
    """Sends a batch; one that is too large goes in halves, down to single texts, whose refusal is raised."""
    try:
        return send(texts)
    except too_large:
        if len(texts) <= 1:
            raise
        half = len(texts) // 2
        return [*batches(texts[:half], send, too_large), *batches(texts[half:], send, too_large)]


class TokenBucket:
    """Paces calls to a rate: what is asked for is reserved ahead, unused time is not saved up."""

    def __init__(self, per_minute: float, clock: Callable[[], float]) -> None:
        self.rate, self.clock, self.free_at = per_minute / 60.0, clock, 0.0

    def reserve(self, tokens: float) -> float:
        """Seconds to wait before sending."""
        now = self.clock()
        start = max(now, self.free_at)
        self.free_at = start + tokens / self.rate
        return start - now
