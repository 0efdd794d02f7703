"""The tools an assistant is given: closed argument lists, dispatch by name, a scope it cannot widen."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.operators import hybrid
from lakelens.operators.catalog import Where
from lakelens.operators.guard import read_pages

MOST = 25


class BadCall(ValueError):
    """A call with an unknown name, operation or argument."""


@dataclass(frozen=True)
class Corpus:
    """flagged: papers with `indexed`; chunks: their chunks; index: what hybrid search reads."""

    flagged: DataFrame
    chunks: DataFrame
    index: hybrid.HybridIndex


_OPS = {"count_papers": {"category", "year_min", "year_max", "licensed"}, "paper_facets": {"paper_id"}, "corpus_stats": set()}


def query_metadata(corpus: Corpus, op: str, **args: object) -> DataFrame:
    """Counts, one paper's facets or the corpus's statistics, over papers with chunks; arguments of other operations are refused."""
    if op not in _OPS:
        raise BadCall(f"op must be one of {sorted(_OPS)}")
    if extra := set(args) - _OPS[op]:
        raise BadCall(f"{op} takes no {sorted(extra)}")
    papers = corpus.flagged.filter("indexed")
    if op == "count_papers":
        return papers.filter(Where(**args).column()).agg(F.count(F.lit(1)).alias("n"))
    if op == "paper_facets":
        chunks = corpus.chunks.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("page_end").alias("last_page"))
        return papers.filter(F.col("paper_id") == args.get("paper_id")).join(chunks, "paper_id")
    n = corpus.chunks.agg(F.count(F.lit(1)).alias("chunks"))
    stats = papers.agg(F.count(F.lit(1)).alias("papers"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_distinct("category").alias("categories"))
    return stats.join(F.broadcast(n))  # single rows


def search_corpus(corpus: Corpus, query: str, k: int = 10, category: str | None = None, year_min: int | None = None, year_max: int | None = None, *, scope: tuple | None = None) -> DataFrame | None:
    """Ranked chunks; the scope is the caller's, never an argument of the tool."""
    if not 1 <= k <= MOST:
        raise BadCall(f"k must be between 1 and {MOST}")
    return hybrid.search(corpus.index, query, k, hybrid.Filters.of_papers(category, year_min, year_max, scope))


def read_paper(corpus: Corpus, paper_id: object, first: int | None = None, last: int | None = None, *, scope: tuple | None = None, budget: int = 16_000) -> DataFrame:
    if scope is not None and paper_id not in scope:
        raise BadCall("this paper is out of scope")
    return read_pages(corpus.chunks.filter(F.col("paper_id") == paper_id), first, last, budget)


@dataclass(frozen=True)
class Tool:
    run: Callable
    arguments: frozenset[str]
    scoped: bool = False


@dataclass
class Registry:
    """Tools by name; only those that are scoped are told the scope."""

    corpus: Corpus
    tools: dict[str, Tool] = field(
        default_factory=lambda: {
            "query_metadata": Tool(query_metadata, frozenset({"op", "paper_id", "category", "year_min", "year_max", "licensed"})),
            "search_corpus": Tool(search_corpus, frozenset({"query", "k", "category", "year_min", "year_max"}), True),
            "read_paper": Tool(read_paper, frozenset({"paper_id", "first", "last"}), True),
        }
    )

    def call(self, name: str, args: dict, scope: tuple | None = None) -> DataFrame | None:
        tool = self.tools.get(name)
        if tool is None:
            raise BadCall(f"no tool named {name!r}")
        if extra := set(args) - tool.arguments:
            raise BadCall(f"{name} takes no {sorted(extra)}")
        return tool.run(self.corpus, **args, **({"scope": scope} if tool.scoped else {}))
