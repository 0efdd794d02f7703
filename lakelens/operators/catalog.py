"""The catalog of papers: one filter for pages, totals and facets, late materialisation, four orders."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakelens.operators.relational import all_of

HOLDINGS = ("all", "text", "indexed")
SORTS = ("newest", "oldest", "cited")
_MONTH = re.compile(r"[0-9]{4}\Z")


def valid_month(month: str | None) -> str | None:
    """An id-month is four digits; anything else is refused."""
    if month is not None and not _MONTH.match(month):
        raise ValueError("month must be a 4-digit id-month, e.g. 2608")
    return month


def with_flags(papers: DataFrame, chunks: DataFrame, citations: DataFrame) -> DataFrame:
    """Every paper with `indexed` (it has chunks) and `cited_by`; both sides are combined before the joins."""
    indexed = chunks.select("paper_id").distinct().withColumn("indexed", F.lit(True))
    cited = citations.groupBy(F.col("cited_id").alias("paper_id")).agg(F.count(F.lit(1)).alias("cited_by"))
    out = papers.join(indexed, "paper_id", "left").join(cited, "paper_id", "left")
    return out.withColumn("indexed", F.coalesce("indexed", F.lit(False))).withColumn("cited_by", F.coalesce("cited_by", F.lit(0)))


@dataclass(frozen=True)
class Where:
    """Optional conjuncts; None leaves a dimension open. `licensed` asks whether a license is stated at all."""

    category: str | None = None
    month: str | None = None
    holding: str = "all"
    year_min: int | None = None
    year_max: int | None = None
    licensed: bool | None = None

    def __post_init__(self) -> None:
        valid_month(self.month)
        if self.holding not in HOLDINGS:
            raise ValueError(f"holding must be one of {HOLDINGS}")

    def column(self) -> Column:
        given = lambda value, condition: None if value is None else condition
        return all_of(
            given(self.category, F.col("category") == self.category),
            given(self.month, F.col("month") == self.month),
            {"all": None, "text": F.col("has_text"), "indexed": F.col("indexed")}[self.holding],
            given(self.year_min, F.col("year") >= F.lit(self.year_min)),
            given(self.year_max, F.col("year") <= F.lit(self.year_max)),
            given(self.licensed, F.col("license").isNotNull() if self.licensed else F.col("license").isNull()),
        )

    def without(self, *dimensions: str) -> Where:
        blank = {"holding": "all"}
        return replace(self, **{d: blank.get(d) for d in dimensions})


def page(flagged: DataFrame, where: Where, sort: str, limit: int, offset: int) -> DataFrame:
    """The wide rows of one page: keys are sorted alone, then only the page's rows are fetched."""
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {SORTS}")
    order = {"newest": [F.desc("published"), F.desc("pid")], "oldest": [F.asc("published"), F.asc("pid")], "cited": [F.desc("cited_by"), F.asc("pid")]}[sort]
    keys = flagged.filter(where.column()).select("paper_id", "pid", "published", "cited_by").orderBy(*order).offset(offset).limit(limit)
    return flagged.join(F.broadcast(keys.select("paper_id")), "paper_id", "left_semi")  # at most `limit` keys


def next_offset(offset: int, shown: int, total: int) -> int | None:
    return offset + shown if offset + shown < total else None


def facets(flagged: DataFrame, where: Where) -> DataFrame:
    """(facet, value, n): what each value of a dimension would give under all filters but its own, and the total.

    One scan and one aggregation: a row counts for each facet whose other filters it passes.
    """
    cell = lambda facet, value: F.struct(F.lit(facet).alias("facet"), value.cast("string").alias("value"))
    passes = lambda w, c: F.when(w.column(), c)
    cells = [
        passes(where.without("category"), cell("category", F.col("category"))),
        passes(where.without("month"), cell("month", F.col("month"))),
        *[passes(replace(where, holding=h), cell("holding", F.lit(h))) for h in HOLDINGS],
        passes(where, cell("total", F.lit(None))),
    ]
    return flagged.select(F.explode(F.array_compact(F.array(*cells))).alias("e")).groupBy("e.facet", "e.value").agg(F.count(F.lit(1)).alias("n"))
