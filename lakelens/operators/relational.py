"""Operators of the catalog and the citation graph over any DataFrames with the named columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """The table with a column that is worked out once a row, however often what follows uses it.

    A plain column would be put in place of its name wherever it is used, inside loops over arrays too.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def indexed_only(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Papers with at least one chunk: a semi-join, which never multiplies rows."""
    return papers.join(chunks.select("paper_id"), "paper_id", "left_semi")


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of the conditions that are given; true without any."""
    given = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, given) if given else F.lit(True)


def in_scope(df: DataFrame, column: str, ids: list | None) -> DataFrame:
    """None leaves the table unscoped, an empty scope holds nothing."""
    if ids is None:
        return df
    return df.filter(F.col(column).isin(ids)) if ids else df.filter(F.lit(False))


def foundations(citations: DataFrame, works: DataFrame, n: int) -> DataFrame:
    """The works cited most: counted before the join, so that only counts meet the works."""
    counts = citations.groupBy("cited_id").agg(F.count(F.lit(1)).alias("cited_by"))
    return counts.join(works, F.col("cited_id") == F.col("work_id")).select("work_id", "title", "category", "year", "cited_by").orderBy(F.desc("cited_by"), "work_id").limit(n)


def co_cited(citations: DataFrame, work: int, n: int) -> DataFrame:
    """Works cited together with one work: the anchor's papers first, then their other works."""
    anchor = citations.filter(F.col("cited_id") == work).select("citing_id")
    return citations.filter(F.col("cited_id") != work).join(anchor, "citing_id", "left_semi").groupBy("cited_id").agg(F.count(F.lit(1)).alias("together")).orderBy(F.desc("together"), "cited_id").limit(n)


def histogram(df: DataFrame, by: str, n: int) -> DataFrame:
    """The n + 1 largest groups, so that a caller sees whether there are more."""
    return df.groupBy(F.col(by).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col("value").asc_nulls_first()).limit(n + 1)


def newest_citers(citations: DataFrame, works: int, each: int) -> DataFrame:
    """The newest distinct citers of the works cited most."""
    top = citations.groupBy("cited_id").agg(F.count(F.lit(1)).alias("cited_by")).orderBy(F.desc("cited_by"), "cited_id").limit(works)
    turn = F.row_number().over(Window.partitionBy("cited_id").orderBy(F.desc("citing_id")))
    return citations.join(F.broadcast(top), "cited_id").withColumn("turn", turn).filter(F.col("turn") <= each).select("cited_id", "cited_by", "citing_id", "turn")


def rank_norm(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Ranks in 0..1 within groups, ties share their mean rank, a single row has 0.5.

    Rows are counted by value first and only the counts are ordered, so a large group of few values never comes together.
    """
    counts = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_ties"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_ties").over(group.orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).withColumn("_n", F.sum("_ties").over(group))
    norm = F.when(F.col("_n") == 1, F.lit(0.5)).otherwise((2 * F.col("_before") + F.col("_ties") - 1) / 2 / (F.col("_n") - 1))
    named = counts.select(*[F.col(c).alias(f"_{c}") for c in (*by, column)], norm.alias("norm"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*by, column)])
    return df.join(named, same).drop(*[f"_{c}" for c in (*by, column)])


def within_budget(df: DataFrame, by: list[str], order: list, size: str, budget: int) -> DataFrame:
    """Rows while their running sum stays within the budget; the first row always."""
    w = Window.partitionBy(*by).orderBy(*order)
    running = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("running", running).withColumn("turn", F.row_number().over(w)).filter((F.col("turn") == 1) | (F.col("running") <= budget)).drop("turn")


def scope(citations: DataFrame, chunks: DataFrame, work: int) -> DataFrame:
    """The papers with chunks that cite a work, and the work itself if it has chunks."""
    indexed = chunks.select("paper_id")
    citers = citations.filter(F.col("cited_id") == work).select(F.col("citing_id").alias("paper_id")).join(indexed, "paper_id", "left_semi")
    return citers.union(indexed.filter(F.col("paper_id") == work)).distinct()


def backfill(df: DataFrame, snapshot: DataFrame, key: str, replaced: list[str], filled: list[str]) -> DataFrame:
    """Columns of a snapshot: `replaced` where the snapshot has a value, `filled` only where the row has none."""
    other = snapshot.select(key, *[F.col(c).alias(f"_{c}") for c in (*replaced, *filled)])
    out = df.join(other, key, "left")
    for c in replaced:
        out = out.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c)))
    for c in filled:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_{c}")))
    return out.drop(*[f"_{c}" for c in (*replaced, *filled)])


def newest_of(citations: DataFrame, works: DataFrame, each: int) -> DataFrame:
    """The newest distinct citers of given works (column cited_id, few)."""
    turn = F.row_number().over(Window.partitionBy("cited_id").orderBy(F.desc("citing_id")))
    return citations.join(works, "cited_id").withColumn("turn", turn).filter(F.col("turn") <= each).drop("turn")


def quantiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, p50 (the median), p95 (the value of rank int(0.95 n)), worst and mean.

    Equal values are counted before anything is ordered, so a group that holds a third of all rows comes down to its
    distinct values; those are ordered a group at a time and read off the running sum.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumn("upto", F.sum("k").over(w))
    total = df.filter(F.col(value).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(F.broadcast(total), by)  # a row a group
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col(value)))
    low, high = at(F.expr("(n + 1) div 2")), at(F.expr("n div 2 + 1"))
    p95 = at(F.greatest(F.lit(1), F.floor(F.col("n") * 0.95)))
    return rows.groupBy(by).agg(((low + high) / 2).alias("p50"), p95.alias("p95"), F.max(value).alias("worst"), F.round(F.sum(F.col(value) * F.col("k")) / F.max("n"), 6).alias("mean"))
