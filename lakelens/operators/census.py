"""What is held a month beside what the catalog lists: coverage, cohort, completeness, categories, uptake, landing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakelens.functions.scalars import next_month


def month_coverage(papers: DataFrame, citations: DataFrame, listed: DataFrame) -> DataFrame:
    """month, papers_held, papers_parsed, refs_made, catalog_papers; a census below what is held counts as unknown.

    References are counted a paper first, so the joins multiply nothing.
    """
    refs = citations.groupBy(F.col("citing_id").alias("paper_id")).agg(F.count(F.lit(1)).alias("refs"))
    held = papers.join(refs, "paper_id", "left").groupBy("month").agg(F.count(F.lit(1)).alias("papers_held"), F.count_if("has_text").alias("papers_parsed"), F.coalesce(F.sum("refs"), F.lit(0)).alias("refs_made"))
    known = F.when(F.col("cs_papers") >= F.col("papers_held"), F.col("cs_papers"))
    return held.join(listed, "month", "left").select("month", "papers_held", "papers_parsed", "refs_made", known.alias("catalog_papers"))


def cohort_months(papers: DataFrame, citations: DataFrame, share: float = 0.01) -> DataFrame:
    """Months that gave at least `share` of the papers with references."""
    citing = papers.join(citations.select(F.col("citing_id").alias("paper_id")), "paper_id", "left_semi")
    months = citing.groupBy("month").agg(F.count(F.lit(1)).alias("n"))  # few rows
    return months.withColumn("total", F.sum("n").over(Window.partitionBy())).filter(F.col("n") >= share * F.col("total")).select("month")


def complete_months(coverage: DataFrame, least: float = 0.9) -> DataFrame:
    """Months held by `least` or more; one without a known census never qualifies."""
    return coverage.filter(F.col("papers_held").cast("double") / F.col("catalog_papers") >= least)


def excluded_months(coverage: DataFrame, cohort: DataFrame, least: float = 0.9) -> DataFrame:
    """Months of the cohort that are not complete."""
    months = coverage.join(F.broadcast(cohort), "month", "left_semi")
    return months.join(F.broadcast(complete_months(coverage, least).select("month")), "month", "left_anti").select("month", "papers_held", "catalog_papers")


def consecutive(months: DataFrame) -> DataFrame:
    """(from_month, to_month): neighbours in the list that are neighbours in the calendar."""
    pairs = months.select(F.col("month").alias("from_month"), F.lead("month").over(Window.orderBy("month")).alias("to_month"))  # a row a month
    return pairs.filter(F.col("to_month") == next_month(F.col("from_month")))


def category_census(papers: DataFrame, coverage: DataFrame, top: int = 8, least: float = 0.9) -> DataFrame:
    """month, category, n: the `top` largest categories of all complete months, zero-filled, and 'other' for the rest."""
    complete = complete_months(coverage, least).select("month", "papers_held")
    counts = papers.join(F.broadcast(complete.select("month")), "month", "left_semi").groupBy("month", "category").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.filter("category is not null").groupBy("category").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "category").limit(top).select("category")
    grid = complete.select("month").join(F.broadcast(ranked))  # months x top: few rows
    listed = grid.join(counts, ["month", "category"], "left").select("month", "category", F.coalesce("n", F.lit(0)).alias("n"))
    other = complete.join(listed.groupBy("month").agg(F.sum("n").alias("listed")), "month").select("month", F.lit("other").alias("category"), (F.col("papers_held") - F.col("listed")).alias("n"))
    return listed.unionByName(other)


def uptake(citations: DataFrame, months: DataFrame, pair: DataFrame, n: int = 8) -> DataFrame:
    """Works of the first month of a pair that papers of the second cite, with all their citations.

    months: (paper_id, month) of citing and cited papers alike; pair: one row, from_month and to_month.
    """
    pair = F.broadcast(pair)
    cited = months.join(pair, F.col("month") == F.col("from_month")).select(F.col("paper_id").alias("cited_id"), "from_month", "to_month")
    edges = citations.join(cited, "cited_id").join(months.select(F.col("paper_id").alias("citing_id"), F.col("month").alias("citing_month")), "citing_id", "left")
    counts = edges.groupBy("cited_id", "from_month", "to_month").agg(F.count(F.lit(1)).alias("cited_by"), F.count_if(F.col("citing_month") == F.col("to_month")).alias("citations_from"))
    return counts.filter("citations_from > 0").orderBy(F.desc("citations_from"), "cited_id").limit(n)


def uptake_totals(citations: DataFrame, months: DataFrame, pair: DataFrame) -> DataFrame:
    """works_total and edges_total from the second month of a pair to works of the first."""
    pair = F.broadcast(pair)
    cited = months.join(pair, F.col("month") == F.col("from_month")).select(F.col("paper_id").alias("cited_id"))
    citing = months.join(pair, F.col("month") == F.col("to_month")).select(F.col("paper_id").alias("citing_id"))
    edges = citations.join(cited, "cited_id", "left_semi").join(citing, "citing_id", "left_semi")
    return edges.groupBy("cited_id").agg(F.count(F.lit(1)).alias("k")).agg(F.count(F.lit(1)).alias("works_total"), F.coalesce(F.sum("k"), F.lit(0)).alias("edges_total"))


def cohort_stats(papers: DataFrame, citations: DataFrame, chunks: DataFrame, listed: DataFrame, share: float = 0.01) -> DataFrame:
    """One row: the cohort's months, papers and census, and honest totals of the corpus."""
    cohort = cohort_months(papers, citations, share)
    months = cohort.agg(F.min("month").alias("cohort_start"), F.max("month").alias("cohort_end"))
    held = papers.join(F.broadcast(cohort), "month", "left_semi").agg(F.count(F.lit(1)).alias("cohort_papers"))
    census = listed.join(F.broadcast(cohort), "month", "left_semi").agg(F.sum("cs_papers").alias("census"))
    parsed = papers.agg(F.count_if("has_text").alias("papers_parsed"))
    refs = citations.groupBy("citing_id").agg(F.count(F.lit(1)).alias("k")).agg(F.count(F.lit(1)).alias("papers_with_references"), F.coalesce(F.sum("k"), F.lit(0)).alias("citations"))
    works = citations.select("cited_id").distinct().agg(F.count(F.lit(1)).alias("cited_works"))
    readable = papers.join(chunks.select("paper_id"), "paper_id", "left_semi").agg(F.count(F.lit(1)).alias("readable_papers"))
    out = months
    for part in (held, census, parsed, refs, works, readable):  # single rows
        out = out.join(F.broadcast(part))
    return out.withColumn("cohort_catalog_papers", F.when(F.col("census") >= F.col("cohort_papers"), F.col("census"))).drop("census")


def foundation(citations: DataFrame, works: DataFrame, work: int) -> DataFrame:
    """One cited work with its citations; no row if it is unknown or not cited."""
    n = citations.filter(F.col("cited_id") == work).groupBy("cited_id").agg(F.count(F.lit(1)).alias("cited_by"))
    return works.filter(F.col("work_id") == work).join(n, F.col("work_id") == F.col("cited_id")).drop("cited_id")


def indexed_citers(citations: DataFrame, papers: DataFrame, chunks: DataFrame, work: int, n: int) -> DataFrame:
    """The newest citing papers that have chunks."""
    citers = citations.filter(F.col("cited_id") == work).select(F.col("citing_id").alias("paper_id"))
    return papers.join(citers, "paper_id", "left_semi").join(chunks.select("paper_id"), "paper_id", "left_semi").orderBy(F.desc("pid")).limit(n)
