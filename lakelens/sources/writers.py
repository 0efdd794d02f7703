"""Writers: staged tables, JSON lines, edges, shards, upserts, state and run logs; checks that go before them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def staged(df: DataFrame, path: str, form: str = "parquet", **options: str) -> None:
    """Written beside its place and moved there when complete; the old table is moved aside first, and back if that fails.

    A reader may meet a moment without a table; where that matters, `versions.Store` has none.
    """
    spark, stage = df.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    df.write.format(form).options(**options).save(stage)
    fs, target = _fs(spark, path)
    aside = _fs(spark, f"{stage}.old")[1]
    had = fs.exists(target) and fs.rename(target, aside)
    if not fs.rename(_fs(spark, stage)[1], target):
        if had:
            fs.rename(aside, target)
        raise OSError(f"could not move {stage} to {path}")
    if had:
        fs.delete(aside, True)


class Invalid(ValueError):
    """What a table must hold does not hold."""


def check(**broken: DataFrame) -> None:
    """Each frame holds what must not be; the first that is not empty raises, with an example."""
    for name, df in broken.items():
        rows = df.limit(1).collect()
        if rows:
            raise Invalid(f"{name.replace('_', ' ')}: {rows[0].asDict()}")


def repeated(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().filter("count > 1")


def index_violations(documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> dict[str, DataFrame]:
    """What a search index must not hold: repeated ids, chunks without a document, ids not of the form document#number, vectors and chunks apart."""
    shape = F.col("chunk_id").rlike(r"^.+#[0-9]+$") & (F.substring_index("chunk_id", "#", 1) == F.col("doc_id").cast("string"))
    return {
        "repeated_document": repeated(documents, "doc_id"),
        "repeated_chunk": repeated(chunks, "chunk_id"),
        "orphan_chunk": chunks.join(documents.select("doc_id"), "doc_id", "left_anti").select("chunk_id"),
        "malformed_chunk_id": chunks.filter(~shape).select("chunk_id"),
        "chunk_without_vector": chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id"),
        "vector_without_chunk": vectors.join(chunks.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id"),
    }


def corpus_violations(papers: DataFrame, citations: DataFrame, works: DataFrame, chunks: DataFrame, named: list[str], prefix: str = "cs.") -> dict[str, DataFrame]:
    """What a corpus must not hold: citations from unknown papers or to unknown works, chunks of unknown papers, codes without a name."""
    return {
        "unknown_citing_paper": citations.join(papers.select(F.col("paper_id").alias("citing_id")), "citing_id", "left_anti"),
        "unknown_cited_work": citations.join(works.select(F.col("work_id").alias("cited_id")), "cited_id", "left_anti"),
        "chunk_of_unknown_paper": chunks.join(papers.select("paper_id"), "paper_id", "left_anti").select("paper_id"),
        "unnamed_category": papers.filter(F.col("category").startswith(prefix) & ~F.col("category").isin(named)).select("category").distinct(),
    }


def write_index(path: str, documents: DataFrame, chunks: DataFrame, facets: DataFrame, vectors: DataFrame) -> None:
    """A search index, checked before anything is written."""
    check(**index_violations(documents, chunks, vectors))
    for name, df in (("documents", documents), ("chunks", chunks), ("facets", facets), ("vectors", vectors)):
        staged(df, f"{path.rstrip('/')}/{name}")


def write_corpus(path: str, papers: DataFrame, citations: DataFrame, works: DataFrame, chunks: DataFrame, named: list[str], buckets: int = 64) -> None:
    """A corpus, checked before anything is written; edges are distinct and sorted by the work they cite."""
    check(**corpus_violations(papers, citations, works, chunks, named))
    edges = citations.distinct().repartition(buckets, "cited_id").sortWithinPartitions("cited_id", "citing_id")
    for name, df in (("papers", papers), ("citations", edges), ("works", works), ("chunks", chunks)):
        staged(df, f"{path.rstrip('/')}/{name}")


def write_json_lines(df: DataFrame, path: str, key: str) -> None:
    """JSON lines in order of the key."""
    staged(df.orderBy(key), path, "json")


def write_edges(edges: DataFrame, path: str) -> None:
    """Lines of two ids with a tab between, in order."""
    staged(edges.select("citing_id", "cited_id").orderBy("citing_id", "cited_id"), path, "csv", sep="\t")


def first_seen(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_turn", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_turn = 1").drop("_turn")


def write_shard(df: DataFrame, path: str, shard: int) -> None:
    """One shard of a resumable job; written again, it replaces itself."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/shard={shard}")


def merge_shards(spark: SparkSession, path: str, target: str, key: str, shards: int) -> None:
    """All shards as one table, the first seen row of each key, within a shard the smallest by its other columns; a missing shard raises."""
    rows = spark.read.parquet(path)
    there = {r["shard"] for r in rows.select("shard").distinct().collect()}
    if there != set(range(shards)):
        raise Invalid(f"shards missing: {sorted(set(range(shards)) - there)}")
    others = [c for c in rows.columns if c not in (key, "shard")]
    staged(first_seen(rows, key, F.struct("shard", *others)).drop("shard"), target)


def upsert(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key; all its columns replace the old ones, nulls too. Of equals the new row wins."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    turn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc("_new")))
    return rows.withColumn("_turn", turn).filter("_turn = 1").drop("_turn", "_new")


def write_state(spark: SparkSession, path: str, **values: str) -> None:
    """Keys and values; those that are given replace the stored ones."""
    had = {**read_state(spark, path), **values}
    staged(spark.createDataFrame(sorted(had.items()), "key string, value string").coalesce(1), path)


def read_state(spark: SparkSession, path: str) -> dict[str, str]:
    fs, p = _fs(spark, path)
    return {r["key"]: r["value"] for r in spark.read.parquet(path).collect()} if fs.exists(p) else {}


def append_runs(runs: DataFrame, path: str) -> None:
    """Appends runs with an id and a day of their own; an address never reaches the log, only its hash."""
    if "ip" in runs.columns:
        raise Invalid("addresses are hashed before they are logged")
    out = runs if "run_id" in runs.columns else runs.withColumn("run_id", F.uuid())
    out.withColumn("day", F.substring("created_at", 1, 10)).write.mode("append").partitionBy("day").parquet(path)


def latest_runs(runs: DataFrame, key: str, order: Column) -> DataFrame:
    """Of several lines of an id the last."""
    return runs.withColumn("_turn", F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))).filter("_turn = 1").drop("_turn")


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table, if it has the columns its readers count on."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise Invalid(f"columns missing: {', '.join(missing)}")
    return df


def markdown_table(rows: DataFrame, columns: list[str], most: int = 200) -> str:
    """A short table (at most `most` rows) as markdown."""
    found = [r.asDict() for r in rows.select(*columns).limit(most).collect()]
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *[line([r[c] for c in columns]) for r in found]])


def splice(document: str, block: str, start: str, end: str) -> str:
    """The document with what stands between two marks replaced; a mark that is missing raises."""
    head, found, rest = document.partition(start)
    _, found_end, tail = rest.partition(end)
    if not found or not found_end:
        raise Invalid("marks missing")
    return f"{head}{start}\n{block}\n{end}{tail}"
