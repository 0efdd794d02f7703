"""Ordered operators: prefixes under a budget, even samples, greedy packing, islands, runs, evictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_prefix(df: DataFrame, coarse: str, order: list[Column], size: str, budget: int, descending: bool = True) -> DataFrame:
    """Rows in order of (coarse, order) while their sizes, none below zero, sum to the budget or less, with the running sum.

    Sums of the coarse groups, of which there are few, tell where the budget ends; rows are only ordered within theirs,
    and groups beyond the end are not ordered at all.
    """
    by = F.desc(coarse) if descending else F.asc(coarse)
    sums = df.groupBy(coarse).agg(F.sum(size).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("_before", before).filter(F.col("_before") <= budget).select(coarse, "_before")
    within = F.sum(size).over(Window.partitionBy(coarse).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.join(F.broadcast(starts), coarse).withColumn("running", F.col("_before") + within).filter(F.col("running") <= budget).drop("_before")


def latest(df: DataFrame, key: list[str], version: str, *columns: str) -> DataFrame:
    """The highest version of each key with its other columns, found with partial aggregation."""
    best = F.max(F.struct(version, *columns)).alias("_best")
    return df.groupBy(*key).agg(best).select(*key, "_best.*")


def even_sample(df: DataFrame, by: list[str], order: list[Column], k: Column) -> DataFrame:
    """k rows of each group spread evenly over its order (all of a smaller group, the middle one for k = 1); k may be a column of the group."""
    w = Window.partitionBy(*by)
    rows = df.withColumn("_k", k).withColumn("_at", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    step = (F.col("_n") - 1) / (F.col("_k") - 1)
    # row j is taken if it is the rounded place (half to even) of some i; i lies within one of j / step
    near = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda x: F.round(F.col("_at") / step).cast("long") + x)
    hit = F.exists(near, lambda i: (i >= 0) & (i < F.col("_k")) & (F.rint(i * (F.col("_n") - 1) / (F.col("_k") - 1)).cast("long") == F.col("_at")))
    taken = F.when(F.col("_k") <= 0, F.lit(False)).when(F.col("_n") <= F.col("_k"), F.lit(True)).when(F.col("_k") == 1, F.col("_at") == F.expr("_n div 2")).otherwise(hit)
    return rows.filter(taken).drop("_k", "_at", "_n")


def round_robin(df: DataFrame, stratum: str, doc: str, key: str, n: int, per_doc: int = 1, seed: str = "") -> DataFrame:
    """Up to n rows, one of each stratum in turn, at most per_doc of a document; the shuffle is by a hash of seed and key."""
    h = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    capped = df.withColumn("_h", h).withColumn("_d", F.row_number().over(Window.partitionBy(doc).orderBy("_h", key))).filter(F.col("_d") <= per_doc)
    turned = capped.withColumn("turn", F.row_number().over(Window.partitionBy(stratum).orderBy("_h", key)))
    return turned.orderBy("turn", stratum, key).limit(n).drop("_h", "_d")


def relabel(df: DataFrame, label: str, noise: int = -1) -> DataFrame:
    """(label, n, place): groups numbered from 0 by falling size, ties by label; noise is left out. A row a group."""
    sizes = df.filter(F.col(label) != noise).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), label)) - 1)


def lines_with_offsets(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, at (line number from 0), start (its place in characters) and line."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)).cast("long"))


def spans(starts: DataFrame, key: str, start: str, end: Column) -> DataFrame:
    """Each start runs to the next one of its key, the last to `end`."""
    after = F.lead(start).over(Window.partitionBy(key).orderBy(start))
    return starts.withColumn("stop", F.coalesce(after, end))


def within_span(df: DataFrame, spans: Column, offset: Column, field: str, low: str = "char_start", high: str = "char_end") -> DataFrame:
    """The field of the span of an array that holds the offset, of the last span if none does."""
    hit = F.filter(spans, lambda p: (p[low] <= offset) & (offset < p[high]))
    found = F.when(F.size(hit) > 0, F.element_at(hit, 1)).otherwise(F.element_at(spans, -1))
    return df.withColumn(field, found[field])


def turns(df: DataFrame, session: str, order: list[Column], starts: Column) -> DataFrame:
    """`turn_no`: rows belong to the latest row that starts a turn; 0 before the first."""
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("turn_no", F.sum(F.when(starts, 1).otherwise(0)).over(w).cast("int"))


def best_title(df: DataFrame, session: str, title: Column, priority: Column, order: Column) -> DataFrame:
    """The title of highest priority of each session, the later of equals."""
    rows = df.select(session, title.alias("title"), priority.alias("priority"), order.alias("at")).filter("priority > 0 and title <> ''")
    return rows.groupBy(session).agg(F.max_by("title", F.struct("priority", "at")).alias("title"))


def greedy_groups(df: DataFrame, key: str, order: str, size: str, most: int, items: int | None = None) -> DataFrame:
    """key, order and `group` (from 0): rows of a key packed in order while the group's sizes stay within `most` and its rows within `items`.

    A row that is larger by itself stands alone. Rows are dealt and sorted by key and folded as they stream by, so a key
    of any length takes no more memory than a batch.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, used, count = object(), 0, 0, 0
        for batch in batches:
            out = []
            for k, n in zip(batch.column(key).to_pylist(), batch.column(size).to_pylist(), strict=True):
                if k != now:
                    now, group, used, count = k, 0, 0, 0
                elif used + n > most or (items is not None and count >= items):
                    group, used, count = group + 1, 0, 0
                used, count = used + n, count + 1
                out.append(group)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(order), pa.array(out, pa.int32())], names=[key, order, "group"])

    rows = df.select(key, F.col(order).cast("long").alias(order), F.col(size).cast("long").alias(size))
    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, f"{key} {kind}, {order} long, group int")


def islands(df: DataFrame, key: list[str], at: str) -> DataFrame:
    """key, first and last of each run of consecutive numbers."""
    w = Window.partitionBy(*key).orderBy(at)
    return df.withColumn("_island", F.col(at) - F.row_number().over(w)).groupBy(*key, "_island").agg(F.min(at).alias("first"), F.max(at).alias("last")).drop("_island")


def evict_oldest(df: DataFrame, key: str, order: str, size: str, stub: int, evictable: Column, ceiling: int) -> DataFrame:
    """`evicted`: the oldest evictable rows of a key are stubbed, one by one, until its sizes are within the ceiling; never the last row."""
    w = Window.partitionBy(key)
    rows = df.withColumn("_total", F.sum(size).over(w)).withColumn("_last", F.max(order).over(w))
    may = evictable & (F.col(order) < F.col("_last"))
    saved = F.when(may, F.col(size) - stub).otherwise(0)
    before = F.coalesce(F.sum(saved).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("evicted", may & (F.col("_total") - before > ceiling)).drop("_total", "_last")


def rank_normalized(df: DataFrame, by: str, columns: dict[str, Column]) -> DataFrame:
    """Each column's rank within its group, 0 to 1, ties sharing their mean; a constant or single row has 0.5.

    Ranks come from counts of distinct values, so equal rows of a large group never travel one by one.
    """
    valued = df.withColumns({f"_{name}": c for name, c in columns.items()})
    out = valued
    for name in columns:
        value = f"_{name}"
        ties = valued.groupBy(by, value).agg(F.count(F.lit(1)).alias("_ties"))
        w = Window.partitionBy(by)
        before = F.coalesce(F.sum("_ties").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranks = ties.withColumn("_before", before).withColumn("_n", F.sum("_ties").over(w))
        norm = F.when(F.col("_n") == 1, 0.5).otherwise((2 * F.col("_before") + F.col("_ties") - 1) / 2 / (F.col("_n") - 1))
        ranks = ranks.select(F.col(by).alias("_by"), F.col(value).alias("_value"), norm.alias(name))
        out = out.join(ranks, (F.col(by).eqNullSafe(F.col("_by"))) & F.col(value).eqNullSafe(F.col("_value"))).drop("_by", "_value", value)
    return out


#: What each facet weighs in the composite score.
WEIGHTS = {"authority": 0.30, "niche": 0.20, "novelty": 0.15, "revisions": 0.10, "venue": 0.25}


def parse_weights(spec: str | None) -> dict[str, float]:
    """'authority=0.5,venue=0': changes of the weights; unknown names and parts without a value do not count."""
    out = dict(WEIGHTS)
    for part in (spec or "").split(","):
        name, sep, value = part.partition("=")
        if sep and name.strip() in out:
            out[name.strip()] = float(value)
    return out


def composite(df: DataFrame, by: str, facets: dict[str, Column], weights: dict[str, float] | None = None) -> DataFrame:
    """`score`: the weighted sum of the ranks of all facets within a group."""
    weights = weights or WEIGHTS
    named = {f"rank_{k}": c for k, c in facets.items()}
    total = sum((F.lit(w) * F.col(f"rank_{k}") for k, w in weights.items()), F.lit(0.0))
    return rank_normalized(df, by, named).withColumn("score", F.round(total, 9)).drop(*named)


def cached(path: str, inputs: str, build: Callable[[], DataFrame], exists: Callable[[str], bool]) -> DataFrame:
    """A table kept under a name made of its inputs' state; built only where that name is not there yet."""
    import hashlib

    place = f"{path.rstrip('/')}/{hashlib.sha256(inputs.encode()).hexdigest()[:16]}"
    if exists(f"{place}/_SUCCESS"):
        from pyspark.sql import SparkSession

        return SparkSession.active().read.parquet(place)
    df = build()
    df.write.mode("overwrite").parquet(place)
    return df.sparkSession.read.parquet(place)
