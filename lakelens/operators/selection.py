"""Exact order statistics of groups without ordering them: ranges narrowed by counts, round by round.

Every target (a group and a rank) has a range of values that holds it. A round counts the values of
each range in SLICES equal slices, which tasks do before anything travels, and goes on with the
least and the largest value of the slice that the rank falls into. Least and largest never share a
slice, so each round leaves out values; ranges shrink about SLICES times a round where values are
spread. A group's values never meet in one task; what does is a row a slice.

Values are taken as doubles; nulls and NaN do not count. A rank beyond its group gives no row, a
group may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelens.operators.density import Keep

SLICES = 256


def _valued(rows: DataFrame, by: str, value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return rows.select(F.col(by).alias("_by"), v.alias("_v")).filter(v.isNotNull() & ~F.isnan(v))


def extent(rows: DataFrame, by: str, value: str) -> DataFrame:
    """_by, n, lo and hi of every group."""
    return _valued(rows, by, value).groupBy("_by").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))


def select(rows: DataFrame, by: str, value: str, ranks: dict[str, Column], keep: Keep) -> DataFrame:
    """The group and, under each name, the value of that rank from 0 (a column of n, the group's count); null beyond the group."""
    valued = _valued(rows, by, value)
    groups = keep(extent(rows, by, value), "extent")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items()]))
    state = keep(groups.select("_by", "lo", "hi", "n", each.alias("t")).select("_by", "lo", "hi", "t.name", "t.rank", "n").filter("rank >= 0 and rank < n").drop("n"), "state")
    settled: list[DataFrame] = []
    while True:
        settled.append(state.filter("lo = hi").select("_by", "name", F.col("lo").alias("value")))
        left = state.filter("lo < hi")
        if not left.take(1):
            break
        # halves, so that no difference is beyond all numbers
        span = F.col("hi") / 2 - F.col("lo") / 2
        place = F.when(span > 0, F.floor((F.col("_v") / 2 - F.col("lo") / 2) / F.when(span > 0, span).otherwise(1.0) * SLICES)).otherwise(F.when(F.col("_v") > F.col("lo"), SLICES).otherwise(0))
        targets = left.withColumnRenamed("_by", "_g")
        met = valued.join(targets, F.col("_by").eqNullSafe(F.col("_g")) & F.col("_v").between(F.col("lo"), F.col("hi")))
        counts = met.withColumn("slice", F.least(place.cast("int"), F.lit(SLICES - 1))).groupBy("_by", "name", "rank", "slice").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        w = Window.partitionBy("_by", "name").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
        upto = counts.withColumn("upto", F.sum("n").over(w))
        found = upto.filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        state = keep(found.select("_by", "lo", "hi", "name", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")), "state")
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    wide = out.groupBy("_by").agg(*[F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in ranks])
    met = groups.select(F.col("_by").alias("_g"), "n").join(wide, F.col("_g").eqNullSafe(F.col("_by")), "left")
    return met.select(F.col("_g").alias(by), "n", *ranks)


def median(rows: DataFrame, by: str, value: str, keep: Keep) -> DataFrame:
    """The group and `median`, the mean of the middle two where there are two."""
    got = select(rows, by, value, {"low": F.expr("(n - 1) div 2"), "high": F.expr("n div 2")}, keep)
    return got.select(by, ((F.col("low") + F.col("high")) / 2).alias("median"))


def latency(rows: DataFrame, by: str, value: str, keep: Keep) -> DataFrame:
    """by, p50 (the median), p95 (the value of rank int(0.95 n)), worst and mean."""
    ranks = {"low": F.expr("(n - 1) div 2"), "high": F.expr("n div 2"), "p95": F.greatest(F.lit(1), F.floor(F.col("n") * 0.95)) - 1, "worst": F.col("n") - 1}
    got = select(rows, by, value, ranks, keep).withColumn("p50", (F.col("low") + F.col("high")) / 2)
    mean = _valued(rows, by, value).groupBy("_by").agg(F.round(F.avg("_v"), 6).alias("mean"))
    return got.join(mean, F.col(by).eqNullSafe(F.col("_by"))).select(by, "p50", "p95", "worst", "mean")
