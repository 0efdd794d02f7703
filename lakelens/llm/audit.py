"""Audit of how filters interact: what each of five filters removes at each place of every order.

Flags are worked out where the texts are read; from then on a row is a digest of its text, its part
and its flags, and rows alike are counted before they travel. Counts by part and flags go through
one CUBE over the five flags and the part. Of its grouping sets, the rows whose selected flags are
all false count what survives that subset of filters, so 32 numbers a part hold every order:
a step is a pair of subsets that differ by one filter, and all orders read their steps off these
pairs by a join.

The fifth filter looks for an equal text under a smaller doc_id in the whole table, whatever else
was removed. Equal texts are told by SHA-256. Copies collapse to a row for each digest, part and
flags, with how many there are, so that a text which a third of all rows share is a few rows a
task; the row of smallest doc_id is carried along, as it alone (with its repeats) is no copy.

Null texts are empty texts. A null lang is the part ''. Rows without a doc_id have no label, are
copies of nothing and make nothing a copy. A doc_id that stands in several rows counts once for
each; those of equal text are no copies of each other, as neither id is smaller. A doc_id is good
or toxic if any of its labels says so. Texts are read whole. Extra columns are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelens.llm.shared import keep, pick

FILTERS = "ABCDE"
_SPACE = r"[\x20\x09-\x0D]+"


def text_flags(text: Column) -> dict[str, Column]:
    """Whether a text fails each of the filters that look at the text alone."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    n, kinds = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < 100, "B": 100 * kinds.cast("long") < 80 * n.cast("long"), "C": 100 * capitals.cast("long") > 10 * F.length(text).cast("long"), "D": text.rlike("[#$%&*|]")}


def _summed(*names: str) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


COUNTS = ("n", "good", "toxic")


def flag_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E, n, good, toxic: rows by part and flags."""
    text = F.coalesce("text", F.lit(""))
    d = pick(docs, "doc_id", "text", "lang").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    d = d.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), *[f.alias(k) for k, f in text_flags(F.col("text")).items()])
    kind = ["part", "digest", "A", "B", "C", "D"]
    marks = pick(labels, "doc_id", "quality", "toxic").select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id is not null")
    marks = marks.groupBy("doc_id").agg(*[F.max((F.col(c) == 1).cast("long")).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))])
    # rows alike are one row before they meet the labels, so no doc_id is many rows of one text
    named = d.filter("doc_id is not null").groupBy("doc_id", *kind).agg(F.count(F.lit(1)).alias("n"))
    named = named.join(marks, "doc_id", "left").select("doc_id", *kind, "n", *[(F.coalesce(k, F.lit(0)) * F.col("n")).alias(k) for k in COUNTS[1:]])
    first = F.min(F.struct("doc_id", *COUNTS)).alias("first")  # sums of one doc_id are in one row for each kind
    groups = named.groupBy(*kind).agg(*_summed(*COUNTS), first)
    # a row a digest, part and flags: at most as many of a digest as there are parts
    own = F.col("first.doc_id") == F.min("first.doc_id").over(Window.partitionBy("digest"))
    kept = [F.when(own, F.col(f"first.{c}")).otherwise(0).alias(f"{c}_first") for c in COUNTS]
    groups = groups.select("part", *"ABCD", *COUNTS, *kept)
    split = F.explode(F.array(*[F.struct(F.lit(e).alias("E"), *[(F.col(c) - F.col(f"{c}_first") if e else F.col(f"{c}_first")).alias(c) for c in COUNTS]) for e in (False, True)])).alias("s")
    flagged = groups.select("part", *"ABCD", split).select("part", *"ABCD", "s.*").filter("n > 0")
    nameless = d.filter("doc_id is null").groupBy("part", *"ABCD").agg(F.count(F.lit(1)).alias("n")).select("part", *"ABCD", F.lit(False).alias("E"), "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return flagged.unionByName(nameless).groupBy("part", *FILTERS).agg(*_summed(*COUNTS))


def survivors(counts: DataFrame) -> DataFrame:
    """part, subset (one bit a filter), n, good, toxic: what passes every filter of the subset, for all 32 of every part."""
    cube = counts.cube(*FILTERS, "part").agg(F.grouping_id().alias("left_out"), *_summed(*COUNTS))
    # grouping_id has a bit for each column left out, the part's last
    chosen = cube.filter((F.col("left_out") % 2 == 0) & ~F.coalesce(F.greatest(*FILTERS), F.lit(False)))
    subset = (31 - F.shiftright("left_out", 1)).cast("int")
    found = chosen.select("part", subset.alias("subset"), *COUNTS)
    whole = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("subset"))
    return whole.join(found, ["part", "subset"], "left").fillna(0, COUNTS)


def orders() -> list[tuple[str, int, int, int, int]]:
    """filter_order, step, filter's bit, subset before, subset after, for all orders."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 16 >> FILTERS.index(f)
            out.append(("".join(order), step, bit, before, before | bit))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    table = keep(survivors(keep(flag_counts(docs, labels), "flags")), "survivors")
    steps = table.sparkSession.createDataFrame(orders(), "filter_order string, step int, bit int, before int, after int")
    side = lambda name: table.select("part", F.col("subset").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in COUNTS])
    edges = F.broadcast(steps.select("bit", "before", "after").distinct())  # 80 rows
    pairs = side("before").join(edges, "before").join(side("after"), ["part", "after"])
    lost = lambda c: (F.col(f"{c}_before") - F.col(f"{c}_after")).alias
    pairs = pairs.select("part", "bit", "before", "after", F.col("n_after").alias("kept"), lost("n")("removed"), lost("good")("good_lost"), lost("toxic")("toxic_lost"))
    # a pair stands in (filters before)! * (filters after)! orders
    size = F.bit_count("before").cast("int")
    weight = F.factorial(size) * F.factorial(4 - size)
    at = lambda subset: F.sum(F.when(F.col("before") == subset, F.col("removed")))
    by_filter = pairs.groupBy("part", "bit").agg(F.sum(F.col("removed") * weight).alias("shapley"), at(F.lit(0)).alias("fails"), at(31 - F.col("bit")).alias("unique_fails"))
    out = pairs.join(by_filter, ["part", "bit"]).join(F.broadcast(steps), ["bit", "before", "after"])  # 600 rows
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
