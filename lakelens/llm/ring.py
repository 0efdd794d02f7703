"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Every shard owns ``vnodes`` points of a ring of 2**60 places; a row falls on the ring by a hash of
its key and belongs to the next point clockwise, so the ring is cut into ``shards * vnodes`` arcs.
No shard may hold more than its bound, ``ceil`` or ``floor`` of rows / shards: rows of an arc
whose shard is full continue clockwise to the next point whose shard has room. Within an arc rows
stand in ring order, those nearest to the point first, so which rows overflow is determined by
hashes alone. Counts per shard therefore differ by one at most (law ``rows``). A further shard moves
a part of the rows only (README), more than its own share since counts stay even.

Only the counts of the arcs (a fixed number, whatever the input) reach the driver, where the
clockwise walk runs over counts; rows find their place from their rank in the arc. Ranks come from
a window over (arc, slice): each arc is cut evenly into slices by hash, so no window task holds
more than a small share of the rows. A hot text or source changes nothing, as the place depends on
doc_id too; rows equal in both are counted before the shuffle and travel as one.

Null doc_id and null text are allowed (hashed as such; size of a null text is 1). An empty table
gives an empty result. Rows that are equal in doc_id and text are interchangeable.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakelens.llm.shared import keep, pick

PLACES = 1 << 60
CELLS = 1 << 12
#: Equal rows laid out by one step at most.
COPIES = 100_000


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, by place."""
    at = lambda s, v: int(hashlib.sha256(f"shard-{s}-{v}".encode()).hexdigest()[:15], 16)
    return sorted((at(s, v), s) for s in range(shards) for v in range(vnodes))


def walk(counts: list[int], points: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): where the rows of each arc go.

    Round by round every waiting run of an arc asks the point it has come to; a shard takes what
    it has room for, the rest moves one point clockwise. Bounds sum up to the rows, so all find room.
    """
    total, n = sum(counts), len(points)
    low, more = divmod(total, shards)
    # the shards that may take one row more are those with most rows of their own
    own = [0] * shards
    for c, (_, s) in zip(counts, points, strict=True):
        own[s] += c
    room = [low] * shards
    for s in sorted(range(shards), key=lambda s: (-own[s], s))[:more]:
        room[s] += 1
    used = [0] * shards
    out, waiting = [], [(a, 0, c, a) for a, c in enumerate(counts) if c]
    while waiting:
        later = []
        for arc, lo, hi, at in waiting:
            s = points[at % n][1]
            take = min(hi - lo, room[s] - used[s])
            if take > 0:
                out.append((arc, lo, lo + take, s, used[s]))
                used[s] += take
            if lo + take < hi:
                later.append((arc, lo + take, hi, at + 1))
        waiting = later
    return out


def shard_rows(docs: DataFrame, shards: int = 16, vnodes: int = 64, slices: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    d = pick(docs, "doc_id", "text")
    spark = d.sparkSession
    points = ring_points(shards, vnodes)
    n = len(points)
    cells = spark.createDataFrame(_cells(points), "cell int, base int, near array<long>")
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32").cast("string"))
    rows = d.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))  # equal rows travel once
    rows = rows.withColumn("place", F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 15), 16, 10).cast("long"))
    rows = rows.withColumn("cell", (F.col("place") / (PLACES // CELLS)).cast("int")).join(F.broadcast(cells), "cell")  # of a fixed size
    rows = rows.withColumn("inside", F.size(F.filter("near", lambda p: p < F.col("place"))))  # the point before counts too
    gap = F.element_at("near", F.col("inside") + 1) - F.col("place")
    share = gap / (F.element_at("near", F.col("inside") + 1) - F.element_at("near", F.col("inside")))
    rows = rows.select("doc_id", "size", "text_crc32", "copies", ((F.col("base") + F.col("inside") - 1) % n).alias("arc"), gap.alias("gap"), F.least(F.floor(share * slices), F.lit(slices - 1)).cast("int").alias("slice"))
    rows = keep(rows, "ring")

    counted = {(r["arc"], r["slice"]): r["n"] for r in rows.groupBy("arc", "slice").agg(F.sum("copies").alias("n")).collect()}  # arcs * slices numbers at most
    counts = [[counted.get((a, s), 0) for s in range(slices)] for a in range(n)]
    plan: dict[int, list[tuple[int, int, int]]] = {}
    for arc, lo, _, shard, slot in walk([sum(c) for c in counts], points, shards):
        plan.setdefault(arc, []).append((lo, shard, slot))
    steps = [(a, s, sum(counts[a][:s]), *map(list, zip(*sorted(plan[a]), strict=True))) for a in plan for s in range(slices)]
    steps = spark.createDataFrame(steps, "arc int, slice int, first long, lo array<long>, shards array<int>, slots array<long>")

    in_order = Window.partitionBy("arc", "slice").orderBy("gap", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("upto", F.sum("copies").over(in_order)).join(F.broadcast(steps), ["arc", "slice"])  # of a fixed size
    ranked = ranked.withColumn("rank", F.col("first") + F.col("upto") - F.col("copies"))
    # copies get consecutive ranks; a huge number of them is cut into lots first, which are dealt out before they are laid out
    lots = ranked.filter(F.col("copies") > COPIES).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long")))).repartition(F.xxhash64("doc_id", "text_crc32", "at"))
    ranked = ranked.filter(F.col("copies") <= COPIES).withColumn("at", F.lit(0).cast("long")).unionByName(lots)
    ranked = ranked.withColumn("more", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(COPIES), F.col("copies") - F.col("at")) - 1)))
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("at") + F.col("more"))
    step = F.size(F.filter("lo", lambda x: x <= F.col("rank")))
    ranked = ranked.withColumn("step", step)
    slot = F.element_at("slots", F.col("step")) + F.col("rank") - F.element_at("lo", F.col("step"))
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.element_at("shards", F.col("step")).alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _cells(points: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """(cell, index of the first point in or after it, the point before, those inside and the point after): the ring in CELLS equal cells."""
    places, width = [p for p, _ in points], PLACES // CELLS
    out = []
    for c in range(CELLS):
        i, j = bisect_left(places, c * width), bisect_left(places, (c + 1) * width)
        out.append((c, i, [places[i - 1] if i else places[-1] - PLACES, *places[i:j], places[j] if j < len(places) else places[0] + PLACES]))
    return out
