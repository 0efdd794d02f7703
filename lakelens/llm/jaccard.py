"""Grouped prefix join: all documents whose shingle sets have a Jaccard similarity of num / den or more.

1. The shingle set of every whole text is written once, as sorted 48-bit hashes. Shingles are dealt to
   tasks by their hash and counted exactly. Those of 16 documents or more are heavy; at most 2**21
   of them, the most frequent, are sent to all tasks (if there are more, 16 doubles until they fit).
   All shingles have one order: light ones by hash, then heavy ones by the logarithm of their count.
2. Documents with the same set are one class. The first ``n - ceil(t n) + 1`` shingles of a class in
   that order are its prefix; two similar sets share one. Classes with identical prefix and size are
   one group, named by its smallest class.
3. Groups that meet in a light shingle are paired and filtered by size and by the place of the shingle:
   a light shingle has fewer than 16 groups, so pairs grow in proportion to groups. For a heavy shingle
   each group is first paired with just one other, a new one in each round.
4. Pairs of groups are held against each other by the parities of their first members: bit i tells
   whether an odd number of shingles fall on i. Sets differ in at least as many shingles as parities,
   so pairs with too many unequal bits cannot be similar. Of what passes, the nearest pair of each class
   is verified first, on whole sets; what links is joined into components, and only pairs of different
   components are verified after that.
5. Last, groups are expanded: their members, and all classes that still meet in a shingle, are compared
   unless they are in one component already. A shingle's classes are cut into slices, and pairs of slices
   are dealt to tasks, so none holds them all. So no link between components is missed, and none inside
   one can change it.

Words end at ASCII white space, A-Z lowered; sets hold shingles of ``words`` words, or the whole
text as one if it has fewer. Null, empty and blank texts have empty sets and are linked with
nothing, each a component of its own. Rows that repeat a doc_id are documents each for itself; the
component is named by the smallest doc_id in it, null ids apart (null if there is no other). An
empty table gives no rows. Sets stand as 48-bit hashes of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelens.llm.components import TASK_LINKS, components
from lakelens.llm.shared import LOWER, SPACED, U64, Workspace, gram_hashes, keep, mix, numbered, pick, portions, tidy, utf8, word_bounds, word_hashes

#: Bits of a shingle's hash.
WIDTH = 48
#: Bits of the filter that spares most sets a trip; a full one only makes more of them travel.
NEEDED = 24


@dataclass(frozen=True)
class Sizes:
    """Bounds of memory and of work a task; links are the same whatever they are."""

    #: Shingles of this many documents are heavy, and how many heavy ones are sent to all tasks at most (18 MB).
    heavy: int = 16
    listed: int = 1 << 21
    #: Shingles, postings, rows and links of one task.
    shingles: int = 1 << 20
    postings: int = 1 << 18
    rows: int = 1 << 16
    links: int = TASK_LINKS
    #: Star rounds, which end early once this many pairs a posting are left to compare, and classes of a slice.
    rounds: int = 3
    few: int = 16
    slice: int = 256


def shingle_sets(batch: pa.RecordBatch, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = utf8(batch.column("text"))
    low = LOWER[data]
    starts, ends, at = word_bounds(low, offsets, SPACED)
    h = word_hashes(low, starts, ends)
    grams = gram_hashes(h, words) >> U64(64 - WIDTH)
    for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if z - a >= words:
            yield np.unique(grams[a : z - words + 1])
        elif z > a:
            yield gram_hashes(h[a:z], z - a) >> U64(64 - WIDTH)
        else:
            yield h[:0]


def packed(s: np.ndarray) -> bytes:
    """The low bytes of a set's hashes."""
    return s.view(np.uint8).reshape(-1, 8)[:, : WIDTH // 8].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    low = np.frombuffer(data, np.uint8).reshape(-1, WIDTH // 8)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, : WIDTH // 8] = low
    return out.view(U64).ravel()


def class_of(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    parts = np.array([np.sum(s, dtype=U64), np.bitwise_xor.reduce(mix(s)), len(s)], U64)
    return int(gram_hashes(parts, 3).view(np.int64)[0])


def parities(s: np.ndarray) -> np.ndarray:
    """One bit for each of 2**k slots, about as many as there are shingles: whether an odd number of them falls on it.

    The bits of 2**(k - 1) slots are the exclusive or of both halves, so classes of either size compare.
    """
    slots = 1 << min(max(6, (len(s) - 1).bit_length()), 20)
    odd = np.bincount((s >> U64(20)).astype(np.int64) & (slots - 1), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def tasks_for(rows: int, each: int) -> int:
    return max(1, -(-rows // each))


def binary(column: pa.Array) -> list[memoryview]:
    return [x.as_buffer() for x in column]


def write_sets(work: Workspace, docs: DataFrame, words: int) -> DataFrame:
    """doc_id, k, n, cid and s of every document (columns doc_id, k, text); cid and s are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text", 1 << 20):
                sets = list(shingle_sets(part, words))
                cid = pa.array([class_of(s) if len(s) else None for s in sets], pa.int64())
                s = pa.array([packed(s) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("k"), pa.array([len(x) for x in sets], pa.int64()), cid, s], names=["doc_id", "k", "n", "cid", "s"])

    return work.keep(docs.mapInArrow(tidy(run), "doc_id long, k long, n long, cid long, s binary"), "sets", "none")


def heavy_shingles(work: Workspace, sets: DataFrame, total: int, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """The heavy shingles that are sent to all tasks, sorted, and their levels (2**level documents or more)."""
    bits = max(0, (tasks_for(total, sizes.shingles) - 1).bit_length())

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        """Distinct shingles of some documents with their counts, by slots of the hash: the combine before the shuffle."""
        token, n = np.unique(np.concatenate(held), return_counts=True)
        ends = np.searchsorted(token >> U64(WIDTH - bits), np.arange((1 << bits) + 1)) if bits else np.array([0, len(token)])
        some = np.flatnonzero(np.diff(ends))
        cut = [slice(ends[i], ends[i + 1]) for i in some]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([packed(token[c]) for c in cut], pa.binary()), pa.array([n[c].astype(np.uint32).tobytes() for c in cut], pa.binary())], names=["slot", "token", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for s in binary(batch.column("s")):
                held.append(unpacked(s))
                size += len(held[-1])
                if size >= sizes.shingles:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    def summed(held: list[tuple]) -> pa.RecordBatch:
        token, n = np.concatenate([unpacked(x) for x, _ in held]), np.concatenate([np.frombuffer(x, np.uint32) for _, x in held])
        order = np.argsort(token)
        token, n = token[order], n[order].astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        df = np.add.reduceat(n, new)
        on = df >= sizes.heavy
        return pa.RecordBatch.from_arrays([pa.array(token[new[on]].view(np.int64)), pa.array((np.frexp(df[on])[1] - 1).astype(np.int32))], names=["token", "level"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for slot, token, n in zip(batch.column("slot").to_pylist(), binary(batch.column("token")), binary(batch.column("n")), strict=True):
                if slot != now and held:
                    yield summed(held)
                    held = []
                now = slot
                held.append((token, n))
        if held:
            yield summed(held)

    parts = sets.filter("n > 0").select("s").mapInArrow(tidy(count), "slot int, token binary, n binary").repartitionById(1 << bits, F.col("slot")).sortWithinPartitions("slot")
    heavy = work.keep(parts.mapInArrow(tidy(add), "token long, level int"), "heavy")
    least, listed = 64, 0
    for level, n in sorted(heavy.groupBy("level").count().collect(), reverse=True):  # a row for each power of two
        if listed + n > sizes.listed:
            break
        least, listed = level, listed + n
    rows = heavy.filter(F.col("level") >= least).toArrow()
    token, level = rows["token"].to_numpy().view(U64), rows["level"].to_numpy().astype(np.uint8)
    order = np.argsort(token)
    return token[order], level[order]


def classify(work: Workspace, sets: DataFrame, docs: int, heavy: tuple[np.ndarray, np.ndarray], num: int, den: int, sizes: Sizes) -> DataFrame:
    """cid, g, n, bits, and, for the first class of a group, prefix (its shingles in order) and light (how many are light)."""
    sent = work.send(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, levels = sent.value
        seen: set[int] = set()
        for batch in batches:
            out: list[tuple] = []
            for cid, data in zip(batch.column("cid").to_pylist(), binary(batch.column("s")), strict=True):
                if cid in seen:  # copies within a task travel once
                    continue
                seen.add(cid)
                s = unpacked(data)
                p = prefix_length(len(s), num, den)
                first, light = s[:p], p
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    level = np.where(keys[at] == s, levels[at], 0)
                    if level[:p].any():
                        order = np.lexsort((s, level))[:p]
                        first, light = s[order], int((level[order] == 0).sum())
                out.append((cid, class_of(np.append(first, U64(len(s)))), len(s), parities(s), first.view(np.int64), light))
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["cid", "gid", "n", "bits", "prefix", "light"])

    found = sets.filter("n > 0").select("cid", "s").mapInArrow(tidy(run), "cid long, gid long, n long, bits array<long>, prefix array<long>, light int")
    w = Window.partitionBy("gid").orderBy("cid")
    each = found.repartition(tasks_for(docs, sizes.rows), "gid").select("*", F.first("cid").over(w).alias("g"), F.lag("cid").over(w).alias("before"))
    each = each.filter("before is null or before <> cid")
    leads = F.col("g") == F.col("cid")
    return work.keep(each.select("cid", "g", "n", "bits", F.when(leads, F.col("prefix")).alias("prefix"), F.when(leads, F.col("light")).alias("light")), "classes")


def light_pairs(work: Workspace, classes: DataFrame, postings: int, num: int, den: int, sizes: Sizes) -> DataFrame:
    """(a, b), a < b: groups that meet in a light shingle and fit in size and place."""
    bits = max(0, (tasks_for(postings, sizes.postings) - 1).bit_length())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, light = batch.column("prefix"), batch.column("light").to_numpy().astype(np.int64)
            offsets = lists.offsets.to_numpy()[: batch.num_rows]
            row = np.repeat(np.arange(batch.num_rows), light)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(light) - light, light)
            token = lists.values.to_numpy()[np.repeat(offsets, light) + pos].view(U64)
            order = np.argsort(token)
            slot = (token[order] >> U64(WIDTH - bits)).astype(np.int64) if bits else np.zeros(len(order), np.int64)
            cells = np.empty(len(order), _CELL)
            cells["token"], cells["g"], cells["n"], cells["pos"] = token[order], batch.column("g").to_numpy()[row[order]], batch.column("n").to_numpy()[row[order]], pos[order]
            new = np.flatnonzero(np.diff(slot, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(slot[new].astype(np.int32)), pa.array([c.tobytes() for c in np.split(cells, new[1:])] if len(new) else [], pa.binary())], names=["slot", "cells"])

    def met(held: list[memoryview]) -> Iterator[pa.RecordBatch]:
        cells = np.concatenate([np.frombuffer(x, _CELL) for x in held])
        cells = cells[np.argsort(cells["token"], kind="stable")]
        token = cells["token"]
        new = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(new, len(token)))
        cells = cells[np.repeat(size > 1, size)]  # most shingles are of one group
        at, step = 0, 1 << 16
        while at < len(cells):
            end = min(at + step, len(cells))
            while end < len(cells) and cells["token"][end] == cells["token"][end - 1]:
                end += 1
            part, at = cells[at:end], end
            i, apart, found = np.arange(len(part) - 1), 1, []
            while len(i):  # neighbours at distance 1, 2, .. of the same shingle
                i = i[i + apart < len(part)]
                i = i[part["token"][i] == part["token"][i + apart]]
                x, y = part[i], part[i + apart]
                apart += 1
                n, m = np.minimum(x["n"], y["n"]).astype(np.int64), np.maximum(x["n"], y["n"]).astype(np.int64)
                rest = np.minimum(x["n"] - x["pos"], y["n"] - y["pos"]) + np.minimum(x["pos"], y["pos"])
                ok = (den * n >= num * m) & ((den + num) * rest.astype(np.int64) >= num * (n + m)) & (x["g"] != y["g"])
                found.append((np.minimum(x["g"], y["g"])[ok], np.maximum(x["g"], y["g"])[ok]))
            if found:
                a, b = unique_pairs(*(np.concatenate(c) for c in zip(*found, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for slot, cells in zip(batch.column("slot").to_pylist(), binary(batch.column("cells")), strict=True):
                if slot != now and held:
                    yield from met(held)
                    held = []
                now = slot
                held.append(cells)
        if held:
            yield from met(held)

    parts = classes.filter("light > 0").select("g", "n", "prefix", "light").mapInArrow(tidy(deal), "slot int, cells binary")
    pairs = parts.repartitionById(1 << bits, F.col("slot")).sortWithinPartitions("slot").mapInArrow(tidy(meet), "a long, b long")
    return work.keep(pairs.distinct(), "light")


_CELL = np.dtype([("token", U64), ("g", np.int64), ("n", np.int32), ("pos", np.int32)])


def needed_sets(work: Workspace, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cid, s): the whole set of each class of the pairs; a filter of fixed size keeps most others from travelling."""
    bit = pairs.select(F.explode(F.array("a", "b")).alias("c")).select(F.col("c").bitwiseAND((1 << NEEDED) - 1).alias("bit"))
    rows = bit.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    flags = np.zeros(1 << (NEEDED - 6), np.int64)
    flags[rows["w"].to_numpy()] = rows["bits"].to_numpy()
    sent = work.send(flags)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, seen = sent.value, set()
        for batch in batches:
            cid = batch.column("cid").to_numpy()
            at = cid & ((1 << NEEDED) - 1)
            on = (flags[at >> 6] >> (at & 63) & 1).astype(bool)
            for i in np.flatnonzero(on):
                on[i] = cid[i] not in seen
                seen.add(cid[i])
            yield batch.filter(pa.array(on))

    return sets.filter("n > 0").select("cid", "s").mapInArrow(tidy(asked), "cid long, s binary")


def verify(work: Workspace, sets: DataFrame, pairs: DataFrame, rows: int, num: int, den: int, sizes: Sizes) -> DataFrame:
    """Of the pairs (a, b) of classes those that are similar, on whole sets, a kept table."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(binary(batch.column("sa")), binary(batch.column("sb")), strict=True):
                x, y = unpacked(x), unpacked(y)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    tasks = tasks_for(rows, sizes.rows // 4)
    whole = work.keep(needed_sets(work, sets, pairs).repartition(tasks, "cid").dropDuplicates(["cid"]), "needed", "none")
    a, b = whole.toDF("a", "sa"), whole.toDF("b", "sb")
    # the second join takes pairs with one set each, dealt by the other
    met = pairs.repartition(tasks, "a").join(a.repartition(tasks, "a"), "a").repartition(tasks, "b").join(b.repartition(tasks, "b"), "b")
    return work.keep(met.select("a", "b", "sa", "sb").mapInArrow(tidy(compare), "a long, b long"), "similar")


def _fits(num: int, den: int) -> str:
    """Sizes near enough, and around the shared heavy shingle enough left to share.

    All light shingles of both classes stand before it, and none of them is shared: such a pair has met in it already.
    """
    return f"{den} * least(n, n2) >= {num} * greatest(n, n2) and {den + num} * (least(n - pos, n2 - pos2) + least(pos - light, pos2 - light2)) >= {num} * (n + n2)"


def _distance() -> str:
    """In how many parities the classes of a pair differ; null where sizes are too far apart to fold."""

    def folded(x: str, y: str) -> str:
        return f"if(size({x}) > size({y}), zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (p, q) -> p ^ q), {x})"

    return f"aggregate(zip_with({folded('bits', 'bits2')}, {folded('bits2', 'bits')}, (p, q) -> bit_count(p ^ q)), 0, (p, q) -> p + q)"


def _near(num: int, den: int) -> str:
    """Not more unequal parities than similar sets can have."""
    return f"coalesce({den + num} * {_distance()} <= {den - num} * (n + n2), true)"


def _pair(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def near_pairs(work: Workspace, classes: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, far) of the pairs that their parities do not rule out, a kept table."""
    known = classes.select("cid", "n", "bits")
    out = pairs.join(known.toDF("a", "n", "bits"), "a").join(known.toDF("b", "n2", "bits2"), "b")
    out = out.filter(f"{den} * least(n, n2) >= {num} * greatest(n, n2) and {_near(num, den)}")
    return work.keep(out.select("a", "b", F.expr(f"coalesce({_distance()}, 0)").alias("far")), "near")


def apart(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The pairs of different components."""
    if roots is None:
        return pairs
    r = F.coalesce("ra", "a") != F.coalesce("rb", "b")
    return pairs.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left").filter(r).drop("ra", "rb")


def rooted(classes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Classes (column cid) with their component, root."""
    if roots is None:
        return classes.withColumn("root", F.col("cid"))
    return classes.join(roots.toDF("cid", "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))


def similar_classes(work: Workspace, sets: DataFrame, num: int, den: int, sizes: Sizes) -> DataFrame | None:
    """(node, root) of every class that is linked with another; None if there are no links."""
    docs, total = sets.filter("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    if not docs:
        return None
    classes = classify(work, sets, docs, heavy_shingles(work, sets, total, sizes), num, den, sizes)
    n, light, heavy, wide = classes.agg(F.count(F.lit(1)), F.sum("light"), F.sum(F.expr("size(prefix) - light")), F.count(F.expr("if(cid <> g, 1, null)"))).first()
    pairs = light_pairs(work, classes, light or 0, num, den, sizes)

    # heavy shingles of groups, and the name of a group with several members as a shingle of its members
    post = None
    if heavy or wide:
        post = classes.filter("size(prefix) > light").select("cid", "g", "n", "light", F.posexplode("prefix").alias("pos", "token")).filter("pos >= light")
        # shingles met by the very same groups, as those of a passage, tell the same: one of them stays
        met = post.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("g")).alias("x"), F.bit_xor(F.xxhash64("g", F.lit(1))).alias("y")).filter("m > 1")
        met = met.groupBy("m", "x", "y").agg(F.min("token").alias("token")).select("token")
        post = work.keep(post.join(met, "token").select("cid", "g", "n", "light", "pos", "token"), "heavy-postings")
        if wide:
            inner = classes.join(classes.filter("cid <> g").select("g").distinct(), "g").select("cid", "g", "n", F.lit(0).alias("light"), F.lit(0).alias("pos"), F.xxhash64("g", F.lit("group")).alias("token"))
            post = work.keep(post.unionByName(inner), "postings")

    def star(at: DataFrame, turn: int) -> DataFrame:
        """Each class of a shingle against just one other: first that of fewest light shingles, then another for each shingle and turn."""
        order = F.struct((-F.col("light") / F.col("n")).alias("own"), "cid") if turn == 0 else F.xxhash64("cid", "token", F.lit(turn))
        chosen = at.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), *[F.max_by(c, order).alias(f"{c}2") for c in ("cid", "n", "light", "pos", "root")]).filter("x < y")
        return at.join(chosen, "token").filter(f"root <> root2 and {_fits(num, den)}").select(*_pair("cid", "cid2"))

    links = roots = None

    def test(found: DataFrame) -> None:
        nonlocal links, roots
        rows = found.count()
        if not rows:
            return
        new = verify(work, sets, found, rows, num, den, sizes)
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            roots = components(work, links, sizes.links)

    def nearest(found: DataFrame) -> DataFrame:
        """The pair of fewest unequal parities of each class."""
        ends = found.select(F.explode(F.array("a", "b")).alias("c"), F.struct("far", "a", "b").alias("p"))
        return work.keep(ends.groupBy("c").agg(F.min("p").alias("p")).select("p.a", "p.b").distinct(), "nearest")

    first = pairs if post is None else pairs.unionByName(star(rooted(post, None), 0)).distinct()
    first = near_pairs(work, classes, first, num, den)
    test(nearest(first))
    # a second time around, the nearest that is left; then everything
    rest = work.keep(apart(first, roots), "apart")
    if not rest.isEmpty():
        test(nearest(rest))
        test(work.keep(apart(rest, roots).select("a", "b"), "apart"))
    for turn in range(1, sizes.rounds):
        if post is None:
            break
        named = rooted(post, roots)
        met = named.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y")
        rows, left = met.agg(F.sum("m"), F.sum(F.expr("m * (m - 1) / 2"))).first()
        if not rows or left <= sizes.few * rows:
            break
        found = near_pairs(work, classes, star(named, turn).distinct(), num, den)
        test(nearest(found))
        test(work.keep(apart(found, roots).select("a", "b"), "apart"))
    if wide or post is not None:
        rest = expanded(work, classes, pairs if wide else None, post, roots, num, den, sizes)
        if rest is not None:
            found = near_pairs(work, classes, rest, num, den)
            test(nearest(found))
            test(work.keep(apart(found, roots).select("a", "b"), "apart"))
    return roots


def expanded(work: Workspace, classes: DataFrame, pairs: DataFrame | None, post: DataFrame | None, roots: DataFrame | None, num: int, den: int, sizes: Sizes) -> DataFrame | None:
    """(a, b): all members of groups that meet, in a light or a heavy shingle, and are of different components."""
    members = rooted(classes.select("cid", "g"), roots)
    parts = []
    if pairs is not None:
        # pairs of groups that have a member more than the two that were compared, and not all in one component
        groups = work.keep(members.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("x"), F.max("root").alias("y")), "groups")
        open_ = pairs.join(groups.toDF("a", "ma", "xa", "ya"), "a").join(groups.toDF("b", "mb", "xb", "yb"), "b")
        open_ = open_.filter("ma * mb > 1 and least(xa, xb) < greatest(ya, yb)").select("a", "b")
        both = open_.join(members.toDF("cid", "a", "root"), "a").join(members.toDF("cid2", "b", "root2"), "b")
        parts.append(both.filter("root <> root2").select(*_pair("cid", "cid2")))
    if post is not None:
        named = post.select("token", "g", "n", "light", "pos").distinct().join(members, "g") if pairs is not None else rooted(post, roots)
        several = named.groupBy("token").agg(F.countDistinct("cid").alias("m"), F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("token", "m")
        left = named.join(several, "token").withColumn("slices", F.ceil(F.col("m") / sizes.slice)).withColumn("i", F.pmod(F.xxhash64("cid", "token"), F.col("slices")))
        left = left.join(classes.select("cid", "bits"), "cid").withColumn("j", F.explode(F.expr("sequence(0L, slices - 1)")))
        columns = ("i", "cid", "n", "light", "pos", "root", "bits")
        left = work.keep(left.select("token", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), *columns), "slices")
        other = left.select("token", "lo", "hi", *[F.col(c).alias(f"{c}2") for c in columns])
        # of a pair of slices the lower against the higher; within a slice each pair once
        once = "((lo = hi and cid < cid2) or (i = lo and i2 = hi and lo < hi))"
        parts.append(left.join(other, ["token", "lo", "hi"]).filter(f"root <> root2 and {once} and {_fits(num, den)} and {_near(num, den)}").select(*_pair("cid", "cid2")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = work.keep(out.distinct(), "expanded")
    return None if out.isEmpty() else out


def _named(work: Workspace, docs: DataFrame, words: int, num: int, den: int, sizes: Sizes) -> DataFrame:
    """doc_id, k, n, cid and component (a class, null for empty sets) of every document (columns doc_id, k, text)."""
    sets = write_sets(work, docs, words)
    roots = similar_classes(work, sets, num, den, sizes)
    each = sets.select("doc_id", "k", "n", "cid")
    return rooted(each, roots).withColumn("component", F.col("root")).drop("root")


def join_similar(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100, sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("k"), "text")
    with Workspace(docs.sparkSession, "jaccard") as work:
        named = work.keep(_named(work, d, words, num, den, sizes), "named")
        least = named.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
        out = named.join(least, "component", "left")
        return keep(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")), "components")


def keep_one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, sizes: Sizes = Sizes()) -> DataFrame:
    """The rows, with all their columns, of one document of each component: the one of smallest doc_id.

    Null ids come after all others; of rows that share the smallest id the one of smallest text hash
    stays, and of rows that share id and text any one. Documents without words are of no group: all stay.
    """
    names = docs.columns
    safe = numbered(docs)
    doc_id, text = F.col(f"c{names.index('doc_id')}").cast("long"), F.col(f"c{names.index('text')}")
    key = F.xxhash64(F.coalesce(doc_id, F.lit(-1)), doc_id.isNull(), text)
    d = safe.select(doc_id.alias("doc_id"), key.alias("k"), text.alias("text"))
    spark = docs.sparkSession
    with Workspace(spark, "jaccard") as work:
        named = work.keep(_named(work, d, words, num, den, sizes), "named")
        chosen = named.filter("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k")).alias("r"), F.count(F.lit(1)).alias("m"))
        chosen = work.keep(chosen.select(F.col("r.k").alias("kept_k"), "component", "m"), "chosen")
        goes = named.join(chosen, "component").filter("k <> kept_k").select("k").distinct()
        again = named.filter("component is not null").join(chosen.filter("m > 1").select(F.col("kept_k").alias("k")), "k").groupBy("k").count().filter("count > 1").select("k")
        gone = keep(goes.select("k", F.lit(False).alias("again")).unionByName(again.select("k", F.lit(True).alias("again"))), "gone")
    out = safe.withColumn("k", key).join(gone, "k", "left")
    if not gone.filter("again").isEmpty():  # of repeated rows one stays
        out = out.filter("again is null").unionByName(out.filter("again").dropDuplicates(["k"]))
    else:
        out = out.filter("again is null")
    return out.drop("k", "again").toDF(*names)
