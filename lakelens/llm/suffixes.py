"""Exact removal of repeated byte strings by a distributed difference-cover suffix array.

A byte goes if a string of LENGTH bytes that covers it starts at any other place too, in the same
or another text. Strings are judged on the input and never cross texts; overlaps count.

To sort all suffixes of a corpus would move it many times over, so suffixes are sorted where a
repeat is possible at all, and by buckets that hold every candidate partner:

1. Equal texts are one text from here on; if there are two of them, all its bytes go.
2. Every string of LENGTH bytes is owned by one anchor: the smallest hash of the K-byte strings in
   it. Equal strings have equal anchors at equal places. An anchor that occurs once owns no repeat.
   Where anchors occur again with the very same surroundings, all strings they own repeat.
3. What is left are anchors that occur again in other surroundings. These surroundings are sent to
   the task of their anchor, which sorts their suffixes: triples at the difference cover {1, 2}
   modulo 3 are sorted and named, the sequence of names is sorted by recursion, the remaining
   suffixes are merged in, and neighbours whose first LENGTH bytes are equal are repeats.
   Anchors with more than HOT kinds of surroundings are not sorted in one task: their strings are
   counted by hash, combined before the shuffle.
4. Spans go back to the texts, which are stored bucketed and so are shuffled once.

Null texts are empty. Texts shorter than LENGTH keep all bytes. Rows that repeat a doc_id, or a
text, each get a result. An empty table gives no rows. Strings are told apart by 64-bit hashes and,
in step 3, by the order of their bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.llm.shared import U64, Prefix, keep, mix, pick, portions, ranges, scratch, utf8

LENGTH, K, HOT = 200, 32, 4096
#: Bytes of one text that are hashed at a time, and of surroundings that are sorted at a time.
BLOCK, SORTED = 4 << 20, 2 << 20


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Places of the suffixes of positive integers in their order, by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 8:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    n0, n1, n2 = (n + 2) // 3, (n + 1) // 3, n // 3
    t = np.zeros(n + 4, np.int64)
    t[:n] = s
    big = int(t.max()) + 1
    cover = np.concatenate([np.arange(1, n + (n0 - n1), 3), np.arange(2, n, 3)])
    pair = t[cover] * big + t[cover + 1]
    if big > 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    kinds, name = np.unique(pair * big + t[cover + 2], return_inverse=True)
    rank = np.zeros(n + 4, np.int64)
    if len(kinds) == len(cover):
        order = np.argsort(name)
    else:
        order = suffix_array(name + 1)
    rank[cover[order]] = np.arange(1, len(cover) + 1)
    covered = cover[order]
    covered = covered[covered < n]
    rest = np.arange(0, n, 3)
    m = len(cover) + 2
    rest = rest[np.argsort(t[rest] * m + rank[rest + 1], kind="stable")]
    one, two = covered[covered % 3 == 1], covered[covered % 3 == 2]
    before = np.searchsorted(t[one] * m + rank[one + 1], t[rest] * m + rank[rest + 1])
    both = np.concatenate([two, rest])
    head = np.unique(t[both] * big + t[both + 1], return_inverse=True)[1]
    key = head * m + rank[both + 2]
    before += np.searchsorted(key[: len(two)], key[len(two) :])
    out = np.empty(n, np.int64)
    at = np.arange(len(rest)) + before
    out[at] = rest
    free = np.ones(n, bool)
    free[at] = False
    out[free] = covered
    return out


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all strings of LENGTH bytes inside the texts: runs with one anchor, as first start, last start, anchor, its hash and the hash of all bytes of the run."""
    w = LENGTH - K + 1
    n = len(data) - LENGTH + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, U64),) * 2
    prefix = Prefix(data)
    at = np.arange(len(data) - K + 1)
    h = prefix.hashes(at, at + K)
    key = (h & ~U64((1 << 24) - 1)) | (U64((1 << 24) - 1) - at.astype(U64))  # the last of equal ones
    pad = -len(key) % w
    padded = np.concatenate([key, np.full(pad, ~U64(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(back[:n], ahead[w - 1 : w - 1 + n])
    inside = np.zeros(n, bool)
    length = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    inside[ranges(offsets[:-1], length)] = True
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (low[1:] != low[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    end = np.append(np.flatnonzero(new | ~inside), n)
    last = end[np.searchsorted(end, first, side="right")] - 1
    a = ((1 << 24) - 1) - (low[first] & U64((1 << 24) - 1)).astype(np.int64)
    return first, last, a, h[a], mix(prefix.hashes(first, last + LENGTH) ^ (a - first).astype(U64))


_ROW = "r long, kind int, whole long, key binary, first long, last long"
_KEYS = [x.split()[0] for x in _ROW.split(", ")]
MET, DONE, ASKED, SOURCE, STRINGS = range(5)


def _rows(r: np.ndarray, kind: np.ndarray, whole: np.ndarray, key: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    signed = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
    keys = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(np.arange(0, 16 * len(key) + 1, 16, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(key))])
    return pa.RecordBatch.from_arrays([signed(r), pa.array(kind.astype(np.int32)), signed(whole), keys, pa.array(first.astype(np.int64)), pa.array(last.astype(np.int64))], names=_KEYS)


def _key_array(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(utf8(column)[0]).view("V16")


def _copies(r: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have an equal (r, whole) elsewhere, and which are the first of theirs."""
    order = np.lexsort((whole, r))
    a, b = r[order], whole[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    again, first = np.zeros(len(r), bool), np.ones(len(r), bool)
    again[order[1:]] = same
    again[order[:-1]] |= same
    first[order[1:]] = ~same
    return again, first


def find_anchors(texts: DataFrame) -> DataFrame:
    """Anchors to compare (MET; of equal ones in a portion the first, as SOURCE) and runs found to repeat at once (DONE, dealt anywhere)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text", BLOCK):
                keys = _key_array(part.column("key"))
                data, offsets = utf8(part.column("text"))
                for at in range(0, max(1, len(data) - LENGTH + 1), BLOCK):  # a long text in blocks that share LENGTH - 1 bytes
                    block = data[at : at + BLOCK + LENGTH - 1]
                    inside = np.clip(offsets - at, 0, len(block))
                    first, last, a, h, whole = anchors(block, inside)
                    if not len(first):
                        continue
                    doc = np.searchsorted(offsets, first + at, side="right") - 1
                    base = offsets[doc] - at
                    again, one = _copies(h, whole)
                    kind = np.where(again, SOURCE, MET)
                    yield _rows(h[one], kind[one], whole[one], keys[doc][one], (first - base)[one], (last - base)[one])
                    if again.any():
                        first, last, key = (first - base)[again], (last - base)[again], keys[doc][again]
                        yield _rows(mix(whole[again] ^ first.astype(U64)), np.full(len(first), DONE), whole[again], key, first, last)

    return texts.select("key", "text").mapInArrow(run, _ROW)


def _classes(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Whole classes of rows sorted by r, some at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            t = pa.Table.from_batches(held).combine_chunks()
            r = t.column("r").to_numpy()
            cut = int(np.searchsorted(r, r[-1]))
            if cut:
                yield t.slice(0, cut)
            held, size = t.slice(cut).to_batches(), 0
    if held:
        t = pa.Table.from_batches(held)
        if len(t):
            yield t.combine_chunks()


def meet_anchors(found: DataFrame) -> DataFrame:
    """DONE runs; and for anchors with several surroundings those ASKED for, those that are a SOURCE only, or STRINGS where there are too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _classes(batches, 8 << 20):
            b = t.combine_chunks().to_batches()[0]
            r, whole = (np.asarray(b.column(c)).view(U64) for c in ("r", "whole"))
            kind, first, last = (np.asarray(b.column(c)) for c in ("kind", "first", "last"))
            key = _key_array(b.column("key"))
            done = kind == DONE
            if done.any():
                yield _rows(r[done], kind[done], whole[done], key[done], first[done], last[done])
            r, whole, kind, first, last, key = (x[~done] for x in (r, whole, kind, first, last, key))
            if not len(r):
                continue
            again, one = _copies(r, whole)
            done = again & (kind == MET)
            number = np.unique(r, return_inverse=True)[1]
            several = np.bincount(number[one])[number]
            if done.any():
                yield _rows(r[done], np.full(int(done.sum()), DONE), whole[done], key[done], first[done], last[done])
            ask = one & (several > 1)
            if ask.any():
                new = np.where(several[ask] > HOT, STRINGS, np.where(again[ask] | (kind[ask] == SOURCE), SOURCE, ASKED))
                yield _rows(r[ask], new, whole[ask], key[ask], first[ask], last[ask])

    return found.repartition("r").sortWithinPartitions("r").mapInArrow(run, _ROW)


_CONTEXT = "r long, kind int, key binary, first long, n long, bytes binary"


def surroundings(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """The bytes of every run asked for; for STRINGS the hash of every string, as r."""
    lists = asked.groupBy("key").agg(F.collect_list(F.struct("r", "kind", "first", "last")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text", BLOCK):
                data, offsets = utf8(part.column("text"))
                runs = part.column("runs")
                many = np.diff(np.asarray(runs.offsets))
                flat = runs.flatten()
                r, kind, first, last = (np.asarray(flat.field(k)) for k in range(4))
                key = np.repeat(_key_array(part.column("key")), many)
                start = np.repeat(offsets[:-1], many)
                plain = kind != STRINGS
                if plain.any():
                    n = last[plain] - first[plain] + LENGTH
                    body = data[ranges(start[plain] + first[plain], n)]
                    bytes_ = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(n)]).astype(np.int64)), pa.py_buffer(body)]).cast(pa.binary())
                    yield _context(r[plain], kind[plain], key[plain], first[plain], last[plain] - first[plain] + 1, bytes_)
                if (~plain).any():
                    n = last[~plain] - first[~plain] + 1
                    p = ranges(first[~plain], n)
                    from_ = np.repeat(start[~plain], n) + p
                    low = int(from_.min())
                    h = Prefix(data[low : int(from_.max()) + LENGTH]).hashes(from_ - low, from_ - low + LENGTH)
                    again, one = _copies(h, h)
                    owner = np.repeat(key[~plain], n)
                    kinds = np.where(again, SOURCE, STRINGS)
                    yield _context(h[one].view(np.int64), kinds[one], owner[one], p[one], np.ones(int(one.sum()), np.int64), None)
                    if again.any():
                        yield _context(mix(h[again] ^ p[again].astype(U64)).view(np.int64), np.full(int(again.sum()), DONE), owner[again], p[again], np.ones(int(again.sum()), np.int64), None)

    return texts.select("key", "text").join(lists, "key").mapInArrow(run, _CONTEXT)


def _context(r: np.ndarray, kind: np.ndarray, key: np.ndarray, first: np.ndarray, n: np.ndarray, bytes_: pa.Array | None) -> pa.RecordBatch:
    base = _rows(r, kind, r, key, first, n)
    return pa.RecordBatch.from_arrays([base.column(0), base.column(1), base.column(3), base.column(4), base.column(5), pa.nulls(len(r), pa.binary()) if bytes_ is None else bytes_], names=[x.split()[0] for x in _CONTEXT.split(", ")])


def sort_surroundings(sent: DataFrame) -> DataFrame:
    """(key, first, last) of the runs of starts whose strings repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _classes(batches, SORTED):
            b = t.combine_chunks().to_batches()[0]
            kind, first, n = (np.asarray(b.column(c)) for c in ("kind", "first", "n"))
            key, plain = _key_array(b.column("key")), ~np.asarray(b.column("bytes").is_null())
            if not plain.all():
                r = np.asarray(b.column("r")).view(U64)
                again, _ = _copies(np.where(plain, mix(r ^ U64(1)), r), np.arange(len(r), dtype=U64) * plain)
                hit = ~plain & ((kind == DONE) | again & (kind == STRINGS))
                yield _spans(key[hit], first[hit], first[hit])
            if plain.any():
                k = np.flatnonzero(plain)
                body, at = utf8(b.column("bytes").take(pa.array(k)))
                sa = suffix_array(np.insert(body.astype(np.int64) + 2, at[1:], 1))  # a mark after each
                at = at + np.arange(len(at))
                own = np.zeros(len(body) + len(k), bool)
                own[ranges(at[:-1], n[k])] = True
                sa = sa[own[sa]]
                h = Prefix(np.insert(body, at[1:-1] - np.arange(1, len(at) - 1), 0)).hashes(sa, sa + LENGTH)
                same = np.concatenate([[False], h[1:] == h[:-1], [False]])
                hit = np.sort(sa[same[1:] | same[:-1]])
                if len(hit):
                    owner = np.searchsorted(at, hit, side="right") - 1
                    new = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (owner[1:] != owner[:-1])]))
                    lo, hi, owner = hit[new], hit[np.append(new[1:], len(hit)) - 1], owner[new]
                    want = kind[k][owner] == ASKED
                    move = first[k][owner] - at[owner]
                    yield _spans(key[k][owner][want], (lo + move)[want], (hi + move)[want])

    return sent.repartition("r").sortWithinPartitions("r").mapInArrow(run, "key binary, first long, last long")


def _spans(key: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    base = _rows(first, first, first, key, first, last)
    return pa.RecordBatch.from_arrays([base.column(3), base.column(4), base.column(5)], names=["key", "first", "last"])


def cut_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """key, n_removed, n_spans, kept_sha256 of every text with something to remove."""
    lists = spans.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            removed, count, digest = [], [], []
            runs = batch.column("runs")
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                flat = runs[i].values
                first, last = np.asarray(flat.field(0)), np.asarray(flat.field(1)) + LENGTH
                order = np.argsort(first)
                first, last = first[order], np.maximum.accumulate(last[order])
                new = np.concatenate([[True], first[1:] > last[:-1]])
                first, last = first[new], last[np.append(np.flatnonzero(new)[1:], len(last)) - 1]
                sha, at = hashlib.sha256(), 0
                for a, z in zip(first.tolist(), last.tolist(), strict=True):
                    sha.update(text[at:a].tobytes())
                    at = z
                sha.update(text[at:].tobytes())
                removed.append(int((last - first).sum())), count.append(len(first)), digest.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())], names=["key", "n_removed", "n_spans", "kept_sha256"])

    return texts.select("key", "text").join(lists, "key").mapInArrow(run, "key binary, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha"))
    d = d.withColumn("key", F.expr("unhex(substring(sha, 1, 32))"))
    name = f"texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    unique = d.filter(f"n_bytes >= {LENGTH}").groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    unique.write.bucketBy(buckets, "key").option("path", scratch(spark, "texts")).option("compression", "zstd").saveAsTable(name)
    spark._jvm.System.gc()
    texts = spark.table(name)
    met = keep(meet_anchors(find_anchors(texts)), "anchors")
    sent = surroundings(texts, met.filter(F.col("kind") != DONE))
    sorted_ = keep(sort_surroundings(sent), "spans")
    spans = met.filter(F.col("kind") == DONE).select("key", "first", "last").unionByName(sorted_)
    single = texts.filter("copies = 1")
    cut = keep(cut_spans(single, spans).unionByName(texts.filter("copies > 1").select("key", F.octet_length("text").cast("long"), F.lit(1).cast("long"), F.sha2(F.lit("").cast("binary"), 256)).toDF("key", "n_removed", "n_spans", "kept_sha256")), "cut")
    out = d.select("doc_id", "n_bytes", "key", "sha").join(cut, "key", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
