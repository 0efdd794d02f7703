"""A quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Statistics are counted in numpy over the bytes of many texts at a time. Labels are learnt from a
sample of at most `most` labelled rows (those of smallest hash of doc_id, rows kept out never
among them, repeated rows one by one), so training has a fixed size; statistics and scores cover every row. Trees are grown level by
level on binned values with logistic loss, then flattened into arrays of feature, threshold, child and
value, and all rows walk all trees at once, one level at a time.

Inputs of a score are the statistics of the text and nothing else. Null texts are as empty texts;
these have statistics of 0 and get a score as any other. A null doc_id is kept out of training.
Several labels of one doc_id count as their mean, null labels do not count. With no labels at all, or of one kind
only, every score is the share of good labels (0.5 without any). Repeated rows get equal scores; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.llm.shared import LOWER, SPACED, gram_hashes, numbered, pick, portions, tidy, utf8, word_bounds, word_hashes

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "beyond": range(128, 256), "newline": [10], "space": [32, 9], "bang": b"!", "query": b"?", "stop": b".", "comma": b",", "quote": b"\"'`", "bracket": b"()[]{}<>", "sign": b"#$%&*+/=\\^_|~@", "colon": b":;", "dash": b"-"}
_KIND = np.zeros(256, np.int64)
for _k, _bytes in enumerate(_CLASSES.values(), 1):
    _KIND[list(_bytes)] = _k
NAMES = ["log_bytes", "log_words", "word_length", "longest_word", "short_words", "capital_words", "shout_words", "distinct_words", "top_word", "repeated_grams", "log_lines", "line_words", "repeated_lines", "entropy", *(f"share_{k}" for k in _CLASSES)]


def _distinct(owner: np.ndarray, h: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each owner: how many different hashes, and how often the commonest occurs."""
    if not len(h):
        return np.zeros(docs), np.zeros(docs)
    order = np.lexsort((h, owner))
    o, v = owner[order], h[order]
    new = np.concatenate([[True], (o[1:] != o[:-1]) | (v[1:] != v[:-1])])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(v)))
    top = np.zeros(docs)
    np.maximum.at(top, o[at], runs)
    return np.bincount(o[at], minlength=docs).astype(float), top


def statistics(batch: pa.RecordBatch, column: str | int = "text") -> np.ndarray:
    """float32[rows, len(NAMES)]."""
    data, offsets = utf8(batch.column(column))
    docs = len(offsets) - 1
    n = np.diff(offsets)
    owner = np.repeat(np.arange(docs), n)
    kinds = np.bincount(owner * 16 + _KIND[data], minlength=docs * 16).reshape(docs, 16)
    some = np.maximum(n, 1)
    share = kinds[:, 1:] / some[:, None]
    p = kinds / some[:, None]
    entropy = -(p * np.log(np.maximum(p, 1e-12))).sum(1)
    s, e, at = word_bounds(data, offsets, SPACED)
    words = np.diff(at)
    has = np.maximum(words, 1)
    wdoc, length = np.repeat(np.arange(docs), words), e - s
    per = lambda x: np.bincount(wdoc, weights=x, minlength=docs)
    longest = np.zeros(docs)
    np.maximum.at(longest, wdoc, length)
    first, second = data[s], data[np.minimum(s + 1, len(data) - 1)] if len(s) else data[:0]
    capital = (first >= 65) & (first <= 90)
    shout = capital & (length > 1) & (second >= 65) & (second <= 90)
    h = word_hashes(LOWER[data], s, e)
    distinct, top = _distinct(wdoc, h, docs)
    grams = gram_hashes(h, 3)
    gdoc = wdoc[: len(grams)]
    inside = gdoc == wdoc[2:] if len(grams) else np.zeros(0, bool)
    gdistinct, _ = _distinct(gdoc[inside], grams[inside], docs)
    gn = np.maximum(words - 2, 0)
    ls, le, lat = word_bounds(data, offsets, _LINE)
    lines = np.diff(lat)
    ldistinct, _ = _distinct(np.repeat(np.arange(docs), lines), word_hashes(data, ls, le), docs)
    out = [np.log1p(n), np.log1p(words), per(length) / has, np.log1p(longest), per(length <= 3) / has, per(capital) / has, per(shout) / has, distinct / has, top / has, (gn - gdistinct) / np.maximum(gn, 1), np.log1p(lines), words / np.maximum(lines, 1), (lines - ldistinct) / np.maximum(lines, 1), entropy, *share.T]
    return np.stack(out, 1).astype(np.float32)


_LINE = np.ones(256, bool)
_LINE[10] = False


# ---------------------------------------------------------------- trees


@dataclass
class Trees:
    """Nodes of all trees in one row each; a leaf is its own child."""

    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        out = np.empty(len(x))
        for a in range(0, len(x), rows):
            part = x[a : a + rows]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            at = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                node = np.where(part[at, self.feature[node]] <= self.limit[node], self.left[node], self.right[node])
            out[a : a + rows] = self.base + self.value[node].sum(1)
        return 1 / (1 + np.exp(-out))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 5, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: int = 20) -> Trees:
    mean = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or mean in (0.0, 1.0):
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        z = np.zeros(1, np.int64)
        return Trees(z, z, np.zeros(1, np.float32), z, z, np.zeros(1), 0, float(np.log(mean / (1 - mean))))
    features = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins, method="lower")).astype(np.float32) for f in range(features)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(features)])  # bin b: value <= edges[b]
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(len(y), base)
    nodes: list[list] = []  # feature, limit, left, right, value
    roots = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(len(nodes))
        nodes.append([0, np.float32(0), 0, 0, 0.0])
        where, level = np.full(len(y), roots[-1]), [roots[-1]]
        for at in range(depth + 1):
            number = np.full(len(nodes), -1)
            number[level] = np.arange(len(level))
            local = number[where]
            on = local >= 0
            if not on.any():
                break
            size = len(level)
            sg, sh = (np.bincount(local[on], weights=v[on], minlength=size) for v in (g, h))
            for k, node in enumerate(level):
                nodes[node][2] = nodes[node][3] = node
                nodes[node][4] = -rate * sg[k] / (sh[k] + l2)
            if at == depth:
                break
            best = np.full(size, 1e-6)
            split = [None] * size
            for f in range(features):
                key = local[on] * bins + binned[f][on]
                hist = [np.bincount(key, weights=v, minlength=size * bins).reshape(size, bins).cumsum(1) for v in (g[on], h[on], np.ones(int(on.sum())))]
                lg, lh, ln = (v[:, : len(edges[f])] for v in hist)
                if lg.shape[1] == 0:
                    continue
                tn = hist[2][:, -1:]
                gain = lg**2 / (lh + l2) + (sg[:, None] - lg) ** 2 / (sh[:, None] - lh + l2) - (sg**2 / (sh + l2))[:, None]
                gain[(ln < least) | (tn - ln < least)] = 0
                b = gain.argmax(1)
                v = gain[np.arange(size), b]
                for k in np.flatnonzero(v > best):
                    best[k], split[k] = v[k], (f, int(b[k]))
            following = []
            for k, node in enumerate(level):
                if split[k] is None:
                    continue
                f, b = split[k]
                nodes[node][:4] = [f, edges[f][b], len(nodes), len(nodes) + 1]
                own = where == node
                where = np.where(own, np.where(binned[f] <= b, len(nodes), len(nodes) + 1), where)
                following += [len(nodes), len(nodes) + 1]
                nodes += [[0, np.float32(0), 0, 0, 0.0], [0, np.float32(0), 0, 0, 0.0]]
            if not following:
                break
            level = following
        margin += np.array([n[4] for n in nodes])[where]
    feature, limit, left, right, value = (np.array([n[k] for n in nodes]) for k in range(5))
    return Trees(np.array(roots), feature, limit.astype(np.float32), left, right, value, depth, base)


# ---------------------------------------------------------------- over tables

HELD = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5, 0) = 0"


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row (columns doc_id, text), as one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text", 1 << 20):
                x = statistics(part)
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), values], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, x array<float>")


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> Trees:
    """Trees learnt from at most `most` labelled rows that are not held out; only their texts are measured."""
    d = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    y = pick(labels, "doc_id", "quality").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    y = y.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    # ids first, which are small; of a third of all rows under one id no more than `most` are taken either
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = d.select("doc_id").filter(f"not ({HELD})").join(y, "doc_id").orderBy(*order).limit(most).distinct()
    rows = measure(d.join(F.broadcast(chosen.select("doc_id")), "doc_id"))  # at most `most` ids
    rows = rows.join(F.broadcast(chosen), "doc_id").orderBy(*order, "x").limit(most).select("x", "y").toArrow()
    x = np.asarray(rows.column("x").combine_chunks().flatten(), np.float32).reshape(len(rows), len(NAMES)) if len(rows) else np.empty((0, len(NAMES)), np.float32)
    return train(x, (np.asarray(rows.column("y"), float) >= 0.5).astype(float))


def score_quality(docs: DataFrame, labels: DataFrame, least: float = 0.3, most: int = 20_000) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    trees = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))  # of a fixed size
    d = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text", 1 << 20):
                s = trees.value.score(statistics(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= least).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = d.mapInArrow(tidy(run), "doc_id long, score double, predicted int")
    return out.select("doc_id", F.expr(HELD).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3, most: int = 20_000) -> DataFrame:
    """The rows, with all their columns, that score `least` or more."""
    trees = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))
    safe, column = numbered(docs), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, column, 1 << 20):
                yield part.filter(pa.array(trees.value.score(statistics(part, column)) >= least))

    return safe.mapInArrow(tidy(run), safe.schema).toDF(*docs.columns)
