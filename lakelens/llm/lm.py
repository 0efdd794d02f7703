"""Scoring of texts by a language model: a gated recurrent network over frequent words, counts for the others.

Tokens are words up to ASCII white space, A-Z lowered, and one end for each text. All tokens of all training
texts (crc32 of doc_id as text, modulo 10, not 0; a null doc_id is kept out) are counted, so N and V cover
the corpus. The network predicts the WORDS - 1 most frequent tokens, in classes of a factored softmax,
and one that stands for the rest; a token of the rest has its share of theirs by counts,
(c + 0.1) / (rest + 0.1 * (kinds + 1)). That makes `score` a log10 probability of the whole text.

The network learns from all training texts, `rounds` times each. A pass has `every` turns, and each text is
learnt from in one of them, by its doc_id. Tasks learn side by side, each from the texts it reads; after each
turn their weights are averaged (sums are made by parts of the weights, not on the driver). Counts of the FREQUENT most frequent tokens at most are
broadcast; all others are joined by token, after each text's own are summed up.

Null and empty texts have just the end. Rows that repeat a doc_id are scored each for itself, and
count each in training. Without training texts N and V are 0 and every token is unknown. An empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.llm import gru
from lakelens.llm.shared import LOWER, SPACED, U64, keep, pick, portions, utf8, word_bounds, word_hashes

END = U64(0x0E4D0E4D0E4D0E4D)
FREQUENT = 1 << 18
#: Leading bits of a hash by which it is looked up.
INDEX = 20
#: Bytes of text whose sequences run side by side.
SIDE = 24 << 20
PARTS = 16


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, with their ends, and the texts' offsets."""
    data, offsets = utf8(batch.column("text"))
    low = LOWER[data]
    s, e, at = word_bounds(low, offsets, SPACED)
    out = np.insert(word_hashes(low, s, e), at[1:], END)
    return out, at + np.arange(len(at))


def held_out(ids: list[int | None]) -> np.ndarray:
    return np.array([i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i in ids], bool)


def turns(ids: list[int | None], every: int) -> np.ndarray:
    """The turn of a pass, 0 to `every` - 1, in which each text is learnt from; -1 if it is held out."""
    return np.where(held_out(ids), -1, [zlib.crc32(str(i).encode()) // 10 % every for i in ids])


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, c) over all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merge() -> tuple[np.ndarray, np.ndarray]:
            h, c = (np.concatenate(x) for x in zip(*held, strict=True))
            keys, where = np.unique(h, return_inverse=True)
            return keys, np.bincount(where, weights=c).astype(np.int64)

        def flush() -> pa.RecordBatch:
            h, c = merge()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["token", "c"])

        for batch in batches:
            for part in portions(batch, "text"):
                h, at = tokens(part)
                train = np.repeat(~held_out(part.column("doc_id").to_pylist()), np.diff(at))
                keys, c = np.unique(h[train], return_counts=True)
                held.append((keys, c))
                size += len(keys)
                if size > 1 << 21:
                    held = [merge()]
                    size = len(held[0][0])
                    if size > 1 << 20:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return keep(docs.mapInArrow(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")), "counts")


@dataclass
class Vocabulary:
    """The most frequent tokens in order of their hash, with their counts and words of the network."""

    hashes: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    word_counts: np.ndarray
    total: int
    kinds: int
    rest: int
    rest_kinds: int

    def __post_init__(self) -> None:
        # where hashes of each beginning start, and values with a last one for what is not there
        self.starts = np.searchsorted(self.hashes >> U64(64 - INDEX), np.arange((1 << INDEX) + 1, dtype=U64)).astype(np.int32)
        self.counts_ = np.append(self.counts, 0)
        self.words_ = np.append(self.words, gru.WORDS - 1)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each is frequent, its count, its word."""
        if not len(self.hashes):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64), np.full(len(h), gru.WORDS - 1)
        cell = (h >> U64(64 - INDEX)).astype(np.int64)
        k = np.take(self.starts, cell)
        on = np.take(self.hashes, k, mode="clip") == h
        more = np.flatnonzero(~on)
        more = more[k[more] + 1 < np.take(self.starts, cell[more] + 1)]
        while len(more):  # a few hashes begin alike
            k[more] += 1
            got = self.hashes[k[more]] == h[more]
            on[more[got]] = True
            more = more[~got]
            more = more[k[more] + 1 < np.take(self.starts, cell[more] + 1)]
        k = np.where(on, k, len(self.hashes))
        return on, np.take(self.counts_, k), np.take(self.words_, k)


def vocabulary(counts: DataFrame) -> Vocabulary:
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    level = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")
    sizes = {r["level"]: r["n"] for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 8 a doubling
    taken, least = 0, None
    for x in sorted(sizes, reverse=True):
        if taken + sizes[x] > FREQUENT:
            break
        taken, least = taken + sizes[x], x
    rows = counts.filter(level >= least).toArrow() if least is not None else None
    h = np.asarray(rows.column("token")).view(U64) if rows else np.empty(0, U64)
    c = np.asarray(rows.column("c")) if rows else np.empty(0, np.int64)
    order = np.argsort(h)
    h, c = h[order], c[order]
    top = np.lexsort((h, -c))[: gru.WORDS - 1]
    words, word_counts = np.full(len(h), gru.WORDS - 1), np.zeros(gru.WORDS)
    words[top] = np.arange(len(top))
    word_counts[: len(top)] = c[top]
    rest = int(total - c[top].sum())
    word_counts[-1] = rest
    return Vocabulary(h, c, words, word_counts, int(total), int(kinds), rest, int(kinds) - len(top))


def learn(docs: DataFrame, v, counts: np.ndarray, every: int, rounds: int) -> np.ndarray:
    """The averaged weights of the network."""
    spark = docs.sparkSession
    weights = gru.Net.new().with_counts(counts).flat()
    for turn in range(rounds * every):
        sent = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            net = gru.Net.of(sent.value)
            adam, seen = gru.Adam(net), 0
            for batch in batches:
                for part in portions(batch, "text", SIDE):
                    part = part.filter(pa.array(turns(part.column("doc_id").to_pylist(), every) == turn % every))
                    if part.num_rows:
                        h, at = tokens(part)
                        _, _, ids = v.value.find(h)
                        seen += gru.train(net, ids, at, adam)
            if seen:
                parts = np.array_split(net.flat().astype(np.float64) * seen, PARTS)
                yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([seen] * PARTS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "seen", "w"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for part, seen, w in zip(batch.column("part").to_pylist(), batch.column("seen").to_pylist(), batch.column("w"), strict=True):
                    had = sums.setdefault(part, [0, 0.0])
                    had[0], had[1] = had[0] + seen, had[1] + np.frombuffer(w.as_buffer(), np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s for s, _ in sums.values()], pa.int64()), pa.array([(w / s).tobytes() for s, w in sums.values()], pa.binary())], names=["part", "seen", "w"])

        schema = "part int, seen long, w binary"
        rows = docs.mapInArrow(run, schema).repartition(PARTS, "part").mapInArrow(add, schema).collect()  # PARTS rows, the weights once
        if len(rows) == PARTS:
            weights = np.concatenate([np.frombuffer(r["w"], np.float64) for r in sorted(rows, key=lambda r: r["part"])]).astype(np.float32)
    return weights


_ROW = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, net double, others array<struct<token: long, n: long>>"


def score_texts(docs: DataFrame, every: int = 2, rounds: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    d = pick(docs, "doc_id", "text")
    d = d.withColumn("doc_id", F.col("doc_id").cast("long"))
    context = d.sparkSession.sparkContext
    counts = count_tokens(d)
    found = vocabulary(counts)
    v = context.broadcast(found)  # FREQUENT tokens at most
    net = context.broadcast(learn(d, v, found.word_counts, every, rounds))
    whole, rest = found.total + 0.1 * (found.kinds + 1), found.rest + 0.1 * (found.rest_kinds + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, done = gru.Net.of(net.value), TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in portions(batch, "text", SIDE):
                h, at = tokens(part)
                docs_, n = part.num_rows, np.diff(at)
                on, c, ids = v.value.find(h)
                owner = np.repeat(np.arange(docs_), n)
                per = lambda x, at_: np.bincount(at_, weights=x, minlength=docs_)
                base = per(np.log10((c[on] + 0.1) / whole), owner[on])
                net_score = model.score(ids, at) / np.log(10)
                few = on & (ids == gru.WORDS - 1)
                net_score += per(np.log10((c[few] + 0.1) / rest), owner[few])
                # each text's own other tokens, once each
                o, t = owner[~on], h[~on]
                order = np.lexsort((t, o))
                o, t = o[order], t[order]
                new = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (t[1:] != t[:-1])])) if len(o) else np.empty(0, np.int64)
                many = np.diff(np.append(new, len(o)))
                ends = np.searchsorted(o[new], np.arange(docs_ + 1)).astype(np.int32)
                others = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(t[new].view(np.int64)), pa.array(many.astype(np.int64))], names=["token", "n"]))
                yield pa.RecordBatch.from_arrays([pa.array(done + np.arange(docs_)), part.column("doc_id"), pa.array(held_out(part.column("doc_id").to_pylist())), pa.array(n.astype(np.int64)), pa.array(per(c[on] > 0, owner[on]).astype(np.int64)), pa.array(base), pa.array(net_score), others], names=["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "net", "others"])
                done += docs_

    rows = keep(d.mapInArrow(run, _ROW), "scored")
    others = rows.select("uid", F.explode("others").alias("o")).select("uid", "o.token", "o.n").join(counts, "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    summed = others.groupBy("uid").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"), F.sum(F.col("n") * F.log10((F.col("c") + F.lit(0.1)) / F.lit(whole))).alias("more"), F.sum(F.col("n") * F.log10((F.col("c") + F.lit(0.1)) / F.lit(rest))).alias("more_net"))
    out = rows.drop("others").join(summed, "uid", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", plus("n_known", "known").alias("n_known"), F.lit(found.total).cast("long").alias("train_tokens"), plus("base", "more").alias("base_score"), plus("net", "more_net").alias("score"))
