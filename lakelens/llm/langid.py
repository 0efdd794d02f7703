"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

A text's subwords are the byte sequences of 2 to 4 within its words, word borders included, with
capitals lowered; each falls into one of BUCKETS buckets, and the text is the average of their
embeddings. Embeddings and the softmax over languages are learnt together by stochastic gradient
descent in numpy (steps scaled for each bucket by its past gradients), in rounds: each of PARTS
parts of the sample learns by itself from the same weights, then the weights are averaged. What
is gathered are PARTS sets of weights of a fixed size.

The sample holds about ``most`` different labelled texts that are not held out, as many of each
language as there are, up to an equal share. Copies count once, so a text that a third of all rows
share is one of them. A tenth of the sample is kept from learning to calibrate: a temperature that
makes scores probabilities, and the least score at which accepted predictions are right often
enough (``right``); texts that score less are marked rejected, and keep their prediction.

Texts are read whole, in portions of bounded size, however long. A null text, and one without a
letter, is ``und`` with score 0 and rejected; so is every text if there is nothing to learn from.
Ties go to the language that sorts first. Rows that repeat a doc_id are predicted each for itself;
a null doc_id is held out. Extra columns are ignored, whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.llm.shared import LOWER, Batches, Workspace, pick, portions, tidy, utf8

BUCKETS = 1 << 15
WIDTH = 16
PARTS = 8
ORDERS = (2, 3, 4)
HELD = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5, 0) = 0"

_SPREAD = {2: np.uint32(0x9E3779B1), 3: np.uint32(0x85EBCA77), 4: np.uint32(0xC2B2AE3D)}
#: Bytes of words: ASCII letters and everything beyond ASCII.
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _plain(data: np.ndarray) -> np.ndarray:
    """Capitals of ASCII and of Latin letters with accents lowered, bytes outside of words as a space."""
    low = LOWER[data]
    if len(low) > 1:
        accent = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][accent] += 0x20
    return np.where(_INSIDE[low], low, np.uint8(0x20))


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of all texts, and each text's range in them."""
    n, texts = len(data), len(offsets) - 1
    # a space before and after every text, so that no subword crosses texts
    owner = np.repeat(np.arange(texts), np.diff(offsets))
    low = np.full(n + texts + 1, 0x20, np.uint8)
    low[np.arange(n) + owner + 1] = _plain(data)
    starts = offsets[:-1] + np.arange(texts)
    space = low == 0x20
    found, where = [], []
    for k in ORDERS:
        m = len(low) - k + 1
        if m <= 0:
            continue
        if k == 2:
            good = ~(space[:m] & space[1:])
        else:  # a space stands only at either end
            good = ~space[1 : 1 + m]
            for i in range(2, k - 1):
                good &= ~space[i : i + m]
        at = np.flatnonzero(good)
        key = np.full(len(at), k, np.uint32)
        for i in range(k):
            key = (key << np.uint32(8)) ^ low[at + i] ^ (key >> np.uint32(24))
        key *= _SPREAD[k]
        found.append((key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17))
        where.append(at)
    if not found:
        return np.empty(0, np.int64), np.zeros(texts + 1, np.int64)
    at = np.concatenate(where)
    text = np.searchsorted(starts, at, side="right") - 1
    order = np.argsort(text, kind="stable")
    return np.concatenate(found)[order].astype(np.int64), np.searchsorted(text[order], np.arange(texts + 1))


def shares(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of each text in order, their shares of its subwords, and each text's range in them."""
    buckets, at = subwords(data, offsets)
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    key, times = np.unique(owner * BUCKETS + buckets, return_counts=True)
    text = key // BUCKETS
    return key % BUCKETS, (times / n[text]).astype(np.float32), np.searchsorted(text, np.arange(len(n) + 1))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Weights:
    embed: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    past_embed: np.ndarray
    past_out: np.ndarray

    @classmethod
    def new(cls, languages: int, seed: int = 13) -> Weights:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 1, (BUCKETS, WIDTH)).astype(np.float32), np.zeros((WIDTH, languages), np.float32), np.zeros(languages, np.float32), np.full(BUCKETS, 1e-6, np.float32), np.full((WIDTH, languages), 1e-4, np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.out, self.bias, self.past_embed, self.past_out]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def filled(self, flat: np.ndarray) -> Weights:
        made, at = [], 0
        for a in self.arrays():
            made.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Weights(*made)


def learn(w: Weights, buckets: np.ndarray, share: np.ndarray, at: np.ndarray, y: np.ndarray, step: float = 0.3, size: int = 16) -> None:
    """One pass over the texts in the order given, `size` of them a step; changes the weights in place."""
    for a in range(0, len(y), size):
        b = min(a + size, len(y))
        ids, x = buckets[at[a] : at[b]], share[at[a] : at[b], None]
        n = np.diff(at[a : b + 1])
        full = np.flatnonzero(n)
        if not len(full):
            continue
        hidden = np.add.reduceat(w.embed[ids] * x, at[a:b][full] - at[a], axis=0)
        p = _softmax(hidden @ w.out + w.bias)
        p[np.arange(len(full)), y[a:b][full]] -= 1
        p /= len(full)
        back = p @ w.out.T
        grad = hidden.T @ p
        w.past_out += grad**2
        w.out -= step * grad / np.sqrt(w.past_out)
        w.bias -= step * 0.1 * p.sum(axis=0)
        each = np.repeat(back, n[full], axis=0) * x
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.diff(ids[order], prepend=-1))
        kinds, total = ids[order][first], np.add.reduceat(each[order], first, axis=0)
        w.past_embed[kinds] += (total**2).mean(axis=1)
        w.embed[kinds] -= step * total / np.sqrt(w.past_embed[kinds])[:, None]


@dataclass
class Model:
    """Languages in order, each bucket's logits (embedding times softmax weights), and the calibration."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Average logits of every text; long texts are read in pieces that share their last bytes."""
        texts = len(offsets) - 1
        sums, n = np.zeros((texts, len(self.languages))), np.zeros(texts)
        if texts == 1 and len(data) > PIECE:
            at = 0
            while at < len(data):
                end = min(at + PIECE, len(data))
                while end < len(data) and _INSIDE[LOWER[data[end]]] and end - at < 2 * PIECE:
                    end += 1  # pieces end where words end, but for words beyond all measure
                ids, _ = subwords(data[at:end], np.array([0, end - at]))
                sums[0] += np.bincount(ids, minlength=BUCKETS) @ self.table
                n[0] += len(ids)
                at = end
        else:
            ids, at = subwords(data, offsets)
            n = np.diff(at)
            full = np.flatnonzero(n)
            if len(full):
                sums[full] = np.add.reduceat(self.table[ids], at[:-1][full], axis=0)
        return sums / np.maximum(n, 1)[:, None] + self.bias

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language and its probability."""
        p = _softmax(self.logits(data, offsets) / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(best)), best]


PIECE = 1 << 22


def sample(docs: DataFrame, most: int) -> DataFrame:
    """lang, text and key of about `most` different labelled texts that are not held out, an equal share of each language."""
    d = pick(docs, "doc_id", "text", "lang").filter(f"lang is not null and text is not null and not ({HELD})").select("lang", "text")
    d = d.filter(F.col("text").rlike(r"\p{L}")).withColumn("key", F.xxhash64("text"))
    # languages with counts, of which there may be many; only what is sampled leaves Spark
    sizes = d.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("n"))
    sizes = sizes.join(F.broadcast(sizes.agg(F.count(F.lit(1)).alias("kinds"))))
    part = F.least(F.lit(1.0), F.lit(float(most)) / F.col("kinds") / F.col("n"))
    chosen = d.join(F.broadcast(sizes.select("lang", part.alias("part"))), "lang") if sizes.count() <= most else d.join(sizes.select("lang", part.alias("part")), "lang")
    # the key's low 30 bits decide, the next three say which tenth it is and the rest deal out parts
    chosen = chosen.filter(F.col("key").bitwiseAND(F.lit((1 << 30) - 1)) < F.col("part") * F.lit(1 << 30))
    return chosen.groupBy("lang", "key").agg(F.first("text").alias("text"))


def _texts(batches: Batches):
    for batch in batches:
        for part in portions(batch, "text", 1 << 18):
            yield part, *utf8(part.column("text"))


def _measured(rows: DataFrame) -> DataFrame:
    """lang and key of every row, with the distinct buckets of its text and their shares: BUCKETS of both at most."""

    def run(batches: Batches) -> Batches:
        for part, data, offsets in _texts(batches):
            ids, share, at = shares(data, offsets)
            lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x)) for x in (ids.astype(np.int32), share)]
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("key"), *lists], names=["lang", "key", "ids", "share"])

    return rows.mapInArrow(tidy(run), "lang string, key long, ids array<int>, share array<float>")


def _bags(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, share = batch.column("ids"), batch.column("share")
    at = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(ids)))]).astype(np.int64)
    return np.asarray(ids.flatten()).astype(np.int64), np.asarray(share.flatten()), at


def fit(docs: DataFrame, most: int = 20_000, rounds: int = 3, right: float = 0.99) -> Model | None:
    """The model, or None if there is nothing to learn from."""
    spark = docs.sparkSession
    with Workspace(spark, "langid") as work:
        rows = work.keep(_measured(sample(docs, most)), "sample")
        found = sorted(r["lang"] for r in rows.select("lang").distinct().collect())  # at most as many as the sample has rows
        if not found:
            return None
        number = {x: i for i, x in enumerate(found)}
        tenth = F.pmod(F.shiftright("key", 33), F.lit(10)) == 0
        learnt = rows.filter(~tenth)
        if not learnt.take(1):
            learnt = rows
        learnt = work.keep(learnt.repartition(PARTS, F.pmod(F.shiftright("key", 40), F.lit(PARTS))).sortWithinPartitions(F.xxhash64("key"), "lang"), "learnt")
        weights = Weights.new(len(found))
        for turn in range(rounds):
            sent = work.send(weights)

            def run(batches: Batches, sent=sent, turn=turn) -> Batches:
                w, seen = sent.value.filled(sent.value.flat()), 0
                for batch in batches:
                    y = np.array([number[x] for x in batch.column("lang").to_pylist()])
                    learn(w, *_bags(batch), y, step=0.3 / (1 + turn))
                    seen += len(y)
                if seen:
                    yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([w.flat().tobytes()], pa.binary())], names=["seen", "w"])

            got = learnt.mapInArrow(run, "seen long, w binary").collect()  # a row of a fixed size for each file of PARTS
            total = sum(r["seen"] for r in got)
            weights = weights.filled(sum(np.frombuffer(r["w"], np.float32) * np.float32(r["seen"] / total) for r in got))
        model = Model(found, (weights.embed @ weights.out).astype(np.float32), weights.bias)
        sent = work.send(model)

        def measure(batches: Batches) -> Batches:
            for batch in batches:
                ids, share, at = _bags(batch)
                x = np.zeros((batch.num_rows, len(found)))
                full = np.flatnonzero(np.diff(at))
                x[full] = np.add.reduceat(sent.value.table[ids] * share[:, None], at[:-1][full], axis=0) if len(full) else 0
                x += sent.value.bias
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([number[z] for z in batch.column("lang").to_pylist()], pa.int32()), flat], names=["y", "x"])

        held = rows.filter(tenth).mapInArrow(measure, "y int, x array<double>").toArrow()  # about a tenth of `most` rows
        if len(held):
            x = np.asarray(held.column("x").combine_chunks().flatten()).reshape(len(held), len(found))
            model.temperature, model.least = calibrate(x, np.asarray(held.column("y")), right)
        return model


def calibrate(x: np.ndarray, y: np.ndarray, right: float) -> tuple[float, float]:
    """The temperature of least log loss, and the least score from which on a share of `right` is right."""
    rows = np.arange(len(y))

    def loss(t: float) -> float:
        p = np.maximum(_softmax(x / t), 1e-12)
        # as if two more rows had been seen, one of them wrong: rows that are all right make no score certain
        return -((len(y) + 1) * np.log(p[rows, y]) + np.log(1 - np.minimum(p[rows, y], 1 - 1e-12))).mean()

    t = min(np.geomspace(0.02, 20, 61), key=loss)
    p = _softmax(x / t)
    best = p.argmax(axis=1)
    score = p[rows, best]
    order = np.argsort(-score, kind="stable")
    share = np.cumsum((best == y)[order]) / np.arange(1, len(y) + 1)
    enough = np.flatnonzero(share >= right)
    return float(t), float(score[order][enough[-1]]) if len(enough) else 1.0


def identify(docs: DataFrame, most: int = 20_000, right: float = 0.99) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row."""
    model = fit(docs, most, right=right)
    d = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    d = d.withColumn("letters", letters)
    if model is None:
        out = d.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        sent = d.sparkSession.sparkContext.broadcast(model)  # BUCKETS times the languages

        def run(batches: Batches) -> Batches:
            m = sent.value
            names = np.array(m.languages, object)
            for part, data, offsets in _texts(batches):
                best, score = m.predict(data, offsets)
                there = np.asarray(part.column("letters"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.where(there, names[best], "und"), pa.string()), pa.array(np.where(there, score, 0.0))], names=["doc_id", "lang_pred", "score"])

        out = d.mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")
    least = model.least if model else 1.0
    return out.select("doc_id", F.expr(HELD).alias("held_out"), "lang_pred", "score", (F.col("score") < F.lit(least)).alias("rejected") if model else F.lit(True).alias("rejected"))
