"""Vectors of texts learnt from the corpus: latent factors of the term-document matrix by randomised projection and power rounds.

Weights are (1 + ln tf) * ln(rows / df). Texts are dealt by key over parts of PART bytes, and each part numbers its own terms.
A round sends each part the vectors of its terms; the part works out its texts' vectors and, from these, what
it adds to each of its terms, so that a vector travels once a part and term, not once an occurrence, and no task holds more than
a part. Between rounds vectors are made orthonormal by the texts' products, a matrix of rank x rank,
which is all that the driver holds: being linear, that step may follow the sums of terms. Each
term starts from numbers that its own hash gives, so the same corpus has the same factors.

A text's vector is the sum of its terms' vectors by their weights, at length one; so texts that
share no word are near if their words stand beside the same others. Terms of fewer than `least`
rows, or of more than a `most` share of them, do not count. Texts without a term that counts have no
vector. A null text has no terms. With fewer independent rows than factors the rest are zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from lakelens.operators import lexical as L
from lakelens.operators.density import Keep

#: Bytes of texts of a part; weights that are multiplied at once.
PART, STEP = 1 << 25, 1 << 16


def _names(rank: int) -> list[str]:
    return [f"f{j}" for j in range(rank)]


def _dense(batch: pa.RecordBatch, rank: int) -> np.ndarray:
    return np.stack([batch.column(f"f{j}").to_numpy(zero_copy_only=False) for j in range(rank)], 1) if batch.num_rows else np.empty((0, rank))


def _products(rows: DataFrame, rank: int) -> np.ndarray:
    """The rank x rank products of all vectors: a sum a task, added by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rank, rank))
        for batch in batches:
            x = _dense(batch, rank)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rank * rank)), pa.array(total.ravel())], names=["at", "x"])

    sums = rows.select(*_names(rank)).mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").toArrow()
    return sums["x"].to_numpy().reshape(rank, rank) if len(sums) else np.zeros((rank, rank))


def _turned(rows: DataFrame, key: str, m: np.ndarray) -> DataFrame:
    """All vectors times a small matrix."""
    rank = len(m)
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _dense(batch, rank) @ m
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(x[:, j]) for j in range(rank))], names=[key, *_names(rank)])

    return rows.select(key, *_names(rank)).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"f{j} double" for j in range(rank)))


def _whitener(g: np.ndarray) -> np.ndarray:
    """What makes vectors of these products orthonormal; directions that the vectors do not have become zero."""
    values, axes = np.linalg.eigh(g)
    on = values > max(values.max(initial=0), 0) * 1e-10
    return axes * np.where(on, 1 / np.sqrt(np.where(on, values, 1)), 0)


def _start(terms: DataFrame, rank: int) -> DataFrame:
    """Numbers of each term, from its hash: evenly spread around zero."""
    bits = lambda j: F.pmod(F.xxhash64("term", F.lit(j)), F.lit(1 << 20)) / float(1 << 19) - 1
    return terms.select("term", *[bits(j).alias(f"f{j}") for j in range(rank)])


def _cut(rows: DataFrame, key: str, text: str, tokenizer: str, keep: Keep) -> tuple[DataFrame, DataFrame, int]:
    """Texts (part, key, at, tf: numbers of terms in the part, and how often each occurs), terms (part, local, term, df) and the number of rows.

    All rows of a key are in one part, and are one text.
    """
    make: Column = L.TOKENIZERS[tokenizer][0](F.col(text))
    kind = dict(rows.dtypes)[key]
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // PART))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, keys, owners, terms, counts, texts = TaskContext.get().partitionId(), {}, [], [], [], [], 0
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            words = batch.column(1).flatten().dictionary_encode()
            local = np.array([number.setdefault(w, len(number)) for w in words.dictionary.to_pylist()], np.int64)
            pair = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths) << 32 | (local[words.indices.to_numpy()] if len(words) else 0)
            pair, tf = np.unique(pair, return_counts=True)
            keys.append(batch.column(0))
            owners.append((pair >> 32) + texts), terms.append((pair & 0xFFFFFFFF).astype(np.int32)), counts.append(tf.astype(np.int32))
            texts += batch.num_rows
        if not texts:
            return
        code = pa.chunked_array(keys).combine_chunks().dictionary_encode(null_encoding="encode")
        owner, at, tf = np.concatenate(owners), np.concatenate(terms), np.concatenate(counts)
        if len(code.dictionary) < texts:  # rows of a key become one
            pair, where = np.unique(code.indices.to_numpy()[owner].astype(np.int64) << 32 | at, return_inverse=True)
            owner, at, tf = pair >> 32, (pair & 0xFFFFFFFF).astype(np.int32), np.bincount(where, tf, len(pair)).astype(np.int32)
        df = np.bincount(at, minlength=len(number))
        ends = np.searchsorted(owner, np.arange(len(code.dictionary) + 1))
        names = list(number)
        blank = lambda n, t: pa.nulls(n, t)
        for i in range(0, len(code.dictionary), 1 << 12):
            own = ends[i : i + (1 << 12) + 1]
            m = len(own) - 1
            cells = lambda x: pa.array([x[a:z].tobytes() for a, z in zip(own[:-1], own[1:], strict=True)], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array([part] * m, pa.int32()), code.dictionary.slice(i, m), cells(at), cells(tf), blank(m, pa.int32()), blank(m, pa.string()), blank(m, pa.int64())], names=columns)
        for i in range(0, len(names), 1 << 14):
            m = min(len(names), i + (1 << 14)) - i
            yield pa.RecordBatch.from_arrays([pa.array([part] * m, pa.int32()), blank(m, code.dictionary.type), blank(m, pa.binary()), blank(m, pa.binary()), pa.array(range(i, i + m), pa.int32()), pa.array(names[i : i + m], pa.string()), pa.array(df[i : i + m], pa.int64())], names=columns)

    columns = ["part", key, "at", "tf", "local", "term", "df"]
    cut = rows.select(key, text).repartition(parts, key).select(key, make.alias("tokens")).mapInArrow(run, f"part int, `{key}` {kind}, at binary, tf binary, local int, term string, df long")
    cut = keep(cut, "parts")
    return cut.filter("term is null").select("part", key, "at", "tf"), cut.filter("term is not null").select("part", "local", "term", "df"), n


def _weights(texts: pa.Table, terms: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, row of terms, weight) of the terms that count, by text."""
    ints = lambda c: np.frombuffer(b"".join(x.as_buffer() for x in texts[c]), np.int32)
    at, tf = ints("at"), ints("tf")
    text = np.repeat(np.arange(len(texts)), pc.binary_length(texts["at"]).to_numpy() // 4)
    local = terms["local"].to_numpy()
    row = np.full(max(at.max(initial=-1), local.max(initial=-1)) + 1, -1)
    row[local] = np.arange(len(local))
    row = row[at]
    on = row >= 0
    text, row = text[on], row[on]
    return text, row, (1 + np.log(tf[on])) * terms["idf"].to_numpy()[row]


def _product(to: np.ndarray, of: np.ndarray, w: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """n sums of the vectors x[of], by their weights; `to` is sorted."""
    out = np.zeros((n, x.shape[1]))
    for a in range(0, len(to), STEP):
        s = slice(a, a + STEP)
        first = np.flatnonzero(np.diff(to[s], prepend=-1))
        out[to[s][first]] += np.add.reduceat(x[of[s]] * w[s, None], first)
    return out


def _vectors(table: pa.Table, rank: int) -> np.ndarray:
    return np.stack([table[f].to_numpy() for f in _names(rank)], 1)


def _beside(texts: DataFrame, terms: DataFrame) -> PandasCogroupedOps:
    """Texts and terms of each part."""
    return texts.toDF(*texts.columns).groupBy("part").cogroup(terms.toDF(*terms.columns).groupBy("part"))  # both stem from the same table


def _round(texts: DataFrame, terms: DataFrame, rank: int) -> DataFrame:
    """(term, at, vector): of each term what all texts that hold it add up to by their weights; of at, without a term, a row of the texts' products."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        text, row, w = _weights(a, b)
        of_texts = _product(text, row, w, _vectors(b, rank), len(a))
        order = np.argsort(row, kind="stable")
        of_terms = _product(row[order], text[order], w[order], of_texts, len(b))
        both = np.concatenate([of_terms, of_texts.T @ of_texts])
        names = pa.concat_arrays([b["term"].combine_chunks().cast(pa.string()), pa.nulls(rank, pa.string())])
        return pa.table({"term": names, "at": pa.concat_arrays([pa.nulls(len(b), pa.int32()), pa.array(range(rank), pa.int32())]), **{f: pa.array(both[:, j]) for j, f in enumerate(_names(rank))}})

    schema = "term string, at int, " + ", ".join(f"{f} double" for f in _names(rank))
    return _beside(texts, terms).applyInArrow(run, schema).groupBy("term", "at").agg(*[F.sum(f).alias(f) for f in _names(rank)])


@dataclass(frozen=True)
class Latent:
    """term, idf and v of every term that counts, and the singular values, largest first."""

    terms: DataFrame
    values: np.ndarray
    tokenizer: str
    keep: Keep

    def embed(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        """key and embedding of every text that has a term that counts."""
        rank = len(self.values)
        texts, own, _ = _cut(rows, key, text, self.tokenizer, self.keep)
        terms = own.join(self.terms, "term").select("part", "local", "idf", *[F.col("v")[j].alias(f) for j, f in enumerate(_names(rank))])

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            text, row, w = _weights(a, b)
            x = _product(text, row, w, _vectors(b, rank), len(a))
            norm = np.sqrt((x * x).sum(1))
            on = norm > 0
            x = (x[on] / norm[on, None]).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * rank), pa.array(x.ravel()))
            return pa.table({key: a[key].filter(pa.array(on)), "embedding": lists})

        return _beside(texts, terms).applyInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, embedding array<float>")


def learn(rows: DataFrame, key: str, text: str, keep: Keep, rank: int = 64, rounds: int = 2, least: int = 2, most: float = 0.5, tokenizer: str = "plain") -> Latent:
    """Factors of a corpus; `keep` writes a table and reads it back."""
    texts, own, n = _cut(rows, key, text, tokenizer, keep)
    df = own.groupBy("term").agg(F.sum("df").alias("df")).filter((F.col("df") >= least) & (F.col("df") <= most * n))
    terms = keep(df.select("term", F.log(F.lit(float(max(n, 1))) / F.col("df")).alias("idf")), "terms")
    own = keep(own.join(terms, "term").select("part", "local", "term", "idf"), "own")
    of_terms = _start(terms, rank)
    for _ in range(rounds + 1):
        both = keep(_round(texts, own.join(of_terms, "term"), rank), "words")
        g = both.filter("at is not null").orderBy("at").toArrow()  # rank rows
        of_terms = _turned(both.filter("at is null"), "term", _whitener(_vectors(g, rank) if len(g) else np.zeros((rank, rank))))
    of_terms = keep(of_terms, "turned")
    # products of the terms' vectors hold the squares of the singular values
    squares, axes = np.linalg.eigh(_products(of_terms, rank))
    order = np.argsort(-squares, kind="stable")
    values = np.sqrt(np.maximum(squares[order], 0))
    axes = axes[:, order] * np.where(values > values.max(initial=0) * 1e-6, 1 / np.where(values > 0, values, 1), 0)
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(rank)] < 0, -1, 1)
    final = _turned(of_terms, "term", axes).select("term", F.array(*_names(rank)).alias("v"))
    return Latent(keep(terms.join(final, "term"), "factors"), values, tokenizer, keep)
