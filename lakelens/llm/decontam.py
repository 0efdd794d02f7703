"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters and digits and of anything beyond ASCII, capitals A-Z lowered. A
window is WINDOW consecutive words of an item; an item with fewer words is one window as a whole.
Fingerprints are the minimum hash of GRAM-word grams in each window. Equal windows have equal
minima, so every shared span of WINDOW words or more shares a fingerprint: documents are probed
with the minima of their own sliding windows (runs of equal minima are probed once), and each hit is
extended to the windows around it, which are compared by the hash of all their words. Items shorter
than a window have the minimum of all their grams, or of their own length if they are shorter
than a gram, and are looked up at every place of a document.

Documents are never shuffled. The fingerprints of the benchmark are broadcast only while they are
at most `block_words` words; a larger benchmark is cut into blocks of that size, held in the shared
folder, and tasks take the documents of a batch through block after block. Items longer than
`PIECE` words are cut into overlapping pieces, so no block outgrows its bound.

Null and empty texts have no words: n_words, n_hit and n_items are 0, contaminated is false.
Repeated rows give repeated results. Items that repeat an item_id count once; a null item_id is
named "null". With an empty benchmark nothing is contaminated.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.llm.shared import ALNUM, LOWER, U64, gram_hashes, keep, numbered, pick, portions, ranges, scratch, tidy, utf8, word_bounds, word_hashes

WINDOW, GRAM = 10, 5
BLOCK_WORDS, PIECE = 1 << 20, 1 << 18


def doc_words(batch: pa.RecordBatch, column: str | int = "text") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each text's offsets in them."""
    data, offsets = utf8(batch.column(column))
    low = LOWER[data]
    starts, ends, at = word_bounds(low, offsets, ALNUM)
    return word_hashes(low, starts, ends), at


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    out = h[: len(h) - w + 1].copy() if len(h) >= w else h[:0]
    for i in range(1, w):
        np.minimum(out, h[i : i + len(out)], out=out)
    return out


class Index:
    """Windows and fingerprints of a block of items. Arrays only, so that it can be sent and stored."""

    def __init__(self, items: list[tuple[str, np.ndarray]]) -> None:
        names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(names)}
        self.names = np.array(names, dtype=str)
        prints, wins, owners, lengths = {}, [], [], []
        for name, words in items:
            n = len(words)
            if n == 0:
                continue
            size = min(n, WINDOW)
            w = gram_hashes(words, size)
            wins.append(w)
            owners.append(np.full(len(w), number[name], np.int64))
            lengths.append(np.full(len(w), size, np.int64))
            gram = min(size, GRAM)
            prints.setdefault(size, []).append(_sliding_min(gram_hashes(words, gram), size - gram + 1))
        self.prints = {size: np.unique(np.concatenate(p)) for size, p in prints.items()}
        if not wins:
            wins, owners, lengths = [np.empty(0, U64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        pairs = np.unique(np.rec.fromarrays([np.concatenate(wins), np.concatenate(owners)], names="w,o"))  # gram_hashes carry the length
        self.windows, first = np.unique(pairs.w, return_index=True)
        self.owner_at, self.owners = np.append(first, len(pairs)), np.ascontiguousarray(pairs.o)

    def hits(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all occurring windows: place of the first word, length, number of the window."""
        n, found = len(words), []
        ends = np.repeat(at[1:], np.diff(at))  # where the document of each word ends
        for size, table in self.prints.items():
            if n < size:
                continue
            gram = min(size, GRAM)
            low = _sliding_min(gram_hashes(words, gram), size - gram + 1)
            change = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
            shared = _within(table, low[change])
            runs = np.append(change, len(low))
            p = ranges(runs[:-1][shared], np.diff(runs)[shared])
            p = p[p + size <= ends[p]]
            if len(p):
                whole = gram_hashes(words, size, p)
                k = np.minimum(np.searchsorted(self.windows, whole), len(self.windows) - 1)
                ok = self.windows[k] == whole
                found.append((p[ok], np.full(int(ok.sum()), size), k[ok]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, names=self.names, windows=self.windows, owner_at=self.owner_at, owners=self.owners, **{f"p{k}": v for k, v in self.prints.items()})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Index:
        x = np.load(io.BytesIO(raw))
        self = cls.__new__(cls)
        self.names, self.windows, self.owner_at, self.owners = x["names"], x["windows"], x["owner_at"], x["owners"]
        self.prints = {int(k[1:]): x[k] for k in x.files if k[0] == "p"}
        return self


def _within(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def judge(words: np.ndarray, at: np.ndarray, blocks: Iterator[Index]) -> tuple[np.ndarray, list[list[str]]]:
    """Hit words and item names of each document, over all blocks."""
    docs = len(at) - 1
    cover = np.zeros(len(words) + 1, np.int64)
    names: list[set[str]] = [set() for _ in range(docs)]
    for index in blocks:
        p, size, k = index.hits(words, at)
        np.add.at(cover, p, 1)
        np.add.at(cover, p + size, -1)
        doc = np.searchsorted(at, p, side="right") - 1
        if len(p):
            pairs = np.unique(doc * len(index.windows) + k)
            doc, k = pairs // len(index.windows), pairs % len(index.windows)
            many = index.owner_at[k + 1] - index.owner_at[k]
            owner = index.owners[ranges(index.owner_at[k], many)]
            pairs = np.unique(np.repeat(doc, many) * len(index.names) + owner)
            for d, o in zip((pairs // len(index.names)).tolist(), (pairs % len(index.names)).tolist(), strict=True):
                names[d].add(str(index.names[o]))
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return hit[at[1:]] - hit[at[:-1]], [sorted(x) for x in names]


def build(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Callable[[], Iterator[Index]]:
    """The benchmark's index: what it returns gives its blocks, in a task."""
    b = pick(benchmark, "item_id", "text").withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit("null")))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text"):
                words, at = doc_words(part)
                rows = [(name, words[a:z]) for name, s, e in zip(part.column("item_id").to_pylist(), at[:-1], at[1:], strict=True) for a, z in _cuts(int(s), int(e))]
                yield pa.RecordBatch.from_pydict({"name": pa.array([r[0] for r in rows], pa.string()), "n": pa.array([len(r[1]) for r in rows], pa.int64()), "words": pa.array([r[1].tobytes() for r in rows], pa.binary())})

    items = keep(b.mapInArrow(pieces, "name string, n long, words binary"), "benchmark")
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    spark = items.sparkSession
    number = F.pmod(F.xxhash64("name", "n", "words"), F.lit(blocks))
    made = lambda k: Index([(r.name, np.frombuffer(r.words, U64)) for r in items.filter(number == k).toLocalIterator()])  # noqa: E731  about block_words words
    if blocks == 1:
        sent = spark.sparkContext.broadcast(made(0).save())
        held: list[Index] = []

        def one() -> Iterator[Index]:
            if not held:
                held.append(Index.load(sent.value))
            yield held[0]

        return one
    folder = scratch(spark, "benchmark-blocks")
    store, root = arrow_fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    store.create_dir(root, recursive=True)
    for k in range(blocks):
        with store.open_output_stream(f"{root}/{k}", compression=None) as f:
            f.write(made(k).save())
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def each() -> Iterator[Index]:
        store, root = arrow_fs.FileSystem.from_uri(uri)
        for k in range(blocks):
            with store.open_input_stream(f"{root}/{k}", compression=None) as f:
                yield Index.load(f.read())

    return each


def _cuts(start: int, end: int) -> Iterator[tuple[int, int]]:
    """Pieces of at most PIECE words that share WINDOW - 1 words, so that no window is lost."""
    if end - start <= PIECE:
        yield start, end
        return
    for a in range(start, end - WINDOW + 1, PIECE - WINDOW + 1):
        yield a, min(end, a + PIECE)


_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def find_contamination(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row a document: its words, those hit, and the items it has windows of."""
    blocks = build(benchmark, block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text"):
                words, at = doc_words(part)
                hit, names = judge(words, at, blocks())
                digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(hit.astype(np.int64)), pa.array([len(x) for x in names], pa.int64()), pa.array(digest, pa.string()), pa.array(hit > 0)], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    d = pick(docs, "doc_id", "text")
    return d.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, _SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows, with all their columns, of documents in which no window of the benchmark occurs."""
    blocks, column = build(benchmark, block_words), docs.columns.index("text")
    safe = numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, column):
                hit, _ = judge(*doc_words(part, column), blocks())
                yield part.filter(pa.array(hit == 0))

    return safe.mapInArrow(tidy(run), safe.schema).toDF(*docs.columns)
