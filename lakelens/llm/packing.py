"""Best-fit packing of token sequences by a sweep over run-length encoded lengths.

Documents are tokenized where they are read; texts never move. A document of more than ``size``
tokens is cut into pieces of ``size``, of which the first may be shorter.

Matching is one loop on the driver, longest pieces first, in place of distributed sweeps in rounds:
lengths and gaps are integers up to ``size``, so both are kept run-length encoded (a run of pieces
is a length and how many there are, a run of gaps is a range of consecutive sequences with equal
room), and the loop sees at most ``size`` lengths whatever the input. The pieces of one length go to
the smallest gap that holds them; where many want the same gap, their rank decides. What is left
without a gap opens new sequences. The result is that of best-fit decreasing. All rows take part
through their rank: it is counted while tokenizing within a task, tasks are put after one another by
a running sum for each length, and a piece finds its sequence and place from its rank alone. Of
pieces of equal length those of a task read earlier come first, in the order of its rows. No length,
source or document is ever gathered in one task.

Null and empty texts have just the end token. Rows that repeat a doc_id are packed each for
itself. An empty table gives no pieces. Texts are tokenized whole, however long.
"""

from __future__ import annotations

import base64
import json
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakelens.llm.shared import keep, pick

END = 2
_LOADED: dict[str, Callable[[str], bytes]] = {}


def encoder(path: str) -> Callable[[str], bytes]:
    """Text to its ids as unsigned 32-bit integers, by the byte-level vocabulary at `path` (.json); the ids are those of `tokenizers`, added tokens that stand in a text included."""
    if path not in _LOADED:
        _LOADED[path] = _encoder(path)
    return _LOADED[path]


def _encoder(path: str) -> Callable[[str], bytes]:
    with open(path) as f:
        added = json.load(f).get("added_tokens", [])
    try:  # the same vocabulary as ranks is three times as fast
        import public_tokenizers
        import tiktoken

        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise FileNotFoundError("added tokens that are not matched as they stand")
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {t["content"]: t["id"] for t in added}
        ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        ids = lambda t: ranked.encode(t, allowed_special="all") if any(x in t for x in special) else ranked.encode_ordinary(t)
    except (ImportError, FileNotFoundError):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        ids = lambda t: whole.encode(t, add_special_tokens=False).ids
    return lambda text: array("I", ids(text)).tobytes()


def cut(n: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    pieces = max(1, -(-n // size))
    at = n - size * (pieces - 1)
    yield 0, at
    for k in range(1, pieces):
        yield at + size * (k - 1), size


def sweep(counts: dict[int, int], size: int) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """For each length its steps (first rank, first sequence, pieces a sequence, offset), and the number of sequences.

    The piece of rank r in a step goes to sequence ``first + (r - rank) // each`` at
    ``offset + (r - rank) % each * length``.
    """
    gaps: list[int] = []  # sorted rooms that some sequences have
    runs: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, how many)
    steps: dict[int, list[tuple[int, int, int, int]]] = {}
    opened = 0

    def put(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in runs:
                insort(gaps, room)
            runs.setdefault(room, []).append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect_left(gaps, length)
            if k < len(gaps):
                room = gaps[k]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room], gaps[k]
            else:
                room, first = size, opened
                n = -(-left // (size // length))
                opened += n
            each = room // length
            full, rest = divmod(min(left, n * each), each)
            steps.setdefault(length, []).append((rank, first, each, size - room))
            put(room - each * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + full + bool(rest), n - full - bool(rest))
            rank, left = rank + full * each + rest, left - full * each - rest
    return steps, opened


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, turn long"


def tokenize(docs: DataFrame, path: str, size: int) -> DataFrame:
    """All pieces, with the task that made them and their rank in it among those of their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, task = encoder(path), END.to_bytes(4, "little"), TaskContext.get().partitionId()
        turn: Counter = Counter()
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            ids_of = batch.column("doc_id").to_pylist()
            for i, text in enumerate(batch.column("text")):
                ids = encode(text.as_py() or "") + end
                for k, (start, n) in enumerate(cut(len(ids) // 4, size)):
                    for c, v in zip(cols, (ids_of[i], k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), turn[n]), strict=True):
                        c.append(v)
                    turn[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=False)), pa.array([task] * len(cols[0]), pa.int32()), pa.array(cols[5], pa.int64())], names=[x.split()[0] for x in _PIECES.split(", ")])

    d = pick(docs, "doc_id", "text")
    return d.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, _PIECES)


def pack(docs: DataFrame, path: str, size: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    pieces = keep(tokenize(docs, path, size), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `size` numbers at most
    steps, _ = sweep(counts, size)
    rows = [(length, *map(list, zip(*x, strict=True))) for length, x in steps.items()]
    spark = pieces.sparkSession
    plan = spark.createDataFrame(rows, "length long, ranks array<long>, firsts array<long>, each array<long>, offsets array<long>")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = by_task.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    ranked = pieces.join(base, ["task", "length"]).join(F.broadcast(plan), "length")  # at most `size` rows
    ranked = ranked.withColumn("rank", F.col("before") + F.col("turn"))
    ranked = ranked.withColumn("step", F.size(F.filter("ranks", lambda r: r <= F.col("rank"))))
    at = lambda c: F.element_at(c, F.col("step"))
    ranked = ranked.withColumn("k", F.col("rank") - at("ranks"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (at("firsts") + F.floor(F.col("k") / at("each"))).alias("sequence_id"), (at("offsets") + F.col("k") % at("each") * F.col("length")).alias("offset"))
