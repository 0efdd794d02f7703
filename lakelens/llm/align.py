"""Alignment of two tokenizers over the same text, and the counts of the ids they link.

Both token sequences run over the same bytes. A transducer takes their tokens in turn and tracks
which side leads and by which bytes (the dangling suffix of its last token): the other side takes
its next token and matches it against the residual, which shrinks, empties, or changes sides. A
token that meets a residual overlaps the one token that left it, so every step but the first of a
group is one link; an empty residual closes the group. Transitions are memoised by residual and
next token.

No token of either side holds anything before a single space that stands between two characters
that are no white space, so texts are cut there into cells, which are encoded and aligned by
themselves; alignments of short cells are remembered within a task, up to a fixed number. A text
is read whole; a text without such spaces is one cell.

Each document's distinct linked pairs travel packed, and never as rows of the corpus: counts of
documents for each pair are pre-aggregated in tasks, then summed by Spark. The table of counts has
one row for each distinct pair; it is broadcast if a count of its rows finds at most ``most``, and
is joined to the exploded pairs otherwise.

Null and empty texts, and texts that either side does not give back byte for byte (such as those
that hold U+2581), have no tokens: zeros and ''. Every row is a document of its own, rows that
repeat a doc_id or a text too. Extra columns are ignored, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakelens.llm.shared import Batches, Workspace, keep, pick, portions, tidy

#: Ids of the second side stay below this, so that a pair is one unsigned 32-bit number.
SECOND = 1 << 15
_LOADED: dict[tuple[str, str], Aligner] = {}


class Transducer:
    """Steps of two token sequences over the same bytes, memoised by (leading side and residual, next token)."""

    def __init__(self, first: Callable[[int], bytes], second: Callable[[int], bytes], most: int = 1 << 18) -> None:
        self.of, self.most = (first, second), most
        self.clear()

    def clear(self) -> None:
        #: State 0 is the empty residual; every state has the side that moves next, its residual and its known steps.
        self.ids: dict[tuple[int, bytes], int] = {(0, b""): 0}
        self.moves: list[int] = [0]
        self.left: list[bytes] = [b""]
        self.steps: list[dict[int, int]] = [{}]
        self.known = 0

    def _step(self, state: int, token: int) -> int:
        side, residual = self.moves[state], self.left[state]
        got = self.of[side](token)
        if got.startswith(residual):  # the mover covers the residual and leads by what is over
            after = (1 - side, got[len(residual) :])
        elif residual.startswith(got):
            after = (side, residual[len(got) :])
        else:
            after = None
        if after is None or not got:
            to = -1
        else:
            key = after if after[1] else (0, b"")
            to = self.ids.get(key, len(self.moves))
            if to == len(self.moves):
                self.ids[key] = to
                self.moves.append(key[0])
                self.left.append(key[1])
                self.steps.append({})
        self.steps[state][token] = to
        self.known += 1
        return to

    def align(self, a: list[int], b: list[int]) -> tuple[list[tuple[int, int, int, int]], list[int]] | None:
        """Groups (ranges of both sides) and links (a * SECOND + b), or None if the bytes differ."""
        if self.known > self.most:
            self.clear()
        moves, steps = self.moves, self.steps
        n_a, n_b, i, j, from_a, from_b, state = len(a), len(b), 0, 0, 0, 0, 0
        groups: list[tuple[int, int, int, int]] = []
        links: list[int] = []
        while state or i < n_a or j < n_b:
            if moves[state]:
                if j == n_b:
                    return None
                token = b[j]
                j += 1
            else:
                if i == n_a:
                    return None
                token = a[i]
                i += 1
            if state:  # the mover meets the token that left the residual
                links.append(a[i - 1] * SECOND + b[j - 1])
            to = steps[state].get(token)
            state = self._step(state, token) if to is None else to
            if state <= 0:
                if state < 0:
                    return None
                groups.append((from_a, i, from_b, j))
                from_a, from_b = i, j
        return groups, links


def _first_side(path: str) -> tuple[Callable[[str], list[int]], Callable[[int], bytes]]:
    """Ids of a text and bytes of an id, by a byte-level vocabulary (.json); special tokens' strings are plain text."""
    try:
        import public_tokenizers
        import tiktoken

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:  # the same vocabulary as ranks is faster
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return ranked.encode_ordinary, ranked.decode_single_token_bytes
    except (ImportError, FileNotFoundError):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
        byte = {chr(c): c for c in own} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in set(own))}
        return lambda t: whole.encode(t, add_special_tokens=False).ids, lambda i: bytes(byte[c] for c in whole.id_to_token(i))


def _second_side(path: str) -> tuple[Callable[[list[str]], list[list[int]]], Callable[[int], bytes]]:
    """Ids of texts and bytes of an id, by a sentence-piece model; the leading space is the model's."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if model.get_piece_size() > SECOND:
        raise ValueError(f"the second vocabulary has more than {SECOND} ids")

    def piece(i: int) -> bytes:
        text = model.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if model.is_byte(i) else text.replace("▁", " ").encode()

    return lambda texts: model.encode(texts, num_threads=1), piece


def _remembered(f: Callable[[int], bytes]) -> Callable[[int], bytes]:
    """At most one entry for each id of a vocabulary."""
    known: dict[int, bytes] = {}

    def g(i: int) -> bytes:
        if i not in known:
            known[i] = f(i)
        return known[i]

    return g


_IRREGULAR = re.compile(r"\s | \s")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def cells(text: str) -> list[str]:
    """The text, cut at (and without) single spaces between two characters that are no white space; both sides put a space in front of every cell."""
    if text[0].isspace() or text[-1].isspace() or _IRREGULAR.search(text):
        return _CUT.split(text)
    return text.split(" ")


class Aligner:
    """Aligned cells by number: how many ids and groups, linked pairs and groups as text; `bad` for cells that differ.

    They are forgotten, between documents, once there are more than `most` of them or than `longest` characters in all.
    The first side is of bytes and gives back every one, so that bytes which differ are the second's.
    """

    def __init__(self, first: str, second: str, most: int = 400_000, longest: int = 1 << 23) -> None:
        (self.a, a_bytes), (self.b, b_bytes) = _first_side(first), _second_side(second)
        self.most, self.longest = most, longest
        self.transducer = Transducer(_remembered(a_bytes), _remembered(b_bytes))
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.n_a, self.n_b, self.n_groups = array("q"), array("q"), array("q")
        self.pairs: list[bytes] = []
        self.text: list[str] = []
        self.bad: set[int] = set()
        self.size = 0

    def _add(self, fresh: list[str]) -> None:
        """Aligns cells that are not known, and numbers them."""
        for cell, b in zip(fresh, self.b(fresh), strict=True):
            a = self.a(" " + cell)
            got = self.transducer.align(a, b)
            groups, links = got or ((), ())
            if got is None:
                self.bad.add(len(self.text))
            self.number[cell] = len(self.text)
            self.n_a.append(len(a))
            self.n_b.append(len(b))
            self.n_groups.append(len(groups))
            self.pairs.append(array("I", links).tobytes())
            self.text.append(";".join([f"{a[p]}|{b[r]}" if q - p == t - r == 1 else f"{','.join(map(str, a[p:q]))}|{','.join(map(str, b[r:t]))}" for p, q, r, t in groups]))

    def document(self, text: str) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links, groups_sha256, distinct pairs and how often each is linked."""
        nothing = (0, 0, 0, 0, "", np.empty(0, np.uint32), np.empty(0, np.int64))
        if not text or "▁" in text:
            return nothing
        if len(self.text) > self.most or self.size > self.longest:
            self.clear()
        parts = cells(text)
        at = list(map(self.number.get, parts))
        if None in at:
            fresh = list(dict.fromkeys([c for c, k in zip(parts, at, strict=True) if k is None]))
            self.size += sum(map(len, fresh))
            self._add(fresh)
            at = list(map(self.number.__getitem__, parts))
        if self.bad and not self.bad.isdisjoint(at):
            return nothing
        many = np.array(at)
        sums = [int(np.frombuffer(x, np.int64)[many].sum()) for x in (self.n_a, self.n_b, self.n_groups)]
        links = np.frombuffer(b"".join(map(self.pairs.__getitem__, at)), np.uint32)
        digest = hashlib.sha256(";".join(map(self.text.__getitem__, at)).encode()).hexdigest()
        return (*sums, len(links), digest, *np.unique(links, return_counts=True))


def aligner(first: str, second: str) -> Aligner:
    """One for each process and pair of vocabularies."""
    if (first, second) not in _LOADED:
        _LOADED[first, second] = Aligner(first, second)
    return _LOADED[first, second]


_ROW = "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def _narrow(times: np.ndarray) -> bytes:
    """Counts in the least width that holds them; the width follows from the sizes of both columns."""
    for kind in (np.uint8, np.uint16, np.uint32):
        if not len(times) or times.max() <= np.iinfo(kind).max:
            return times.astype(kind).tobytes()
    return times.astype(np.uint64).tobytes()


def _wide(times: bytes, n: int) -> np.ndarray:
    return np.frombuffer(times, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(times) // n] if n else np.uint8).astype(np.int64)


def align(docs: DataFrame, first: str, second: str) -> DataFrame:
    """A row a document with its counts, digest, and its distinct linked pairs with their times, packed."""

    def run(batches: Batches) -> Batches:
        both, done = aligner(first, second), TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in portions(batch, "text"):
                rows = [both.document(t.as_py() or "") for t in part.column("text")]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(done + np.arange(len(rows))), part.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4]), pa.array([p.tobytes() for p in cols[5]], pa.binary()), pa.array([_narrow(t) for t in cols[6]], pa.binary())],
                    names=[x.split()[0] for x in _ROW.split(", ")],
                )
                done += len(rows)

    d = pick(docs, "doc_id", "text")
    return d.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(tidy(run), _ROW)


def count_pairs(aligned: DataFrame, held: int = 1 << 20) -> DataFrame:
    """pair, n (documents that hold it linked) and best (whether no pair of its first id has more)."""

    def run(batches: Batches) -> Batches:
        pairs, n, waiting, size = np.empty(0, np.uint32), np.empty(0, np.int64), [], 0

        def merge() -> None:
            nonlocal pairs, n, waiting, size
            new, times = np.unique(np.concatenate(waiting), return_counts=True)
            pairs, where = np.unique(np.concatenate([pairs, new]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([n, times]), minlength=len(pairs)).astype(np.int64)
            waiting, size = [], 0

        for batch in batches:
            for p in batch.column("pairs"):
                waiting.append(np.frombuffer(p.as_buffer(), np.uint32))
                size += len(waiting[-1])
                if size > 4 * held:
                    merge()
                    if len(pairs) > held:
                        yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n)], names=["pair", "n"])
                        pairs, n = pairs[:0], n[:0]
        if waiting:
            merge()
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n)], names=["pair", "n"])

    sums = aligned.select("pairs").mapInArrow(tidy(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    one = Window.partitionBy(F.shiftright("pair", 15))  # at most one row for each id of the second vocabulary
    return sums.withColumn("best", F.col("n") == F.max("n").over(one))


def _looked_up(aligned: DataFrame, counts: DataFrame, work: Workspace) -> DataFrame:
    """uid, n_best and count_sum by a broadcast of the counts, whose number of rows was checked."""
    got = counts.select("pair", "n", "best").toArrow()
    pair = np.asarray(got.column("pair")).astype(np.uint32)
    order = np.argsort(pair)
    sent = work.send((pair[order], np.asarray(got.column("n"))[order], np.asarray(got.column("best"))[order]))

    def run(batches: Batches) -> Batches:
        known, n, best = sent.value
        for batch in batches:
            sums, bests = [], []
            for p, t in zip(batch.column("pairs"), batch.column("times"), strict=True):
                pairs = np.frombuffer(p.as_buffer(), np.uint32)
                times = _wide(t.as_py(), len(pairs))
                at = np.searchsorted(known, pairs)
                sums.append(int((n[at] * times).sum()))
                bests.append(int(times[best[at]].sum()))
            own = [batch.column(c) for c in OUT[:6]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(bests, pa.int64()), pa.array(sums, pa.int64())], names=[*OUT[:6], *OUT[6:]])

    return aligned.mapInArrow(tidy(run), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


OUT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


def _joined(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a join of the exploded pairs, for counts of any size."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for uid, p, t in zip(batch.column("uid").to_pylist(), batch.column("pairs"), batch.column("times"), strict=True):
                pairs = np.frombuffer(p.as_buffer(), np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), uid)), pa.array(pairs.astype(np.int64)), pa.array(_wide(t.as_py(), len(pairs)))], names=["uid", "pair", "times"])

    rows = aligned.select("uid", "pairs", "times").mapInArrow(tidy(run), "uid long, pair long, times long")
    # a pair that most documents hold is dealt over SALTS places
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = rows.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int")).join(salted, ["pair", "salt"])
    sums = met.groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    out = aligned.drop("pairs", "times").join(sums, "uid", "left").fillna(0, ["n_best", "count_sum"])
    return out.select(*OUT)


SALTS = 16


def align_tokens(docs: DataFrame, first: str, second: str, most: int = 1 << 23) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum of every document."""
    with Workspace(docs.sparkSession, "align") as work:
        aligned = work.keep(align(docs, first, second), "aligned")
        counts = work.keep(count_pairs(aligned), "counts")
        out = _looked_up(aligned, counts, work) if counts.count() <= most else _joined(aligned, counts)
        return keep(out, "alignment")
