import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lakelens.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


WHOLE = Tokenizer.from_file(PATH)


def ids_of(text):
    return np.frombuffer(P.encoder(PATH)(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=st.sampled_from("abT é1.'s\n\t  \x1c\xa0　ñ!<|endoftext|>中"), max_size=30), st.sampled_from(["<|endoftext|>", " <|endoftext|>", "<|endoftext", "<|endoftext|><|endoftext|>"])), max_size=4).map("".join))
def test_ids_are_those_of_tokenizers(text):
    assert ids_of(text) == WHOLE.encode(text, add_special_tokens=False).ids


def test_added_token_in_a_text():
    assert ids_of("a <|endoftext|> b") == [64, 220, 50256, 275]


@pytest.mark.parametrize("n,size,want", [(3, 4, [(0, 3)]), (4, 4, [(0, 4)]), (5, 4, [(0, 1), (1, 4)]), (8, 4, [(0, 4), (4, 4)])])
def test_cut(n, size, want):
    assert list(P.cut(n, size)) == want


def best_fit_decreasing(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            r, i = min(fits)
            rooms[i] -= n
        else:
            rooms.append(size - n)
    return len(rooms)


def place(counts, steps, size):
    used = {}
    for n, c in counts.items():
        for r in range(c):
            rank, first, each, offset = [s for s in steps[n] if s[0] <= r][-1]
            k = r - rank
            used.setdefault(first + k // each, []).append((offset + k % each * n, n))
    return used


@pytest.mark.parametrize("seed", range(20))
def test_sweep_is_best_fit_decreasing_without_gaps(seed):
    rng = random.Random(seed)
    size = rng.choice([7, 16, 64])
    lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 300))]
    counts = {n: lengths.count(n) for n in lengths}
    steps, opened = P.sweep(counts, size)
    used = place(counts, steps, size)
    assert len(used) == opened == best_fit_decreasing(lengths, size)
    for pieces in used.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= size


def test_pack_small(spark):
    rows = [(1, None, 0), (1, "", 1), (2, "word " * 3000, 2), (None, "a b", 3), (2, "word " * 3000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length long").repartition(3)
    out = P.pack(df, PATH, 1024).collect()
    ids = np.append(np.frombuffer(P.encoder(PATH)("word " * 3000), "<u4"), np.uint32(2)).astype("<u4")
    for r in [r for r in out if r.doc_id == 2]:
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert sorted(r.length for r in out if r.doc_id in (1, None)) == [1, 1, 3]
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
