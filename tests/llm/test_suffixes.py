import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lakelens.llm import suffixes as S


@pytest.mark.parametrize("seed", range(30))
def test_suffix_array(seed):
    rng = random.Random(seed)
    s = [rng.randint(1, rng.choice([1, 2, 5, 200])) for _ in range(rng.randint(0, 200))]
    got = S.suffix_array(np.array(s, np.int64))
    assert got.tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def brute(texts, n=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + n] for r in raw for i in range(len(r) - n + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(r) else 0
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts_of(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    common, base = prose(60), prose(200)
    out = [None, "", "x", "a" * 199, "a" * 200, "a" * 201, "ab" * 400, base, base, base[:300] + "!" + base[301:], base[3:], prose(50) + common, common + prose(9), prose(30) + common + prose(80) + common, common[:202], common[:150]]
    for _ in range(12):
        k = rng.randint(0, len(base) - 260)
        out.append(prose(rng.randint(0, 40)) + base[k : k + rng.randint(190, 260)] + prose(rng.randint(0, 40)))
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    texts = texts_of(hot)
    rows = [(i if i != 4 else None, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(df).collect())
    want = sorted((-1 if i == 4 else i, *w) for i, w in enumerate(brute(texts)))
    assert got == want


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
