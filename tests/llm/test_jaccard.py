import numpy as np
import pytest

from lakelens.llm.jaccard import Sizes, join_similar, parities

U64 = np.uint64


def unequal(a, b):
    """Slots in which two classes differ, the larger folded onto the smaller."""
    a, b = sorted((parities(a), parities(b)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count((a ^ b).view(U64)).sum())


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for n in (1, 2, 63, 64, 65, 128, 129, 1000, 5000):
        a = np.unique(rng.integers(0, 2**48, n).astype(U64))
        for cut in (0, 1, n // 7, n // 2):
            b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**48, cut // 2).astype(U64)]))
            if len(b):
                assert unequal(a, b) <= len(np.setxor1d(a, b))


TINY = Sizes(heavy=3, listed=200, shingles=256, postings=256, rows=64, links=8, rounds=2, few=0, slice=3)


@pytest.mark.parametrize(("words", "num", "den", "sizes"), [(4, 85, 100, Sizes()), (5, 80, 100, TINY), (2, 40, 100, TINY), (1, 50, 100, TINY)])
def test_all_links_against_brute_force(spark, words, num, den, sizes):
    rng = np.random.default_rng(words)
    texts = []
    for base in range(12):
        w = [f"w{x}" for x in rng.integers(0, 60 if base % 3 else 4000, int(rng.integers(3, 140)))]
        for _ in range(12):
            v = list(w)
            for at in rng.integers(0, len(v), int(rng.integers(0, 4))):
                v[at] = f"x{rng.integers(0, 9)}"
            texts.append(" ".join(v[: len(v) - int(rng.integers(0, 3))]))
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join_similar(df, words, num, den, sizes).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}
