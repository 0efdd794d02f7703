import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lakelens.llm import gru, lm


def brute(rows):
    cut = lambda t: re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) + [None]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in cut(t))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(cut(t)), sum(c[w] > 0 for w in cut(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in cut(t))) for i, t in rows]


@pytest.mark.parametrize("frequent", [1 << 18, 4])
def test_base_score_and_counts(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rows = [(i, " ".join(f"W{(i * k) % 13}" for k in range(i % 40))) for i in range(60)] + [(None, "W1 w2"), (7, None), (7, ""), (8, "É é\x0b\x0cunseen"), (0, "w1 " * 3000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").repartition(3)
    key = lambda r: (str(r[0]), r[2], r[3], round(r[5], 6))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.score_texts(df, every=1).collect()), key=key)
    for g, w in zip(got, sorted(brute(rows), key=key), strict=True):
        assert g[:5] == w[:5]
        assert abs(g[5] - w[5]) < 1e-6


def test_score_is_a_probability():
    net = gru.Net.new()
    h = np.random.default_rng(1).standard_normal((1, gru.STATE)).astype(np.float32)
    p = net.log_probability(np.repeat(h, gru.WORDS, 0), np.arange(gru.WORDS))
    assert abs(np.exp(p.astype(float)).sum() - 1) < 1e-4


def test_gradients():
    rng = np.random.default_rng(3)
    net = gru.Net.new(3)
    before, target = rng.integers(0, 50, (3, 5)), rng.integers(0, 50, (3, 5))
    on = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], bool)
    h = np.zeros((3, gru.STATE), np.float32)
    net = gru.Net(*[a.astype(np.float64) for a in net.arrays()])
    m = on.sum()
    _, grads, _ = net.learn(before, target, on, h.astype(np.float64))
    for a, g in zip(net.arrays(), grads, strict=True):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, eps = a[i], 1e-5
        a[i] = old + eps
        up = net.learn(before, target, on, h)[0]
        a[i] = old - eps
        down = net.learn(before, target, on, h)[0]
        a[i] = old
        assert abs((up - down) / (2 * eps) / m - g[i]) < 1e-4


def test_places_of_texts_that_end_are_taken_by_the_next():
    rng = np.random.default_rng(2)
    n = np.array([gru.STEPS * k for k in range(1, 41)] + [0, 1])
    offsets = np.concatenate([[0], np.cumsum(n)])
    net = gru.Net.new(2)
    adam = gru.Adam(net)
    assert gru.train(net, rng.integers(0, 50, offsets[-1]), offsets, adam, rows=4) == n.sum()
    assert adam.t <= 1.03 * sum(range(1, 41)) / 4  # windows; groups that end each for itself take 220


def test_large_outputs():
    rng = np.random.default_rng(6)
    net = gru.Net.new(6)
    net.word *= 500
    assert not net.bounded()
    h, y = np.tanh(rng.standard_normal((64, gru.STATE)) * 3).astype(np.float32), rng.integers(0, gru.WORDS, 64)
    got = net.log_probability(h, y)
    for a, k, p in zip(h.astype(float), y, got, strict=True):
        want = 0.0
        for x, i in ((a @ net.group + net.group_bias, k // gru.SIZE), (a @ net.word[k // gru.SIZE] + net.word_bias[k // gru.SIZE], k % gru.SIZE)):
            want += x[i] - x.max() - np.log(np.exp(x - x.max()).sum())
        assert abs(p - want) < 1e-3 * max(1, abs(want))


def test_sums_of_runs():
    x = np.random.default_rng(8).standard_normal((300, 5))
    for first in ([0], [0, 1, 2, 40, 56, 71, 299], list(range(300))):
        got = gru.sums_of_runs(x, np.array(first))
        assert np.allclose(got, [x[a:z].sum(0) for a, z in zip(first, [*first[1:], 300], strict=True)])


def test_hashes_that_begin_alike_are_found():
    rng = np.random.default_rng(9)
    h = np.unique(np.concatenate([rng.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2), np.uint64(7 << 50) + np.arange(9, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)]))
    v = lm.Vocabulary(h, np.arange(1, len(h) + 1), np.arange(len(h)) % gru.WORDS, np.zeros(gru.WORDS), 1, 1, 1, 1)
    ask = np.concatenate([h, h + np.uint64(1), np.uint64(7 << 50) + np.arange(20, dtype=np.uint64)])
    have = {int(x): i for i, x in enumerate(h)}
    on, c, word = v.find(ask)
    for i, x in enumerate(ask):
        k = have.get(int(x))
        assert (bool(on[i]), c[i], word[i]) == ((False, 0, gru.WORDS - 1) if k is None else (True, k + 1, k % gru.WORDS))


def test_windows_carry_the_state():
    rng = np.random.default_rng(5)
    net = gru.Net.new(5)
    ids = rng.integers(0, gru.WORDS, 300)
    offsets = np.array([0, 200, 200, 201, 300])
    got = net.score(ids, offsets)
    for k in range(4):
        h, p = np.zeros((1, gru.STATE), np.float32), 0.0
        seq = ids[offsets[k] : offsets[k + 1]]
        for t in range(len(seq)):
            x = (net.embed[[seq[t - 1] if t else gru.WORDS]]) @ net.into + net.bias
            h = net.step(x, h)[0]
            p += net.log_probability(h, seq[t : t + 1])[0]
        assert abs(got[k] - p) < 1e-2


def test_every_training_text_is_learnt_from(spark):
    ids = [*range(500), 7, 7, None]
    for every in (1, 2, 5):
        got = lm.turns(ids, every)
        assert [t < 0 for t in got] == list(lm.held_out(ids)) and set(got) == {-1, *range(every)}
    # a table of one training text: its order is learnt, not just the frequencies of its words
    train = next(i for i in ids if not lm.held_out([i])[0])
    text = " ".join(f"w{k % 11}" for k in range(20_000))
    r = lm.score_texts(spark.createDataFrame([(train, text), (None, text)], "doc_id long, text string")).collect()
    assert all(x.score > x.base_score + 500 for x in r)


def test_empty(spark):
    assert lm.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
