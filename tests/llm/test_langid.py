"""Language identification: gradients, held-out accuracy, calibration, and rows of all odd kinds."""

import random

import numpy as np
import pyarrow as pa

from lakelens.llm import langid
from lakelens.llm.shared import utf8

SOUNDS = {"xx": ["ba", "lo", "mi", "tu"], "yy": ["sch", "ung", "ö", "tz"], "zz": ["ção", "que", "os", "ar"]}


def made(rng, lang):
    return " ".join("".join(rng.choices(SOUNDS[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 60))).capitalize()


def arrow(texts):
    return utf8(pa.array(texts, pa.string()))


def grams(text):
    """Byte sequences of 2 to 4 within words and their borders, straight from the description."""
    b = text.encode()
    low = bytearray(c + 32 if 65 <= c <= 90 else c for c in b)
    for i in range(1, len(b)):
        if b[i - 1] == 0xC3 and 0x80 <= b[i] <= 0x9E and b[i] != 0x97:
            low[i] = b[i] + 32
    words = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in low).split()
    return sorted(w[i : i + k] for w in (b" " + w + b" " for w in words) for k in langid.ORDERS for i in range(len(w) - k + 1))


def test_subwords_are_those_of_the_words():
    texts = ["Über die Öfen", "", "a", "--", "one  two\nthree, É×", None, "x" * 300]
    buckets, at = langid.subwords(*arrow(texts))
    for i, t in enumerate(texts):
        want = grams(t or "")
        alone = {g: langid.subwords(*arrow([t or ""])) for g in want[:1]}
        assert at[i + 1] - at[i] == len(want)
        for got, _ in alone.values():
            assert sorted(got) == sorted(buckets[at[i] : at[i + 1]])
        # equal sequences fall into equal buckets
        assert len(set(buckets[at[i] : at[i + 1]].tolist())) <= len(set(want))


def test_gradient_steps_lower_the_loss_and_pieces_add_up(monkeypatch):
    rng = random.Random(1)
    langs = [rng.choice(list(SOUNDS)) for _ in range(200)]
    texts = [made(rng, x) for x in langs]
    y = np.array([sorted(SOUNDS).index(x) for x in langs])
    buckets, share, at = langid.shares(*arrow(texts))
    assert np.allclose(np.add.reduceat(share, at[:-1]), 1)
    w = langid.Weights.new(3)
    for _ in range(3):
        langid.learn(w, buckets, share, at, y)
    m = langid.Model(sorted(SOUNDS), w.embed @ w.out, w.bias)
    assert (m.predict(*arrow(texts))[0] == y).mean() > 0.95
    whole = m.logits(*arrow([" ".join(texts)]))
    monkeypatch.setattr(langid, "PIECE", 100)
    assert np.allclose(m.logits(*arrow([" ".join(texts)])), whole, atol=1e-4)


def test_gradient_against_differences():
    """One step of learn() against numeric derivatives, with equal steps for all weights."""
    rng = np.random.default_rng(0)
    texts, y = ["ba lo", "schung ö", "que"], np.array([0, 1, 1])
    buckets, share, at = langid.shares(*arrow(texts))
    w = langid.Weights.new(2)
    w.out[:] = rng.normal(0, 1, w.out.shape)
    w.past_embed[:], w.past_out[:] = 1e12, 1e12  # the step is 1e-6 times the gradient

    bias = w.bias.copy()

    def loss(out, embed):
        hidden = np.stack([(embed[buckets[at[i] : at[i + 1]]] * share[at[i] : at[i + 1], None]).sum(0) for i in range(3)])
        return -np.log(langid._softmax(hidden @ out + bias)[np.arange(3), y]).mean()

    out, embed = w.out.astype(float), w.embed.astype(float)
    before = [out.copy(), embed.copy()]
    w.out, w.embed = out.copy(), embed.copy()
    langid.learn(w, buckets, share, at, y, step=1e3)
    for got, old, which in ((w.out, before[0], 0), (w.embed, before[1], 1)):
        places = [(0, 0), (3, 1)] if which == 0 else [(int(buckets[0]), 2), (int(buckets[-1]), 5)]
        for i, j in places:
            hi, lo = [x.copy() for x in before], [x.copy() for x in before]
            hi[which][i, j] += 1e-5
            lo[which][i, j] -= 1e-5
            want = (loss(*hi) - loss(*lo)) / 2e-5
            assert abs((old[i, j] - got[i, j]) / 1e-3 - want) < 1e-3 + 0.02 * abs(want)


def test_calibration():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 4000)
    x = np.eye(3)[y] * 2 + rng.gumbel(0, 1, (4000, 3))
    t, least = langid.calibrate(x * 5, y, 0.95)
    p = langid._softmax(x * 5 / t)
    best, score = p.argmax(1), p.max(1)
    assert (best == y)[score >= least].mean() >= 0.95 and 0 < least < 1
    sure = score > 0.8
    assert abs((best == y)[sure].mean() - score[sure].mean()) < 0.08
    assert langid.calibrate(x, (x.argmax(1) + 1) % 3, 0.5)[1] == 1.0


def table(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, 0.5) for r in rows], "doc_id long, text string, lang string, LANG_pred string, key int, score double").repartition(3)


def test_whole_tables(spark):
    rng = random.Random(9)
    rows = [(i, made(rng, x), x) for i in range(600) for x in [rng.choice(list(SOUNDS))]]
    rows += [(2000 + i, rows[0][1], rows[0][2]) for i in range(300)]  # one text is a third of all rows
    rows += [(1000, None, "xx"), (1001, "", "yy"), (1002, "12 — 34!", "zz"), (1003, rows[3][1], None), (None, rows[4][1], "xx"), (1, rows[1][1], "yy"), (1004, "ba lo " * 50_000, "xx"), (1005, "ö", None)]
    got = langid.identify(table(spark, rows), most=400).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True) for i in (1000, 1001, 1002))
    assert all(r.lang_pred in SOUNDS and 0 <= r.score <= 1 for r in got if r.doc_id not in (1000, 1001, 1002))
    assert by[None].held_out and by[1003].lang_pred == rows[3][2] and by[1004].lang_pred == "xx"
    held = [(r, rows[r.doc_id][2]) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert len(held) > 50 and np.mean([r.lang_pred == x for r, x in held]) > 0.95
    assert langid.sample(table(spark, rows), 30).count() < 60
    assert langid.sample(table(spark, [(i, "the same text", "en") for i in range(1, 900)]), 30).count() == 1


def test_nothing_to_learn_from(spark):
    rows = [(1, "some text", None), (None, "more", "en"), (2, None, "en")]
    assert {(r.lang_pred, r.score, r.rejected) for r in langid.identify(table(spark, rows)).collect()} == {("und", 0.0, True)}
    assert langid.identify(table(spark, [])).count() == 0
