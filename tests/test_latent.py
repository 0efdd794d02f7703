"""Learnt vectors: singular values against numpy, the same each time, and topics that share no word."""

import random
from itertools import count

import numpy as np
import pytest

from lakelens.operators import evals as E
from lakelens.operators import latent


@pytest.fixture
def keep(spark, tmp_path):
    names = count()

    def write(df, label):
        path = f"file://{tmp_path}/{label}-{next(names)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return write


def corpus():
    """Six topics of two dialects each; a dialect's words are its own, long texts mix both of a topic."""
    rng = random.Random(6)
    rows = []
    for i in range(240):
        topic, kind = i % 6, i // 6 % 4
        words = [f"t{topic}{side}w{j}" for side in ("ab" if kind > 1 else "a" if kind == 0 else "b") for j in range(8)]
        rows.append((i, " ".join(rng.choices(words, k=6 if kind < 2 else 30) + rng.choices([f"noise{j}" for j in range(60)], k=3))))
    return rows


def test_singular_values_and_neighbours(spark, keep):
    rows = spark.createDataFrame([*corpus(), (900, None), (901, ""), (902, "unseen words")], "id long, text string").repartition(3)
    model = latent.learn(rows, "id", "text", keep, rank=10, rounds=3)
    texts = corpus()
    words = sorted({w for _, t in texts for w in t.split()})
    df = {w: sum(w in t.split() for _, t in texts) for w in words}
    words = [w for w in words if df[w] >= 2]
    a = np.array([[(1 + np.log(t.split().count(w))) * np.log(243 / df[w]) if w in t.split() else 0.0 for w in words] for _, t in texts])
    want = np.linalg.svd(a, compute_uv=False)[:10]
    assert np.allclose(model.values[:6], want[:6], rtol=0.02) and model.terms.count() == len(words)
    got = {r.id: np.array(r.embedding) for r in model.embed(rows, "id", "text").collect()}
    assert set(got) == set(range(240)) and all(abs(np.linalg.norm(v) - 1) < 1e-5 for v in got.values())
    again = latent.learn(rows.repartition(2), "id", "text", keep, rank=10, rounds=3)
    assert all(np.allclose(got[r.id], r.embedding, atol=1e-4) for r in again.embed(rows, "id", "text").collect())

    # short texts of one dialect ask for those of the other: no word in common but noise
    hashed = {}
    tokens = rows.selectExpr("id", "split(coalesce(text, ''), ' ') as tokens")
    for r in E.hash_embedding(tokens, "id", 256).collect():
        hashed.setdefault(r.id, np.zeros(256))[int(r.dim)] = r.x

    def share(v):
        hits = []
        for q in (i for i in range(240) if i // 6 % 4 == 0):
            others = [i for i in range(240) if i // 6 % 4 == 1]
            best = sorted(others, key=lambda i: -float(v[i] @ v[q]))[:5]
            hits += [i % 6 == q % 6 for i in best]
        return np.mean(hits)

    assert share(got) > 0.75 and share(got) > share(hashed) + 0.3


def test_few_texts(spark, keep):
    rows = spark.createDataFrame([(1, "a b"), (2, "a b c"), (3, "d"), (4, "d")], "id long, text string")
    model = latent.learn(rows, "id", "text", keep, rank=4, rounds=1)
    assert {r.id for r in model.embed(rows, "id", "text").collect()} == {1, 2, 3, 4} and (model.values[2:] < 1e-6).all()
    none = latent.learn(rows.limit(0), "id", "text", keep, rank=3, rounds=1)
    assert none.embed(rows, "id", "text").count() == 0


def test_vectors_travel_once_a_part_and_term(spark, keep):
    words = [f"w{j}" for j in range(60)]
    texts = [(i, " ".join(words[j] for j in range(60) if (i + j) % 3)) for i in range(300)]
    rows = spark.createDataFrame([*texts, (0, "w0 more"), (1, "more")], "id long, text string").repartition(3)
    sizes = []

    def counted(df, name):
        out = keep(df, name)
        sizes.append(out.count())
        return out

    model = latent.learn(rows, "id", "text", counted, rank=5, rounds=2, most=0.9)
    assert max(sizes) < 302 + 4 * 62 < 300 * 40  # texts, and terms of four parts; not a row an occurrence
    joined = dict(texts) | {0: f"{texts[0][1]} w0 more", 1: f"{texts[1][1]} more"}  # rows of a key are one text
    df = {w: sum(w in t.split() for t in joined.values()) for w in [*words, "more"]}
    a = np.array([[(1 + np.log(t.split().count(w))) * np.log(302 / df[w]) if w in t.split() else 0.0 for w in df] for t in joined.values()])
    assert np.allclose(model.values[:2], np.linalg.svd(a, compute_uv=False)[:2], rtol=0.02)
