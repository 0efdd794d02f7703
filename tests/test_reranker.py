"""The learned reranker: gradients, trees, and gains on questions that it did not see."""

import random

import numpy as np
from pyspark.sql import functions as F

from lakelens.operators import hybrid as H
from lakelens.operators import reranker as R


def graded(n=120, each=12):
    """The best text holds the question's words side by side, good ones hold them apart, all others some of them; the order is noise."""
    rng = random.Random(5)
    words = [f"word{i}" for i in range(80)]
    rows = []
    for q in range(n):
        asked = rng.sample(words, 3)
        places = rng.sample(range(1, each + 1), each)
        for i, place in enumerate(places):
            filler = rng.choices([w for w in words if w not in asked], k=rng.randint(10, 60))
            if i == 0:
                at = rng.randint(0, len(filler))
                text, grade = filler[:at] + asked + filler[at:], 2
            elif i < 3:
                text, grade = [*filler, *rng.sample(asked, 3)], 1
                for _ in range(8):
                    rng.shuffle(text)
                    if all((a, b) not in zip(text, text[1:], strict=False) for a, b in zip(asked, asked[1:], strict=False)):
                        break
            else:
                text, grade = [*filler, *asked[: rng.randint(0, 2)]], 0
                rng.shuffle(text)
            rows.append((" ".join(asked), " ".join(text), place, grade))
    return rows


def test_gradients_move_the_better_up():
    g, h = R.gradients(np.array([0.0, 1.0, 0.0]), np.array([2.0, 0.0, 1.0]), np.array([1, 2, 3]))
    assert g[0] > 0 > g[1] and abs(g.sum()) < 1e-12 and (h >= 0).all()
    assert not R.gradients(np.zeros(3), np.ones(3), np.arange(3))[0].any()
    assert R.ndcg(np.array([3, 2, 1]), np.array([2.0, 1.0, 0.0]), np.arange(3)) == 1.0 and R.ndcg(np.zeros(2), np.zeros(2), np.arange(2)) == 0.0


def test_trees_against_plain_walks():
    rng = np.random.default_rng(1)
    x = np.zeros((400, len(R.FEATURES)))
    x[:, :3] = rng.random((400, 3))
    grade = (x[:, 0] + 0.3 * x[:, 1] > 0.8).astype(float)
    q = np.repeat(np.arange(40), 10)
    ranker = R.fit(q, x, grade, np.tile(np.arange(10), 40), trees=20)
    s = ranker.score(x)

    def walk(row):
        total = 0.0
        for at, cut, leaf in zip(ranker.at, ranker.cut, ranker.leaf, strict=True):
            n = 0
            while n < len(at):
                n = 2 * n + 1 + int(row[at[n]] > cut[n])
            total += leaf[n - len(at)]
        return total

    assert np.allclose([walk(r) for r in x[:50]], s[:50])
    pairs = [(i, j) for i in range(400) for j in range(i - i % 10, i - i % 10 + 10) if grade[i] > grade[j]]
    assert np.mean([s[i] > s[j] for i, j in pairs]) > 0.95
    assert len(R.fit(q[:0], x[:0], grade[:0], q[:0]).at) == 0


def test_gains_on_held_out_questions(spark):
    rows = spark.createDataFrame(graded(), "question string, text string, rank int, grade int").repartition(3)
    ranker = R.learn(rows, trees=30)
    got = R.measured(ranker, rows).agg(F.avg("before").alias("b"), F.avg("after").alias("a"), F.count(F.lit(1)).alias("n")).first()
    overlap = R.features(rows.filter(R.held(F.col("question")))).withColumn("score", F.col("x")[0]).toPandas()
    plain = np.mean([R.ndcg(t["score"].to_numpy(), t["grade"].to_numpy(float), t["rank"].to_numpy()) for _, t in overlap.groupby("question")])
    assert got.n > 10 and got.a > got.b + 0.2 and got.a > plain and got.a > 0.9
    # the same scores through hybrid.rerank
    q = rows.filter(R.held(F.col("question"))).first()["question"]
    one = rows.filter(F.col("question") == q)
    top = H.rerank(one.drop("question"), q, 3, ranker.scorer()).orderBy("rank").collect()
    want = R.features(one).withColumn("s", ranker.column(F.col("x"))).orderBy(F.desc("s"), "rank").limit(3).collect()
    assert [r.fused_rank for r in top] == [r["rank"] for r in want] and top[0].grade == 2


def test_odd_candidates(spark):
    rows = spark.createDataFrame([("", "a text", 1, 0), ("a b", None, 2, 1), ("a b", "", 3, 0), (None, "x", 4, 1)], "question string, text string, rank int, grade int")
    assert all(len(r.x) == len(R.FEATURES) and None not in r.x for r in R.features(rows).collect())
    assert R.learn(rows.limit(0)).score(np.zeros((2, len(R.FEATURES)))).tolist() == [0.0, 0.0]
