"""The audit against a walk of every order row by row."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

from lakelens.llm import audit


def by_hand(rows, labels):
    flags, parts = [], sorted({r[2] or "" for r in rows})
    texts = defaultdict(list)
    for doc_id, text, _ in rows:
        if doc_id is not None:
            texts[text or ""].append(doc_id)
    for doc_id, text, lang in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": doc_id is not None and any(x < doc_id for x in texts[t])}
        mine = [r for r in labels if r[0] is not None and r[0] == doc_id]
        flags.append((lang or "", {k for k, f in fails.items() if f}, any(r[1] == 1 for r in mine), any(r[2] == 1 for r in mine)))
    out, shapley = {}, Counter()
    for part in parts:
        mine = [f for f in flags if f[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                earlier = sum(x in f[1] for f in mine) - len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), earlier, sum(f[1] == {x} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                shapley[part, x] += len(gone)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def tables(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 7, True) for r in rows], "doc_id long, text string, lang string, part string, n int, E boolean").repartition(3)
    return docs, spark.createDataFrame([(*r, "y") for r in labels], "doc_id long, quality int, toxic int, Good string")


def got(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect()}


def test_against_a_walk(spark):
    rng = random.Random(3)
    words = ["a", "bb", "C", "DDD", "e#", "é", "\x0b", "f g", "x|y", *[f"w{i}" for i in range(200)]]
    pool = [" ".join(rng.choices(words, k=rng.choice([0, 1, 60, 99, 100, 130, 400]))) for _ in range(60)] + [" ".join(f"w{i}" for i in range(n)) for n in (99, 100, 101)]
    rows = [(rng.choice([i, i, rng.randint(0, 40)]), rng.choice(pool), rng.choice(["en", "de", "", None])) for i in range(300)]
    rows += [(None, pool[0], "en"), (None, None, None), (5000, None, "fr"), (4999, "", "en"), (4999, "", "en"), (4999, "", "de"), (6000, "x " * 50_000, "de"), *[(9000 + i, "the same text", "en") for i in range(150)]]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in rng.sample(range(300), 150)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1), (4999, 1, 1), (9000, 1, 0), (77777, 1, 1)]
    df = audit.audit(*tables(spark, rows, labels))
    result = got(df)
    assert df.count() == len(result) and result == by_hand(rows, labels)


def test_empty_tables(spark):
    assert audit.audit(*tables(spark, [], [(1, 1, 1)])).count() == 0
    rows = [(1, "one", "en"), (2, "one", None)]
    assert got(audit.audit(*tables(spark, rows, []))) == by_hand(rows, [])


def test_survivors_of_nothing_and_of_all(spark):
    rows = spark.createDataFrame([("en", False, False, True, False, False, 3, 2, 1), ("en", False, False, False, False, False, 5, 0, 0)], "part string, A boolean, B boolean, C boolean, D boolean, E boolean, n long, good long, toxic long")
    by = {r.subset: r.n for r in audit.survivors(rows).collect()}
    assert len(by) == 32 and by[0] == 8 and by[31] == 5 and by[4] == 5 and by[27] == 8
