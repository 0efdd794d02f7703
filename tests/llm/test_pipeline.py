"""All stages on nulls, empties, repeats, an empty table and clashing columns, and held against brute force."""

import random

import corpus_pipeline as P
import pytest

from lakelens.llm import jaccard, quality
from lakelens.llm.decontam import drop_contaminated
from lakelens.llm.secrets import redact_secrets, scan_text

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, kept_id long, TEXT2 string, k long, c0 string"


def groups(rows, words, num, den):
    """Components of the rows' shingle sets, by comparing all with all; rows without words are left out."""
    sets = []
    for r in rows:
        w = (r[1] or "").lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    left, out = {i for i, s in enumerate(sets) if s}, []
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            i = todo.pop()
            seen.add(i)
            near = {j for j in left if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])}
            left -= near
            todo += near
        out.append(seen)
    return out, [i for i, s in enumerate(sets) if not s]


def rows_of(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(8):
        w = [f"w{rng.randint(0, 300)}" for _ in range(rng.choice([4, 30, 90]))]
        for _ in range(6):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = f"e{rng.randint(0, 5)}"
            texts.append(" ".join(v))
    rows = list(enumerate(texts, 10))
    rows += [(1, None), (1, None), (2, ""), (None, texts[0]), (None, texts[1]), (3, texts[2]), (3, texts[9]), (3, texts[9]), (None, "only null ids here one two"), (None, "only null ids here one two"), (4, "x" * 40_000), (5, " \t")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_one_of_each_group_stays(spark, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame([(i, t, "en", "s", 0, 7, "T", 1, "c") for i, t in rows], EXTRA).repartition(3)
    kept = jaccard.keep_one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id is None, r.doc_id, r.text) for r in kept.collect()), key=str)
    components, empty = groups(rows, 5, 80, 100)
    ids = [min((rows[i][0] is None, rows[i][0] or 0) for i in c) for c in components] + [(rows[i][0] is None, rows[i][0] or 0) for i in empty]
    assert sorted((n, d or 0) for n, d, _ in got) == sorted(ids)  # one row a group, of its smallest id, and all without words
    texts = [{(rows[i][0], rows[i][1]) for i in c} for c in components]
    for c in texts:
        assert sum((d, t) in c for _, d, t in got) >= 1
    assert jaccard.keep_one_of_each(df.limit(0)).count() == 0


def test_columns_that_clash(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = spark.createDataFrame([(1, "good calm prose", "x"), (2, 'password = "hunter2hunter2"', "y"), (3, None, None)], "doc_id long, text string, TEXT string")
        bench = spark.createDataFrame([(1, "nothing of this occurs anywhere at all in the rows above")], "item_id long, text string")
        labels = spark.createDataFrame([], "doc_id long, quality int")
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    for stage in (quality.keep_good(df, labels), jaccard.keep_one_of_each(df), drop_contaminated(df, bench), redact_secrets(df)):
        assert stage.columns == ["doc_id", "text", "TEXT"] and len(stage.collect()) == 3


def test_classifier_keeps_what_it_scores_high(spark):
    rows = [(i, ("Good calm prose here. " if i % 2 else "BUY!! NOW!! ") * (i % 7 + 2)) for i in range(300)] + [(None, None), (5, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0, 7, "T", 1, "c") for i, t in rows], EXTRA).repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    scores = quality.score_quality(df, labels).collect()
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in scores if r.score >= 0.3)
    assert quality.keep_good(df.limit(0), labels).count() == 0


def test_whole_pipeline(spark, tmp_path):
    rng = random.Random(3)
    item = " ".join(f"i{k}" for k in range(14))
    good = lambda: "Calm prose about " + " ".join(f"w{rng.randint(0, 5000)}" for _ in range(40)) + "."
    texts = [good() for _ in range(60)]
    rows = list(enumerate(texts)) + [(100 + i, t) for i, t in enumerate(texts[:20])] + [(200, good() + " " + item + " " + good()), (201, good() + ' DB_PASSWORD = "Zx81kQp04Lm7Tt2W"'), (202, None), (203, "")]
    for name, df in {
        "documents": spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, item)], "item_id long, text string"),
    }.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept) == {*range(60), 201, 202, 203}  # no copies, nothing of the benchmark
    assert "Zx81" not in kept[201] and scan_text(kept[201])[1] == []
    pieces = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(kept)
    used = {}
    for r in pieces:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in used.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024
