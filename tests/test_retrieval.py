import math

import pytest
from pyspark.sql import functions as F

from lakelens.facade import BadCall, Corpus, Registry
from lakelens.operators import evals as E
from lakelens.operators import hybrid as H
from lakelens.operators import lexical as L

PROBE = ["attention is all you need", "chain of thought prompting", "graph attention networks", "attention for translation", "self-attention heads attend", "the self is an attention thing", "Été networks"]


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("networks", "network"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("hopefulness", "hope"), ("goodness", "good"), ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("attend", "attend")])
def test_published_stems(word, want):
    assert L.stem(word) == want


def test_bm25_of_the_probe_corpus(spark):
    rows = spark.createDataFrame(list(enumerate(PROBE, 1)), "id long, text string")
    index = L.token_index(rows, "id", "text", tokenizer="porter")
    score = lambda q: {r.id: r.score for r in L.bm25(index, "id", L.any_phrases(q, "porter"), 10).collect()}
    assert score("networks") == pytest.approx({7: 0.98185256, 3: 0.86730310}, abs=1e-6)
    assert score("networks networks")[7] == pytest.approx(2 * 0.98185256, abs=2e-6)
    assert score("self-attention") == pytest.approx({5: 1.44445144}, abs=1e-6)
    assert set(score("ete")) == {7}
    assert all(0 < s < 1e-5 for s in score("attention").values()) and len(score("attention")) == 5
    assert score("!! \x00") == {} and score(" ") == {}


@pytest.mark.parametrize("query", ['"', '""', "AND OR NOT", "a\x00b", "\x7f", "NEAR(", "*", "col:", "é", "(" * 50, "' OR 1=1"])
def test_hostile_queries(spark, query):
    rows = spark.createDataFrame([(1, "a b"), (2, "col near")], "id long, text string")
    index = L.token_index(rows, "id", "text")
    L.bm25(index, "id", L.any_phrases(query), 5).collect()
    phrases = L.all_phrases(query)
    if phrases:
        L.bm25(index, "id", phrases, 5, every=True).collect()


def test_phrases():
    assert L.any_phrases("self-attention  a\x00b !!") == [["self", "attention"], ["ab"]]
    assert L.all_phrases('graph "two words" a') == [["graph"], ["two", "words"], ["a"]]
    assert L.all_phrases("  !") is None


def search_corpus(spark):
    chunks = [("2401.00001#0", "2401.00001", "attention is all you need"), ("2401.00001#1", "2401.00001", "chain of thought prompting"), ("2401.00002#0", "2401.00002", "graph attention networks"), ("1901.00003#0", "1901.00003", "attention for translation")]
    c = spark.createDataFrame(chunks, "chunk_id string, doc_id string, text string")
    docs = spark.createDataFrame([("2401.00001", "a", 20240115, "v1"), ("2401.00002", "b", 20240201, None), ("1901.00003", "c", 20190101, "v3")], "doc_id string, title string, day int, version string")
    facets = spark.createDataFrame([("2401.00001", "category", "cs.CL"), ("2401.00001", "category", "cs.AI"), ("2401.00002", "category", "cs.DS"), ("1901.00003", "category", "cs.CL")], "doc_id string, key string, value string")
    vectors = spark.createDataFrame([("2401.00001#0", [1.0, 0.0]), ("2401.00001#1", [0.0, 1.0]), ("2401.00002#0", [0.6, 0.8]), ("1901.00003#0", [0.8, 0.6])], "chunk_id string, embedding array<double>")
    return H.HybridIndex(c, docs, facets, L.token_index(c, "chunk_id", "text"), vectors, lambda q: [1.0, 0.0])


def lexical(index, query, filters=H.Filters(), k=10):
    scope = filters.documents(index.documents, index.facets)
    scope = None if scope is None else index.chunks.join(scope, "doc_id", "left_semi")
    return [r.chunk_id for r in L.bm25(index.tokens, "chunk_id", L.any_phrases(query), k, scope).orderBy("rank").collect()]


def test_lexical_filters(spark):
    i = search_corpus(spark)
    got = lexical(i, "attention networks")
    assert got[0] == "2401.00002#0" and set(got) == {"2401.00002#0", "2401.00001#0", "1901.00003#0"}
    assert set(lexical(i, "attention", H.Filters.of_papers("cs.CL"))) == {"2401.00001#0", "1901.00003#0"}
    assert set(lexical(i, "attention", H.Filters.of_papers(year_min=2024))) == {"2401.00001#0", "2401.00002#0"}
    assert lexical(i, "attention", H.Filters.of_papers(year_max=2019)) == ["1901.00003#0"]
    assert len(lexical(i, "attention", k=1)) == 1
    many = tuple(f"x{n}" for n in range(1500)) + ("2401.00001",)
    assert lexical(i, "attention", H.Filters(doc_ids=many)) == ["2401.00001#0"]


def test_fusion(spark):
    leg = lambda ids: spark.createDataFrame([(x, n) for n, x in enumerate(ids, 1)], "id string, rank int")
    got = {r.id: (r.score, r.leg) for r in H.fuse({"vector": leg("ab"), "bm25": leg("bc")}, "id").collect()}
    assert got["a"] == (pytest.approx(1 / 61), "vector") and got["b"] == (pytest.approx(1 / 62 + 1 / 61), "both") and got["c"] == (pytest.approx(1 / 62), "bm25")
    tied = [r.id for r in H.fuse({"bm25": leg("x"), "vector": leg("y")}, "id").orderBy("rank").collect()]
    assert tied == ["x", "y"]


def test_hybrid(spark):
    i = search_corpus(spark)
    rows = H.search(i, "attention networks", 2).orderBy("rank").collect()
    assert len(rows) == 2 and rows[0].leg == "both" and {r.version for r in rows} <= {"v1", None, "v3"}
    assert H.search(i, "  ") is None and H.search(i, "attention", filters=H.Filters(doc_ids=())) is None

    def down(query):
        raise OSError("no embedder")

    i.embed = down
    assert {r.leg for r in H.search(i, "attention").collect()} == {"bm25"}

    def broken(query):
        raise KeyError("a bug")

    i.embed = broken
    with pytest.raises(KeyError):
        H.search(i, "attention")


def test_rerank(spark):
    i = search_corpus(spark)
    rows = H.search(i, "graph networks", 2, scorer=H.overlap_scorer).orderBy("rank").collect()
    assert rows[0].chunk_id == "2401.00002#0" and rows[0].rerank_score == 1.0 and rows[1].rerank_score == 0.0

    def gone(query, text):
        raise H.RerankUnavailable

    assert H.search(i, "graph networks", 2, scorer=gone).count() == 2


def test_batches_and_pacing():
    class Large(Exception):
        pass

    def send(texts):
        if sum(map(len, texts)) > 4:
            raise Large
        return list(texts)

    assert H.batches(["ab", "cd", "e", "f"], send, Large) == ["ab", "cd", "e", "f"]
    with pytest.raises(Large):
        H.batches(["abcdef"], send, Large)
    now = [0.0]
    b = H.TokenBucket(60, lambda: now[0])
    assert [b.reserve(2), b.reserve(1), b.reserve(1)] == [0.0, 2.0, 3.0]
    now[0] = 100.0
    assert b.reserve(5) == 0.0


def test_metrics(spark):
    def scores(ranking, expected, k):
        r = spark.createDataFrame([("q", "c", "t", x, n) for n, x in enumerate(ranking, 1)], "question string, config string, type string, chunk string, rank int")
        e = spark.createDataFrame([("q", x) for x in expected], "question string, chunk string")
        return E.scores(r, e, k, F.substring_index("chunk", "#", 1)).first()

    r = scores(["a#1", "c#1", "b#1", "d#1"], ["c#1"], 3)
    assert r.recall == 1 and r.mrr == 0.5 and r.ndcg == pytest.approx(1 / math.log2(3)) and r.paper_recall == 1
    r = scores(["a#1", "b#1", "c#1", "d#1"], ["d#1"], 3)
    assert (r.recall, r.mrr, r.ndcg, r.paper_recall) == (0, 0, 0, 0)
    r = scores(["a#1", "x#1"], ["a#1", "b#1"], 3)
    assert r.recall == 0.5 and r.ndcg == pytest.approx(1 / (1 + 1 / math.log2(3)))
    assert scores(["a#2"], ["a#1"], 3).paper_recall == 1


def test_bootstrap(spark):
    each = spark.createDataFrame([(n, "c", "t", float(n % 4 == 0)) for n in range(400)], "question long, config string, type string, recall double")
    a, b = (E.bootstrap(each, "recall", 300).first() for _ in range(2))
    assert a == b and a.low < 0.25 < a.high and abs(a.mean - 0.25) < 0.02 and 0.05 < a.high - a.low < 0.12


def test_knn_batch_in_blocks(spark, monkeypatch):
    import random

    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(60, None), (61, [1.0]), (62, [0.0] * 4)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    q = v.filter("vec_id % 20 = 0 and vec_id < 60")
    whole = sorted(map(tuple, E.knn_batch(q, v, 5).collect()))
    monkeypatch.setattr(E, "BLOCK", 4)
    assert sorted(map(tuple, E.knn_batch(q, v, 5).collect())) == whole and len(whole) == 15
    for qid in (0, 20, 40):
        one = H.knn(v.filter("vec_id < 60"), "vec_id", dict(rows)[qid], 5).orderBy("rank").collect()
        got = [x for x in whole if x[0] == qid]
        assert {r.vec_id for r in one} == {x[1] for x in got}


def test_knn_batch_scores_in_bounded_steps(spark, monkeypatch):
    """However many rows a batch has, a task holds SCORES scores at a time; equal scores go to the smaller id over all steps."""
    import random

    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(-1, 2)) for _ in range(3)]) for i in range(900)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)
    q = v.filter("vec_id % 50 = 0")
    whole = sorted(map(tuple, E.knn_batch(q, v, 7).collect()))
    held, merge = spark.sparkContext.accumulator(0), E._merge

    def seen(best_s, best_v, s, vec):
        assert s.size <= 64
        held.add(1)
        return merge(best_s, best_v, s, vec)

    monkeypatch.setattr(E, "SCORES", 64)
    monkeypatch.setattr(E, "_merge", seen)
    assert sorted(map(tuple, E.knn_batch(q, v, 7).collect())) == whole and len(whole) == 18 * 7 and held.value > 100
    unit = {i: [x / (sum(y * y for y in e) ** 0.5 or 1) for x in e] for i, e in rows}
    for a in (0, 50, 850):
        best = sorted((-round(sum(x * y for x, y in zip(unit[a], unit[b], strict=True)), 6) + 0.0, b) for b in unit)[:7]
        assert [x[1] for x in sorted(w for w in whole if w[0] == a)] == sorted(b for _, b in best)


def test_tools(spark):
    i = search_corpus(spark)
    flagged = spark.createDataFrame([("2401.00001", "cs.CL", 2024, True, "CC"), ("2401.00002", "cs.DS", 2023, False, None)], "paper_id string, category string, year int, indexed boolean, license string")
    chunks = spark.createDataFrame([("2401.00001", 1, 1, 2, 5), ("2401.00001", 2, 3, 3, 5)], "paper_id string, seq int, page_start int, page_end int, n_tokens int")
    r = Registry(Corpus(flagged, chunks, i))
    assert r.call("query_metadata", {"op": "count_papers", "year_min": 2020}).first().n == 1
    assert r.call("query_metadata", {"op": "paper_facets", "paper_id": "2401.00001"}).first().last_page == 3
    assert r.call("query_metadata", {"op": "corpus_stats"}).first().papers == 1
    assert r.call("search_corpus", {"query": "attention"}, scope=()) is None
    assert r.call("read_paper", {"paper_id": "2401.00001", "first": 3}).count() == 1
    for name, args in (("nope", {}), ("query_metadata", {"op": "drop"}), ("query_metadata", {"op": "corpus_stats", "category": "x"}), ("search_corpus", {"query": "a", "scope": ()}), ("search_corpus", {"query": "a", "k": 99})):
        with pytest.raises(BadCall):
            r.call(name, args)
    with pytest.raises(BadCall):
        r.call("read_paper", {"paper_id": "2401.00002"}, scope=("2401.00001",))


# ---------------------------------------------------------------- inverted index

_WORDS = ["the", "a", "graph", "été", "net", "works", "x9", "İstanbul", "the-and"]


def _made(n):
    import random

    rng = random.Random(n)
    rows = [(i, " ".join(rng.choices(_WORDS, k=rng.randint(0, 40)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "graph " * 5000), *[(n + 10 + i, "the graph the graph") for i in range(n // 2)]]


@pytest.mark.parametrize(("tokenizer", "portion"), [("plain", 50), ("porter", 1 << 19)])
def test_inverted_index_answers_as_a_scan_does(spark, tmp_path, monkeypatch, tokenizer, portion):
    from lakelens.operators import inverted

    monkeypatch.setattr(inverted, "PORTION", portion)
    rows = spark.createDataFrame(_made(120), "id long, text string").repartition(5)
    scan = L.token_index(rows, "id", "text", tokenizer=tokenizer)
    index = inverted.build(rows, "id", "text", path=f"file://{tmp_path}/index", tokenizer=tokenizer, buckets=4, spread=2)
    scope = rows.filter("id % 3 = 0")
    asked = [("the-graph works", False, None), ("net net été graph-graph", False, scope), ("nothing here", False, None), ('"the graph the" net', True, scope)]
    for query, every, within in asked:
        phrases = (L.all_phrases if every else L.any_phrases)(query, tokenizer)
        got, want = (sorted(tuple(r) for r in L.bm25(i, "id", phrases, 15, within, every).collect()) for i in (index, scan))
        assert got == want, query
    vocabulary = {(r.term, r.n_docs, r.n_times) for r in index.terms().collect()}
    by_hand = {}
    for r in scan.collect():
        for t in set(r.tokens):
            d, n = by_hand.get(t, (0, 0))
            by_hand[t] = d + 1, n + r.tokens.count(t)
    assert vocabulary == {(t, d, n) for t, (d, n) in by_hand.items()}


def test_inverted_index_reads_only_the_buckets_it_is_asked_for(spark, tmp_path):
    from lakelens.operators import inverted

    rows = spark.createDataFrame(_made(60), "id long, text string")
    index = inverted.build(rows, "id", "text", path=f"file://{tmp_path}/index", buckets=8)
    plan = index.postings(["graph"])
    assert {f.split("bucket=")[1].split("/")[0] for f in plan.select("_metadata.file_path").distinct().toPandas().file_path} == {str(inverted.bucket_of("graph", 8))}
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in text or "PartitionFilters: [bucket" in text or "bucket#" in text.split("PartitionFilters")[1].split("]")[0]
    assert "term" in text.split("PushedFilters")[1].split("]")[0]


def test_inverted_index_deals_large_buckets(spark, tmp_path):
    """A term of all rows is cut over tasks by its size, each of which writes a file of its bucket."""
    from lakelens.operators import inverted

    rows = spark.range(0, 4000, 1, 8).select("id", F.concat_ws(" ", F.lit("common"), F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.concat(F.lit("w"), F.abs(F.xxhash64("id", i)).cast("string")))).alias("text"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        index = inverted.build(rows, "id", "text", path=f"file://{tmp_path}/index", buckets=1)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    held = index.postings(["common"]).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.sum(F.size("keys")).alias("n")).collect()
    assert sum(r.n for r in held) == 4000 and len(held) > 4 and max(r.n for r in held) < 4000 / 2
    assert index.stats().first().asDict() == {"n_docs": 4000, "n_tokens": 4000 * 51}


def test_inverted_index_of_nothing(spark, tmp_path):
    from lakelens.operators import inverted

    index = inverted.build(spark.createDataFrame([], "id string, text string"), "id", "text", path=f"file://{tmp_path}/index")
    assert L.bm25(index, "id", [["graph"]], 5).collect() == [] and index.terms().count() == 0
