import pytest
from pyspark.sql import functions as F

from lakelens.functions import text as T
from lakelens.operators import guard as G
from lakelens.operators import ingest as I
from lakelens.operators import ordered as O
from lakelens.operators import themes as H
from lakelens.operators import traces as C
from lakelens.sources import readers as S
from lakelens.sources import writers as W
from lakelens.streaming import runs as stream


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [(r"\textsc{DiARC}", "DiARC"), (r"{\'E}douard", "Édouard"), (r"Universit\'e de", "Université de"), (r"\v{S}krtel", "Škrtel"), (r"Stra\ss e", "Straße"), (r"$\alpha_1$ \& b", r"$\alpha_1$ & b"), ("a\n  b", "a b"), (r"na\"{\i}ve", "naïve"), (r"\O rsted", "Ørsted"), (r"\varepsilon", r"\varepsilon"), (None, None)])
def test_latex(raw, want):
    assert T.plain_latex(raw) == want


def test_names_and_venues(spark):
    assert one(spark, T.trim_authors(F.col("a"), 2), a="A B, C D and E F") == "A B, C D +1"
    assert one(spark, T.category_name(F.col("a")), a="cs.LG") == "Machine Learning" and one(spark, T.category_name(F.col("a")), a="math.NA") is None
    v = lambda j, d, c: tuple(one(spark, T.venue(F.col("j"), F.col("d"), F.col("c")), j=j, d=d, c=c))
    assert v("", "", "Accepted at NeurIPS") == ("NEURIPS", 3) and v("", "", "on ICML") == ("ICML", 2)
    assert v("Some Journal, 3", "", "") == ("Some Journal", 1) and v("", "10.1038/x", "") == ("Nature", 3) and v("", "", "") == (None, 0)
    assert v("", "10.9/1", "") == ("published", 1)
    assert one(spark, T.author_key(F.col("a"), F.col("b")), a=" Lin", b="Ada") == "lin|a"


def test_dates(spark):
    assert one(spark, T.submitted_date(F.col("a")), a="Mon, 3 Aug 2026 12:00:00 GMT") == "2026-08-03" and one(spark, T.submitted_date(F.col("a")), a="junk") == ""
    assert one(spark, T.first_version_year(F.col("a")), a="Mon, 3 Aug 2026 12:00:00 GMT") == 2026


def test_addresses():
    assert T.budget_address("2001:db8::1") == "2001:db8::/64" and T.budget_address("::ffff:1.2.3.4") == "1.2.3.4" and T.budget_address("unknown") == "unknown"
    import ipaddress

    net = [ipaddress.ip_network("10.0.0.0/8")]
    assert T.client_address("10.0.0.1", "1.2.3.4, 5.6.7.8, 10.1.1.1", net) == "5.6.7.8"
    assert T.client_address("9.9.9.9", "1.2.3.4", net) == "9.9.9.9" and T.client_address(None, "1.2.3.4", net) == "unknown"
    assert T.client_address("10.0.0.1", "10.2.2.2, 10.3.3.3", net) == "10.2.2.2"


def test_words_and_headings(spark):
    assert set(one(spark, T.words(F.col("a")), a="Embeddings embedding the GPT-4 model's")) == {"embedding", "gpt-4", "model"}
    assert one(spark, T.distinctive_terms(F.col("a")), a="LoRA and GRPO in SWE-bench, DISTRIBUTED Low-Level Plain") == ["LoRA", "GRPO", "SWE-bench"]
    assert one(spark, T.headings(F.col("a")), a="# One\ntext\n### **Two** \n#no") == ["One", "**Two**"]
    assert one(spark, T.clean_heading(F.col("a")), a="**for** **_m_ scales** <u>x</u>") == "for _m_ scales x"
    assert one(spark, T.clean_prompt(F.col("a")), a="<system-reminder>x\ny</system-reminder> do <b>this</b>\n now") == "do this now"
    assert one(spark, T.usd(F.col("a").cast("double")), a="0.000659") == "$0.000659" and one(spark, T.millis(F.col("a").cast("double")), a="1234") == "1.2 s"


def test_best_of_a_board(spark):
    rows = spark.createDataFrame([("a", 0.9301, 4.1e-8), ("a", 0.9302, 4.2e-8), ("a", 0.89, 5.0e-8), ("b", 0.1, 1.0)], "board string, pool double, usd double")
    got = rows.select("pool", T.is_best(F.col("pool"), ["board"]).alias("p"), T.is_best(F.col("usd"), ["board"], lower=True, exact=True).alias("u")).collect()
    assert {r.pool: (r.p, r.u) for r in got} == {0.9301: (True, True), 0.9302: (True, False), 0.89: (False, False), 0.1: (True, True)}
    spent = C.spend(spark.createDataFrame([("x", 0.000659), ("x", 0.0000004), ("x", None)], "k string, cost double"), "k").first()
    assert (spent.usd, spent.cents, spent.runs) == (0.0006594, 0, 3)


def test_citation_ids(spark):
    ids = lambda t: one(spark, I.cited_ids(F.col("t"), F.lit("2607.00001"), "2608"), t=t)
    assert ids("arXiv:2505.09388 and https://arxiv.org/pdf/2401.00002v2") == ["2401.00002", "2505.09388"]
    assert ids("Report. 2505.09388. 2025.") == ["2505.09388"]
    assert ids("2023. 00092, 1688.12609, 3.2505.09388, 2505.093881, 2709.00001, 2607.00001, 0703.00001") == []


def test_chunks(spark):
    md = "lead in\n# One\n" + " ".join(f"a{i}" for i in range(25)) + "\n# Two\nend"
    m = spark.createDataFrame([(1, md)], "p int, markdown string")
    s = [(r.section, md[r.char_start : r.char_end]) for r in I.sections(m, "p").orderBy("char_start").collect()]
    assert [x for x, _ in s] == [I.PREAMBLE, "One", "Two"] and "".join(t for _, t in s) == md
    papers = spark.createDataFrame([(1, "Title", "Abs")], "p int, title string, abstract string")
    rows = I.chunk_papers(papers, m, "p", 50, 10, 0.2).orderBy("seq").collect()
    assert rows[0].section == I.PAPER and rows[0].text == "Title\n\nAbs" and [r.chunk_id for r in rows] == [f"1#{k}" for k in range(len(rows))]
    assert all(r.n_tokens <= 10 for r in rows) and rows[-1].section == "Two" and rows[-1].page_end == (len(md) - 1) // 50 + 1
    with pytest.raises(Exception, match="do not match"):
        spark.createDataFrame([(["a"], ["x", "y", "z"])], "h array<string>, s array<string>").select(I.aligned(F.col("h"), F.col("s"))).collect()


def test_harden():
    source = " ".join(f"s{i}" for i in range(80))
    h = G.harden(f"So: {source} end.", {"p": [source]}, [])
    assert h.capped == 1 and G.MARK in h.text and "s49" in h.text and "s50" not in h.text and h.text.endswith("end.")
    quotes = [" ".join(f"q{k}w{i}" for i in range(16)) for k in range(5)]
    h = G.harden(" but ".join(quotes), {"p": [". ".join(quotes)]}, [])
    assert h.dropped == 2 and h.text.count(G.MARK) == 2
    h = G.harden("see 2505.09388v2 and 2401.00002 or 1.2505.09388", {}, ["2401.00002"])
    assert h.stripped == ("2505.09388",) and "2401.00002" in h.text and "1.2505.09388" in h.text
    assert G.harden("  ", {}, []) == G.Hardened("  ")


def test_runs_resume_at_their_end(spark):
    found = spark.createDataFrame([(1, x) for x in (0, 1, 2, 4, 9, 10)] + [(2, 5)], "k int, at int")
    got = sorted((r.k, r.first, r.stop) for r in G.verbatim_runs(found, "k", 3).collect())
    assert got == [(1, 0, 5), (1, 9, 13), (2, 5, 8)]


def test_even_sample(spark):
    df = spark.range(10).withColumn("g", F.lit(1))
    pick = lambda k: sorted(r.id for r in O.even_sample(df, ["g"], [F.asc("id")], F.lit(k)).collect())
    assert pick(0) == [] and pick(1) == [5] and pick(12) == list(range(10))
    for k in range(2, 11):
        assert pick(k) == sorted({round(i * 9 / (k - 1)) for i in range(k)})


def test_weights():
    assert O.parse_weights("authority=0.5, venue=0,nope=1,niche")["authority"] == 0.5 and O.parse_weights(None) == O.WEIGHTS


def test_greedy_groups(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 20), ("a", 4, 1), ("b", 1, 3)], "k string, i int, n int")
    assert sorted((r.k, r.i, r.group) for r in O.greedy_groups(df, "k", "i", "n", 10).collect()) == [("a", 1, 0), ("a", 2, 0), ("a", 3, 1), ("a", 4, 2), ("b", 1, 0)]


def test_costs(spark):
    rows = [(1, 100, 10, 0, 0.5, 0.0), (1, 100, 10, 0, 0.25, 0.1), (2, 10**6, 0, 0, None, 0.0), (2, 0, 0, 0, 9.0, 0.0), (3, 0, 10**6, 0, float("nan"), 0.0)]
    got = {r.turn_id: r.usd for r in C.turn_costs(spark.createDataFrame(rows, "turn_id int, fresh_in long, out long, cache_read long, reported double, tool_usd double")).collect()}
    assert got == {1: 0.85, 2: 0.1, 3: 0.5}


VOCABULARY = "byte_bpe_50k.json"
TEXTS = ["plain words here", "", "日本語 🙂🙂 𐍈 é é", "<|endoftext|> is text\n\n  here", "x" * 3000, " \t\n", "\u200b\x00\x1c", "a\u3000b" * 50, None]


def test_encodings_of_a_few_texts_are_held_at_a_time(spark, monkeypatch):
    """A batch is encoded by portions of ENCODED characters, and counts are those of whole texts."""
    import public_tokenizers

    path, calls = public_tokenizers.path(VOCABULARY), []

    class Seen:
        def encode_batch_fast(self, texts, add_special_tokens):
            calls.append([len(t) for t in texts])
            return real.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    some = [t or "" for t in TEXTS] * 5
    real = I._vocabulary(path)
    whole = [e.ids for e in real.encode_batch(some, add_special_tokens=False)]
    monkeypatch.setattr(I, "_vocabulary", lambda path: Seen())
    monkeypatch.setattr(I, "ENCODED", 200)
    assert [x.tolist() for x in I.encoded(some, path)] == whole and list(I.encoded([], path)) == []
    assert sum(calls, []) == [len(t) for t in some] and all(len(c) == 1 or sum(c) <= 200 for c in calls) and len(calls) > 10
    monkeypatch.undo()
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    assert {r.id: r.n for r in rows.select("id", I.token_counts(path)("text").alias("n")).collect()} == {i: len(x) for i, x in enumerate(whole[: len(TEXTS)])}


def test_token_offsets_are_those_of_decoded_prefixes(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(VOCABULARY)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in own} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in set(own))}
    some = [t or "" for t in TEXTS]
    for text, ends in zip(some, I.token_ends(some, path), strict=True):
        ids = plain.encode(text, add_special_tokens=False).ids
        raw = [bytes(byte[c] for c in plain.id_to_token(i)) for i in ids]
        assert b"".join(raw) == text.encode()
        assert ends.tolist() == [len(b"".join(raw[: i + 1]).decode(errors="replace")) for i in range(len(ids))]
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").repartition(2)
    got = I.token_windows(rows, ["id"], "text", path, 7, 0.3).collect()
    for i, text in enumerate(some):
        n = len(plain.encode(text, add_special_tokens=False).ids)
        mine = sorted((r.i, r.char_start, r.char_end, r.n_tokens) for r in got if r.id == i)
        assert [m[0] for m in mine] == list(range(0, max(n - 2, 1), 5) if n else [])
        ends = [0, *I.token_ends([text], path)[0].tolist()]
        assert mine == [(a, ends[a], ends[min(a + 7, n)], min(7, n - a)) for a, *_ in mine] and (not n or mine[-1][2] == len(text))
    counted = rows.select("id", F.size(I.tokenizer(path)("text")).alias("n")).collect()
    assert all(r.n == len(plain.encode(some[r.id], add_special_tokens=False).ids) for r in counted)


def test_chunks_of_tokens(spark):
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    text = "lead in words\n# One\n" + "alpha 🙂 beta " * 20 + "\n# Two\n \n"
    papers = spark.createDataFrame([("a", "Title", "Abstract")], "p string, title string, abstract string")
    markdown = spark.createDataFrame([("a", text), ("b", "")], "p string, markdown string")
    rows = I.chunk_papers(papers, markdown, "p", 50, 16, 0.25, vocabulary=path).orderBy("seq").collect()
    assert rows[0].section == I.PAPER and rows[0].n_tokens == len(I.token_ends(["Title\n\nAbstract"], path)[0])
    body = [r for r in rows if r.section == "One"]
    assert all(r.text in text and r.n_tokens <= 16 for r in rows[1:]) and len(body) > 3
    assert [r.seq for r in rows] == list(range(len(rows))) and {r.section for r in rows} == {I.PAPER, I.PREAMBLE, "One", "Two"}


def test_themes(spark):
    import numpy as np

    assert H.theme_name(["gaussian", "splatting", "gaussian splatting", "view"], 3) == "gaussian · splatting · view"
    assert H.ward_groups(np.eye(3), 5).tolist() == [0, 1, 2]
    c = np.array([[1, 0], [0.99, 0.1], [0, 1], [0.1, 0.99]], float)
    assert H.ward_groups(c, 2).tolist() == [0, 0, 1, 1]
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) * [5, 1, 0.1]
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id int, embedding array<double>").repartition(3)
    z = np.array([r.z for r in H.layout(v, "id", 2).orderBy("id").collect()])
    assert abs(z.mean()) < 1e-9 and z[:, 0].var() > 15 and abs(np.corrcoef(z[:, 0], x[:, 0])[0, 1]) > 0.99
    data, digest = H.map_bytes([(1, 2, -1), (3, 4, 0)])
    assert len(data) == 12 and data[:4] == b"\x01\x00\x03\x00" and len(digest) == 64
    assert H.layout_name([1, 2], {"a": 1, "b": 2}) == H.layout_name([1, 2], {"b": 2, "a": 1}) != H.layout_name([2, 1], {"a": 1, "b": 2})


def test_files(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    chunks = spark.createDataFrame([("p#1", "p", "s", 1, 2, "é", 3), ("p#0", "p", "s", 1, 1, "t", 2)], S.CHUNKS)
    W.write_json_lines(chunks, at("chunks"), "chunk_id")
    assert sorted(map(tuple, S.read_chunks(spark, at("chunks")).collect())) == sorted(map(tuple, chunks.collect()))
    edges = spark.createDataFrame([("b", "x"), ("a", "y"), ("a", "x")], "citing_id string, cited_id string")
    W.write_edges(edges, at("edges"))
    assert [tuple(r) for r in S.read_edges(spark, at("edges")).orderBy("citing_id", "cited_id").collect()] == [("a", "x"), ("a", "y"), ("b", "x")]
    (tmp_path / "txt" / "2607").mkdir(parents=True)
    (tmp_path / "txt" / "2607" / "2607.00001.txt").write_bytes(b"one \xff two")
    assert [r.pid for r in S.text_ids(spark, at("txt")).collect()] == ["2607.00001"] and S.text_ids(spark, at("none")).count() == 0
    assert [(r.pid, r.text[:4]) for r in S.text_tree(spark, at("txt")).collect()] == [("2607.00001", "one ")]
    (tmp_path / "m.json").write_text('{"papers": ["a", "b", "a"]}')
    assert sorted(r.pid for r in S.read_manifest(spark, at("m.json")).collect()) == ["a", "b"]
    (tmp_path / "core.csv").write_text("1,T,ICML,x,A*,1\n2,T,Foo,x,C,1\nshort\n3,T,foo,x,B,1\n")
    assert {r.acronym: r.tier for r in S.read_core_rankings(spark, at("core.csv")).collect()} == {"icml": 3, "foo": 2}
    spark.createDataFrame([("c", [1.0], "m1")], "chunk_id string, vector array<float>, slug string").write.parquet(at("v"))
    assert S.read_vectors(spark, at("v"), "m1").count() == 1
    with pytest.raises(ValueError):
        S.read_vectors(spark, at("v"), "m2")
    W.write_state(spark, at("state"), a="1", b="2")
    W.write_state(spark, at("state"), a="3")
    assert W.read_state(spark, at("state")) == {"a": "3", "b": "2"} and W.read_state(spark, at("nothing")) == {}
    for k in (1, 0):
        W.write_shard(spark.createDataFrame([("c", k), (f"d{k}", k)], "chunk_id string, v int"), at("shards"), k)
    W.merge_shards(spark, at("shards"), at("merged"), "chunk_id", 2)
    assert sorted(map(tuple, spark.read.parquet(at("merged")).collect())) == [("c", 0), ("d0", 0), ("d1", 1)]
    with pytest.raises(W.Invalid):
        W.merge_shards(spark, at("shards"), at("merged"), "chunk_id", 3)
    runs = spark.createDataFrame([("2026-07-01T10:00:00", 0.5)], "created_at string, cost double")
    W.append_runs(runs, at("runs"))
    W.append_runs(runs, at("runs"))
    assert spark.read.parquet(at("runs")).select("run_id").distinct().count() == 2
    with pytest.raises(W.Invalid):
        W.append_runs(runs.withColumn("ip", F.lit("1.2.3.4")), at("runs"))


def test_sessions(spark, tmp_path):
    import json

    rec = lambda **x: json.dumps({"sessionId": "s", **x})
    (tmp_path / "a.jsonl").write_text("\n".join([
        rec(type="user", message={"content": "first <b>prompt</b>"}),
        rec(type="assistant", message={"content": [{"type": "text", "text": "an  answer"}, {"type": "tool_use", "name": "Run"}]}),
        rec(type="user", message={"content": [{"type": "tool_result", "text": "x"}]}),
        "not json",
        rec(type="user", isMeta=True, message={"content": "meta"}),
    ]))
    (tmp_path / "b.jsonl").write_text(rec(type="user", message={"content": "second"}))
    got = [(r.turn_no, r.prompt, r.lines) for r in S.session_turns(spark, f"file://{tmp_path}").orderBy("turn_no").collect()]
    assert got == [(1, "first prompt", ["Reply: an answer", "[Run]"]), (2, "second", [])]


def test_index_checks(spark, tmp_path):
    docs = spark.createDataFrame([("p", "t", 1, "v1")], "doc_id string, title string, day int, version string")
    chunks = spark.createDataFrame([("p#0", "p", "x")], "chunk_id string, doc_id string, text string")
    vectors = spark.createDataFrame([("p#0", [1.0])], "chunk_id string, embedding array<float>")
    facets = spark.createDataFrame([("p", "k", "v")], "doc_id string, key string, value string")
    W.write_index(f"file://{tmp_path}/i", docs, chunks, facets, vectors)
    assert spark.read.parquet(f"file://{tmp_path}/i/chunks").count() == 1
    for bad in ({"documents": docs.union(docs)}, {"chunks": chunks.union(chunks)}, {"documents": docs.limit(0)}, {"vectors": vectors.limit(0)}, {"chunks": chunks.withColumn("chunk_id", F.lit("p0"))}):
        with pytest.raises(W.Invalid):
            W.check(**W.index_violations(**{"documents": docs, "chunks": chunks, "vectors": vectors, **bad}))
    with pytest.raises(W.Invalid):
        W.require(docs, ["doc_id", "nope"])
    assert W.splice("a<s>old<e>b", "new", "<s>", "<e>") == "a<s>\nnew\n<e>b"


def test_run_stream(spark, tmp_path):
    rows = [("r1", "2026-07-01 10:00:00", 0.5), ("r1", "2026-07-01 10:00:00", 0.5), ("r2", "2026-07-02 11:00:00", 0.25)]
    df = spark.createDataFrame(rows, "run_id string, ts string, cost double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    stream.append(source, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    assert {str(r.day): r.cents for r in stream.daily_spend(df.withColumnRenamed("ts", "ts")).collect()} == {"2026-07-01": 100, "2026-07-02": 25}


def test_golden(spark):
    from lakelens.operators import golden as N

    assert N.fingerprint({"a": 1, "b": 2}) == N.fingerprint({"b": 2, "a": 1}) != N.fingerprint({"a": 2, "b": 2}) and len(N.fingerprint({})) == 12
    with pytest.raises(KeyError):
        N.Sources({"x": N.Source(lambda: None, "lang")}).get("y")
    drafts = spark.createDataFrame([("q", "s1", 1, "old"), ("q", "s1", 2, "new"), ("r", "s2", 1, "other")], "id string, signature string, at int, v string")
    assert [r.v for r in N.reusable(drafts, "s1").collect()] == ["new"]
    rows = [("single_hop", "what keeps the rows from moving at all", ["**kept** here"], ["it is kept here"], ["shuffle"], None), ("single_hop", "does the shuffle matter to any of them", ["gone"], ["it is kept here"], ["shuffle"], None), ("exact_match", "what is GRPO", ["kept…here"], ["kept or here"], [], "grpo")]
    got = [(r.span_verbatim, r.lexical_rule, r.question_length) for r in N.checked(spark.createDataFrame(rows, "type string, question string, spans array<string>, texts array<string>, rare_terms array<string>, anchor string")).collect()]
    assert got == [(True, True, True), (False, False, True), (True, True, False)]
    ranked = spark.createDataFrame([("q", "c", "t", "a#1", 1), ("q", "c", "t", "b#1", 2)], "question string, config string, type string, chunk string, rank int")
    expected = spark.createDataFrame([("q", "b#1")], "question string, chunk string")
    out = N.board(ranked, expected, 3, F.substring_index("chunk", "#", 1), 50)
    assert out["board"].first().recall == 1.0 and out["ranks"].first().place == 2 and {r.grade for r in out["grades"].collect()} == {0, 2}
    with pytest.raises(ValueError):
        N.board(ranked, expected.union(spark.createDataFrame([("z", "x")], expected.schema)), 3, F.substring_index("chunk", "#", 1))


def test_map_and_transcripts(spark, tmp_path):
    ids = list(range(12))
    papers = spark.createDataFrame([(i, ("graph model search " if i < 7 else "chain index red ") * 3, "a" if i % 3 else "b") for i in ids], "id int, text string, category string")
    vectors = spark.createDataFrame([(i, [1.0 + i / 100, 0.0] if i < 7 else [0.0, 1.0 + i / 100]) for i in ids], "id int, embedding array<double>")
    names = iter(range(10_000))

    def keep(df, label):
        path = f"file://{tmp_path}/{label}-{next(names)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    out = H.theme_map(papers, vectors, 3, 2, keep)
    themes = {r.theme: (r.n, r.name.split(" · ")[0], r.category) for r in out["themes"].collect()}
    assert themes[0][0] == 7 and themes[1][0] == 5 and {themes[0][1], themes[1][1]} <= {"graph", "graph model", "model", "model search", "search", "search graph", "chain", "chain index", "index", "index red", "red", "red chain"}
    assert {r.id for r in out["points"].filter("theme = 0").collect()} == set(range(7))
    talk = [(1, 0, "system", "s"), (1, 1, "user", "mail a@b.org"), (1, 2, "assistant", "yes " * 300), (1, 3, "user", "more"), (2, 0, "user", "hi")]
    c = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    none = spark.createDataFrame([], "chunk_id string, hash string")
    first = C.transcript_index(c, none, 200)
    rows = {r.chunk_id: r.text for r in first["chunks"].collect()}
    assert set(rows) == {"1#0", "1#1", "2#0"} and "[email]" in rows["1#0"] and first["todo"].count() == 3
    again = C.transcript_index(c, first["todo"].select("chunk_id", "hash"), 200)
    assert again["todo"].count() == 0 and again["kept"].count() == 3
