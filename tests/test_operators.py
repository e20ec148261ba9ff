import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import ann, chunking, claims, entities, graph, lexical, retrieval, scan
from quillstone.operators.wordpiece import WordPiece
from quillstone.plans.config import AnnConfig, ChunkConfig, WorkspaceConfig
from quillstone.sources.scratch import stored

CFG = ChunkConfig()


def test_chunks_carry_the_nearest_heading_and_stay_in_bounds():
    body = "\n\n".join(f"Paragraph {k} " + "word " * 60 for k in range(20)) + "\n\n## Next\n\n" + "text " * 100
    got = chunking.chunk_text("Title", body, CFG)
    assert got[0][0] == "Title" and got[-1][0] == "Next"
    assert all(len(t) < CFG.target_chars + CFG.overlap_chars + 800 for _, t in got)
    assert got[1][1].startswith(got[0][1][-CFG.overlap_chars :].strip())


def test_chunk_edges():
    assert chunking.chunk_text("T", None) == chunking.chunk_text("T", " \n ") == chunking.chunk_text("T", "# A\n## B") == []
    assert chunking.chunk_text("T", "one line") == [("T", "one line")]
    assert chunking.chunk_text("T", "##### five") == [("T", "##### five")]
    assert chunking.chunk_text("T", "# \nx") == [("T", "x")]
    table = "\n".join(["a | b | c | d"] * 400)
    assert max(len(t) for _, t in chunking.chunk_text("T", table)) <= CFG.target_chars + CFG.overlap_chars + 100
    hard = chunking.chunk_text("T", "x" * 5000, ChunkConfig(overlap_chars=0))
    assert "".join(t for _, t in hard).replace("\n", "") == "x" * 5000


def test_a_runt_joins_the_chunk_before_it_across_headings():
    got = chunking.chunk_text("T", "word " * 100 + "\n\n# New\n\nshort")
    assert len(got) == 1 and got[0][0] == "T" and got[0][1].endswith("\n\nshort")


def test_chunk_frame_keys(spark):
    docs = spark.createDataFrame([("d", "T", "a " * 2000), ("e", "T", None)], "doc_id string, title string, body string")
    keys = [r["key"] for r in chunking.chunk(docs).orderBy("seq").collect()]
    assert len(keys) > 2 and keys == [f"d#{i}" for i in range(len(keys))]


@pytest.fixture(scope="module")
def index(spark):
    texts = [(0, "refund timelines for cards"), (1, "settlement schedule refund"), (2, "धनवापसी कैसे करें"), (3, "unrelated words here"), (4, None)]
    return lexical.build_lexical_index(spark.createDataFrame(texts, "key long, text string"), "key", "key", "text")


def test_bm25(index):
    got = lexical.bm25_search(index, "refund timelines", 10).collect()
    assert [r["key"] for r in got] == [0, 1]
    assert [r["key"] for r in lexical.bm25_search(index, "धनवापसी", 10).collect()] == [2]
    assert lexical.bm25_search(index, "zzz", 10).count() == 0
    assert lexical.bm25_search(index, "refund", 1).count() == 1
    once, twice = (lexical.bm25_search(index, q, 1).first()["score"] for q in ("settlement", "settlement settlement"))
    assert twice == pytest.approx(2 * once, abs=2e-6)


def test_bm25_over_the_terms_alone_equals_the_whole_index(index, spark):
    units = spark.createDataFrame([(0, "refund timelines for cards"), (1, "settlement schedule refund"), (2, "धनवापसी कैसे करें"), (3, "unrelated words here"), (4, None)], "key long, text string")
    for asked in ("refund timelines refund", "zzz", "", "words settlement"):
        assert lexical.bm25_over(units, asked, 10, "key", "key").collect() == lexical.bm25_search(index, asked, 10).collect()


def test_postings_round_trip(index, spark, tmp_path):
    index.write(str(tmp_path))
    again = lexical.LexicalIndex.read(spark, str(tmp_path))
    assert lexical.bm25_search(again, "refund", 5).collect() == lexical.bm25_search(index, "refund", 5).collect()


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1500, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "key long, embedding array<float>").cache()


def test_knn_floor_candidates_and_dims(spark, vectors):
    q = [float(x) for x in vectors.where("key = 7").first()["embedding"]]
    best = retrieval.knn(vectors, retrieval.vector(q), 5).collect()
    assert best[0]["key"] == 7 and [r["rank"] for r in best] == [1, 2, 3, 4, 5]
    assert all(r["score"] >= 0.4 for r in retrieval.knn(vectors, retrieval.vector(q), 50, 0.4).collect())
    some = spark.createDataFrame([(7,), (8,), (99999,)], "key long")
    assert {r["key"] for r in retrieval.score_candidates(vectors, retrieval.vector(q), some).collect()} == {7, 8}
    with pytest.raises(Exception, match="expected 31 dimensions"):
        retrieval.check_dims(vectors, 31).collect()


def test_more_queries_than_a_block_are_searched_in_blocks(vectors):
    asked = stored(vectors.limit(7).select(F.col("key").alias("query"), "embedding"), "asked")
    rows = lambda df: sorted(map(tuple, df.select("query", "key", "score", "rank").collect()))
    assert rows(retrieval.knn_many(asked, vectors, 5, most_queries=3, most_vectors=11)) == rows(retrieval.knn_many(asked, vectors, 5))
    index = ann.build_ann(vectors, len(asked.first()["embedding"]), AnnConfig())
    kind = dict(vectors.dtypes)["key"]
    assert rows(ann.ann_search(index, asked, 5, key_type=kind, most_queries=3)) == rows(ann.ann_search(index, asked, 5, key_type=kind))
    assert retrieval.knn_many(asked.where("false"), vectors, 5).count() == ann.ann_search(index, asked.where("false"), 5, key_type=kind).count() == 0


def test_knn_many_equals_single_searches(vectors):
    asked = vectors.where("key % 500 = 0").select(F.col("key").alias("query"), "embedding")
    many = {(r["query"], r["rank"]): r["key"] for r in retrieval.knn_many(asked, vectors, 5).collect()}
    for row in asked.collect():
        for r in retrieval.knn(vectors, retrieval.vector(row["embedding"]), 5).collect():
            assert many[row["query"], r["rank"]] == r["key"]


def test_quantised_search_keeps_most_of_the_top(vectors):
    q = [float(x) for x in vectors.where("key = 3").first()["embedding"]]
    exact = {r["key"] for r in retrieval.knn(vectors, retrieval.vector(q), 5).collect()}
    rough = {r["key"] for r in retrieval.knn_q8(retrieval.quantized(vectors), retrieval.vector(q), 5).collect()}
    assert len(exact & rough) >= 4


def test_graph_search_recall_and_inserts(spark, vectors):
    index = ann.build_ann(vectors, 32, AnnConfig(), per_graph=800).cache()
    asked = vectors.where("key % 75 = 0").select(F.col("key").alias("query"), "embedding")
    near = {(r["query"], r["key"]) for r in ann.ann_search(index, asked, 10).collect()}
    exact = {(r["query"], r["key"]) for r in retrieval.knn_many(asked, vectors, 10).collect()}
    assert len(near & exact) / len(exact) >= 0.9
    new = spark.createDataFrame([(5000, [1.0] + [0.0] * 31)], "key long, embedding array<float>")
    more = ann.insert_ann(index, new)
    first = ann.ann_search(more, new.select(F.lit(0).alias("query"), "embedding"), 1).first()
    assert first["key"] == 5000 and first["score"] == pytest.approx(1, abs=1e-5)
    assert more.agg(F.sum("count")).first()[0] == 1501


def test_caps_comparison_and_triage(spark):
    hits = spark.createDataFrame([(i, "a" if i < 6 else "b", 1 - i / 10) for i in range(8)], "ord long, doc_id string, score double")
    got = retrieval.per_doc_cap(hits, 2, 12).orderBy("sem_rank").collect()
    assert [(r["ord"], r["sem_rank"]) for r in got] == [(0, 1), (1, 2), (6, 3), (7, 4)]
    keyword = spark.createDataFrame([(1, 1, 1), (2, 2, 2), (3, 3, 3)], "key long, ord long, rank long")
    semantic = spark.createDataFrame([(1, 0.1), (2, 0.5), (3, 0.9)], "key long, score double")
    assert {r["key"]: r["delta"] for r in retrieval.compare(keyword, semantic).collect()} == {1: -2, 2: 0, 3: 2}
    p = spark.createDataFrame([("r0", "R", True, 0, [1.0, 0.0]), ("r1", "S", False, 1, [0.0, 1.0]), ("r2", "E", True, 2, None)], "route string, label string, gate boolean, ord int, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0], "en"), (2, [0.1, 0.1], "en"), (3, [0.0, 1.0], "en"), (4, [1.0, 0.0], "hi")], "query long, embedding array<double>, locale string")
    assert {r["query"]: (r["route"], r["gate"]) for r in retrieval.classify(q, p).collect()} == {1: ("r0", True), 2: ("unclear", False), 3: ("r1", False), 4: ("r0", True)}
    assert {r["query"]: (r["route"], r["gate"]) for r in retrieval.classify(q, p, multilingual=False).collect()}[4] == ("passthrough", False)


def test_rerank_keeps_old_ranks_and_stands_without_a_scorer(spark):
    hits = spark.createDataFrame([(i, "x" * i, i) for i in range(1, 15)], "key long, text string, sem_rank long")
    got = retrieval.rerank(hits, "q", lambda q, texts: [float(len(t)) for t in texts]).orderBy("sem_rank").collect()
    assert [r["bi_rank"] for r in got] == [12, 11, 10, 9, 8, 7, 6, 5]
    assert [r["key"] for r in retrieval.rerank(hits, "q", None).orderBy("sem_rank").collect()] == list(range(1, 9))


def test_stride_sample_takes_even_places(spark):
    got = sorted(r[0] for r in retrieval.stride_sample(spark.range(103), 10, ["id"]).collect())
    assert got == [i * 103 // 10 for i in range(10)]
    assert retrieval.stride_sample(spark.range(7), 10, ["id"]).count() == 7


def test_pattern_entities(spark):
    texts = ["Pay ₹4,500 or Rs. 900 now", "On 12 March 2024 and 2024-05-06", "INV2024-0099 and pay_Zz99Yy88, mail a.b@c.example.com", "plain prose of years 12"]
    found = entities.pattern_entities(spark.createDataFrame(list(enumerate(texts)), "key long, text string"), ["key"])
    by = {(r["key"], r["type"]): r["count"] for r in found.groupBy("key", "type").count().collect()}
    assert by == {(0, "AMOUNT"): 2, (1, "DATE"): 2, (2, "ID"): 2, (2, "EMAIL"): 1}


def test_tags_decode():
    tokens = ["[CLS]", "new", "york", "##er", "met", "ann", "bob", "[SEP]", "late"]
    labels = ["O", "B-LOC", "I-LOC", "O", "O", "B-PER", "B-PER", "O", "B-LOC"]
    got = entities.decode_tags(tokens, labels, [0.9] * 9, [1] * 8 + [0])
    assert got == [("LOC", "New Yorker"), ("PER", "Ann"), ("PER", "Bob")]
    assert entities.decode_tags(["ann"], ["B-PER"], [0.5], [1]) == []


def test_graph_weights(spark):
    found = spark.createDataFrame(
        [("k1", "d1", 0, "A:x", "A", "x", 4, 0), ("k2", "d1", 1, "A:x", "A", "x", 5, 0), ("k2", "d1", 1, "B:y", "B", "y", 1, 1), ("k3", "d2", 2, "A:x", "A", "x", 1, 0), ("k3", "d2", 2, "B:y", "B", "y", 1, 1)],
        "key string, doc_id string, chunk_ord long, entity string, type string, surface string, count long, ord int",
    )
    docs = spark.createDataFrame([("d1", "D1", 2), ("d2", "D2", 1)], "doc_id string, name string, chunks long")
    nodes, links = graph.build_graph(docs, entities.merge_entities(found), WorkspaceConfig())
    assert {r["id"]: r["weight"] for r in nodes.collect()} == {"d1": 5, "d2": 4, "A:x": 9, "B:y": 3}
    got = {(r["source"], r["target"]): r["weight"] for r in links.collect()}
    assert got == {("A:x", "d1"): 6, ("A:x", "d2"): 6, ("B:y", "d1"): 2, ("B:y", "d2"): 2, ("A:x", "B:y"): 2}


@pytest.mark.parametrize(
    "text,done,expected",
    [
        ("Refunds take 5 days [1]. They go back [2][3].", True, [("Refunds take 5 days [1].", [1], False), ("They go back [2][3].", [2, 3], False)]),
        ("One is done. Two is", False, [("One is done.", [], False), ("Two is", [], True)]),
        ("Answer: run `a.b()` now. Yes [1] [1].", True, [("run `a.b()` now.", [], False), ("Yes [1] [1].", [1], False)]),
        ("Same here. Same here., [2]", True, [("Same here. , [2]", [2], False)]),
        ("One [1]. [2], [3].", True, [("One [1]. [2], [3].", [1, 2, 3], False)]),
        ("", True, []),
    ],
)
def test_claims(text, done, expected):
    got = claims.split_claims(text, done)
    assert got == expected


def test_marks_are_ascii_digits():
    assert [c for _, c, _ in claims.split_claims("One fact [1]. Another [\u0663].")] == [[1], []]


def test_cited_passages_and_verification(spark):
    said = spark.createDataFrame([(1, 0, "a claim that is long", [2, 9]), (1, 1, "another long claim", [])], "id long, claim_ord int, text string, cites array<int>")
    passages = spark.createDataFrame([(1, 1, "H1", "t1"), (1, 2, "H2", "t2")], "id long, n int, heading string, text string")
    joined = claims.cited_passages(said, passages, "id")
    assert {r["claim_ord"]: [p["n"] for p in r["passages"]] for r in joined.collect()} == {0: [2], 1: [1, 2]}
    assert {r["status"] for r in claims.verify_claims(joined).collect()} == {"unverified"}
    judged = claims.verify_claims(joined, lambda pairs: [[0.0, 5.0, 0.0] if "t1" in p else [5.0, 0.0, 0.0] for p, _ in pairs])
    assert {r["claim_ord"]: r["status"] for r in judged.collect()} == {0: "contradicted", 1: "supported"}


VOCAB = "\n".join("[PAD] [UNK] [CLS] [SEP] un ##aff ##able hello world ! , cafe the ##s cat ￦ 日".split())


def test_wordpiece():
    with pytest.raises(ValueError):
        WordPiece("a\nb")
    w = WordPiece(VOCAB)
    ids = w.ids
    assert w.tokenize("unaffable Hello,WORLD!") == [ids[x] for x in ("un", "##aff", "##able", "hello", ",", "world", "!")]
    assert w.tokenize("Café cats zebra 日日") == [ids[x] for x in ("cafe", "cat", "##s", "[UNK]", "日", "日")]
    assert w.tokenize("a" * 300) == [ids["[UNK]"]]
    single = w.encode_single("hello world", 6)
    assert single == {"ids": [2, ids["hello"], ids["world"], 3, 0, 0], "mask": [1, 1, 1, 1, 0, 0], "types": [0] * 6}
    pair = w.encode_pair("hello hello hello hello", "world world", 8)
    assert pair["types"] == [0, 0, 0, 0, 0, 1, 1, 1] and sum(pair["mask"]) == 8


def test_homography():
    src, dst = [[0, 0], [1, 0], [1, 1], [0, 1]], [[10, 10], [50, 12], [48, 60], [8, 55]]
    h = scan.homography(src, dst)
    for p, q in zip(src, dst, strict=True):
        assert scan.apply(h, *p) == pytest.approx(q, abs=1e-4)
    assert np.allclose(scan.homography(src, src), np.eye(3), atol=1e-9)
    with pytest.raises(ValueError):
        scan.homography(src, [[0, 0], [1, 1], [2, 2], [3, 3]])
    flat = np.full((40, 60, 3), 100, np.uint8)
    out = scan.warp(flat, scan.default_quad(60, 40))
    assert out.shape == (35, 53, 3) and (out == 100).all()
    slope = np.repeat(np.arange(0, 240, 4, dtype=np.uint8)[None, :, None], 40, axis=0)
    part = scan.warp(slope, [[10, 10], [30, 10], [30, 30], [10, 30]])
    assert part[:, :, 0].tolist() == [[4 * (10 + x) + 2 for x in range(20)]] * 20  # pixel centres: half a step up the slope
