"""Prototypes under edits, token tags, observed stages, JSON maps, and the sink of documents."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import maps
from quillstone.operators import entities, prototypes, retrieval
from quillstone.plans.runner import Stage, figures_frame, run_pipeline, stage_figures, timings
from quillstone.sources import documents, importer, store


def vectors(spark, rows):
    return spark.createDataFrame(rows, "route string, embedding array<float>")


def test_prototypes_after_edits_equal_a_rebuild_exactly(spark):
    r = np.random.default_rng(1)
    rows = [(f"r{i % 4}", [float(x) for x in r.normal(size=8).astype(np.float32) / 4]) for i in range(200)]
    more = [("r9", rows[0][1]), ("r1", rows[1][1])]
    routes = spark.createDataFrame([(f"r{i}", f"R{i}", i == 0, i) for i in (0, 1, 2, 3, 9)], "route string, label string, gate boolean, ord int")
    sums = prototypes.exemplar_sums(vectors(spark, rows))
    # r3 loses all its exemplars, one is added twice and taken out once
    gone = [x for x in rows if x[0] == "r3"] + rows[:40:4] + [more[1]]
    got = prototypes.prototypes(routes, prototypes.edited(prototypes.edited(sums, added=vectors(spark, [*more, more[1]])), removed=vectors(spark, gone)))
    left = [x for x in rows if x[0] != "r3" and x not in rows[:40:4]] + more
    want = prototypes.prototypes(routes, prototypes.exemplar_sums(vectors(spark, left)))
    key = lambda df: sorted((x["route"], list(x["embedding"])) for x in df.collect())
    assert key(got) == key(want) and {x[0] for x in key(got)} == {"r0", "r1", "r2", "r9"}
    mean = retrieval.centroids(vectors(spark, left), "route")
    near = {x["route"]: x["embedding"] for x in mean.collect()}
    assert all(np.allclose(v, near[k], atol=1e-6) for k, v in key(got))


def test_stale_routes_take_no_part_and_gates_are_the_routes_own(spark):
    routes = spark.createDataFrame([("a", "A", False, 0), ("b", "B", True, 1)], "route string, label string, gate boolean, ord int")
    sums = prototypes.exemplar_sums(vectors(spark, [("a", [1.0, 0.0]), ("b", [0.8, 0.6]), (None, [1.0, 1.0])]))
    live = prototypes.prototypes(routes, sums)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query int, embedding array<float>")
    assert retrieval.classify(asked, live).first()["route"] == "a"
    stale = prototypes.mark_stale(live, routes.where("route = 'a'"))
    assert {x["route"]: x["stale"] for x in stale.collect()} == {"a": True, "b": False}
    got = retrieval.classify(asked, stale).first()
    assert got["route"] == "b" and got["gate"]
    toggled = prototypes.prototypes(routes.withColumn("gate", ~F.col("gate")), sums)
    assert {x["route"]: x["gate"] for x in toggled.collect()} == {"a": True, "b": False}


def test_many_prototypes_are_searched_in_blocks_with_the_same_result(spark, monkeypatch):
    r = np.random.default_rng(2)
    unit = lambda: [float(x) for x in r.normal(size=6).astype(np.float32)]
    live = spark.createDataFrame([(f"r{i}", f"R{i}", i % 2 == 0, i, unit()) for i in range(40)] + [("twin", "T", True, 99, [1.0] * 6), ("first", "F", True, 98, [1.0] * 6)], "route string, label string, gate boolean, ord int, embedding array<float>")
    asked = spark.createDataFrame([(i, unit()) for i in range(50)] + [(99, [9.0] * 6)], "query int, embedding array<float>").withColumn("locale", F.when(F.col("query") % 7 == 0, "hi").otherwise("en"))
    rows = lambda: sorted(map(tuple, retrieval.classify(asked, live, multilingual=False).collect()))
    few = rows()
    monkeypatch.setattr(retrieval, "FEW_PROTOTYPES", 10)
    assert rows() == few and dict((x[0], x[1]) for x in few)[99] == "first"


def test_ties_of_many_like_vectors_fall_by_key(spark):
    rows = [(i, [1.0, 0.0]) for i in range(300)] + [(1000 + i, [0.5, float(i % 3)]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "key long, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0])], "query long, embedding array<float>")
    got = retrieval.knn_many(asked.where("embedding[0] = 1"), vectors, 4, most_vectors=50).orderBy("rank").collect()
    assert [(r["key"], r["rank"]) for r in got] == [(0, 1), (1, 2), (2, 3), (3, 4)]
    zero = retrieval.knn_many(asked.where("query = 2"), vectors, 3, most_vectors=50).orderBy("rank").collect()
    assert [r["key"] for r in zero] == [0, 1, 2]
    assert retrieval.knn_many(asked, vectors.where("key >= 1000 AND key < 1002"), 4).count() == 6
    assert retrieval.knn_many(asked, vectors.where("false"), 4).count() == 0


def brute_decode(tokens, logits, mask, labels, least=0.6):
    found, held, kind = [], [], None
    for t, z, m in zip(tokens, logits, mask, strict=True):
        if not m:
            break
        if t.startswith("["):
            continue
        e = np.exp(np.array(z) - max(z))
        p = e / e.sum()
        label = labels[int(p.argmax())]
        cont = t.startswith("##")
        if label == "O" or p.max() < least:
            if held and cont:
                held.append(t)
            else:
                found.append((kind, held))
                held = []
            continue
        if held and (cont or (label[0] == "I" and label[2:] == kind)):
            held.append(t)
        else:
            found.append((kind, held))
            held, kind = [t], label[2:]
    found.append((kind, held))
    return [(k, s) for k, x in found if x and len(s := entities.join_pieces(x)) > 1]


def test_logits_decode_like_brute_force_and_reach_the_entities(spark):
    r = random.Random(3)
    labels = ["O", "B-PER", "I-PER", "B-LOC", "I-LOC"]
    rows = []
    for i in range(300):
        n = r.randrange(0, 14)
        rows.append((i, [r.choice(["[CLS]", "ann", "##na", "x", "paris", "##s", "q"]) for _ in range(n)], [[r.choice([0.0, 0.5, 4.0]) for _ in labels] for _ in range(n)], [1] * (n - n // 5) + [0] * (n // 5)))
    df = spark.createDataFrame(rows, "key long, tokens array<string>, logits array<array<double>>, mask array<int>")
    got = {}
    for x in entities.tagged_entities(df, ["key"], labels).orderBy("ord").collect():
        got.setdefault(x["key"], []).append((x["type"], x["surface"]))
    want = {k: v for k, t, z, m in rows if (v := brute_decode(t, z, m, labels))}
    assert got == want and len(got) > 100
    model = lambda texts: [(t.split(), [[0.0, 9.0, 0.0, 0.0, 0.0] if w[0].isupper() else [9.0, 0.0, 0.0, 0.0, 0.0] for w in t.split()], [1] * len(t.split())) for t in texts]
    chunks = spark.createDataFrame([(1, "Anna paid ₹4,500 in May"), (2, None)], "key long, text string")
    found = entities.extract_entities(chunks, ["key"], classifier=entities.token_classifier(model, labels, ["key"]))
    assert [(x["type"], x["surface"]) for x in found.orderBy("ord").collect()] == [("AMOUNT", "₹4,500"), ("PER", "Anna"), ("PER", "May")]
    assert entities.aggregate_entities(found, ["key"]).count() == 3


def test_observed_rows_equal_counted_ones_and_all_statuses_show(spark):
    boom = lambda c: 1 / 0
    stages = [
        Stage("a", "A", lambda c: {"x": spark.range(100), "y": spark.range(7), "n": 3}), Stage("b", "B", lambda c: {"x": c["x"].where("id % 3 = 0")}),
        Stage("c", "C", boom, optional=True), Stage("d", "D", boom, when=lambda c: False), Stage("e", "E", lambda c: {"halt": True}), Stage("f", "F", boom),
    ]
    ctx = run_pipeline(stages, {}, observe=True)
    counted = len(ctx["x"].collect())
    got = stage_figures(ctx["trace"], 2)
    assert got["a"]["rows"] == {"x": 100, "y": None} and got["b"]["rows"] == {"x": counted == 34 and 34}
    assert {k: v["status"] for k, v in got.items()} == {"a": "ok", "b": "ok", "c": "failed-skipped", "d": "skipped", "e": "ok"}
    assert set(timings(ctx["trace"])) == {"a", "b", "c", "e"}
    assert figures_frame(spark, ctx["trace"]).where("stage = 'a'").count() == 2


def test_json_and_counters(spark):
    df = spark.createDataFrame([('{"b":1,"a":{"d":[1,2],"c":null}}', '{"a": {"c":null, "d":[1, 2]}, "b": 1}'), ("{", "{"), (None, None), ("[1,2]", "[2,1]"), ("{", "}")], "x string, y string")
    assert [r[0] for r in df.select(maps.same_json("x", "y")).collect()] == [True, True, True, False, False]
    rows = spark.createDataFrame([("g", "a"), ("g", "a"), ("g", None), ("h", "b"), (None, "a")], "g string, k string")
    got = {r["g"]: r["counts"] for r in maps.counters(rows, ["g"], F.col("k")).collect()}
    assert got == {"g": {"a": 2}, "h": {"b": 1}, None: {"a": 1}}
    m = spark.sql("SELECT map('a', 1L, 'b', 2L) AS x, map('b', 5L, 'c', 1L) AS y, CAST(NULL AS map<string, bigint>) AS z")
    assert m.select(maps.merged_counters("x", "y").alias("m"), maps.merged_counters("z", "y").alias("n")).first().asDict() == {"m": {"a": 1, "b": 7, "c": 1}, "n": {"b": 5, "c": 1}}


def test_imported_files_are_visible_at_once_or_not_at_all(spark, tmp_path):
    files = spark.createDataFrame([(f"g{i % 3}/Doc {i}é.md", f'---\ntitle: "T {i}"\n---\n' + "word " * 100 + "\n\nEnd") for i in range(30)], "path string, text string").repartition(5)
    docs = documents.import_tree(files)
    path = str(tmp_path / "tree")
    importer.save_documents(docs, path)
    columns = ["doc_id", "title", "category", "collection", "tags", "locale", "updated", "owner", "audience", "body"]
    rows = lambda df: sorted(map(str, df.select(columns).collect()))
    assert rows(documents.load_corpus(spark, path)) == rows(docs) and docs.count() == 30
    bad = docs.where("category <> 'g1'").unionByName(docs.where("category = 'g1'").withColumn("doc_id", F.when(F.col("title") == "T 1", F.raise_error(F.lit("lost"))).otherwise(F.col("doc_id"))))
    with pytest.raises(Exception, match="lost"):
        importer.save_documents(bad, path, "overwrite")
    assert rows(documents.load_corpus(spark, path)) == rows(docs) and [x for x in os.listdir(path) if x.startswith(".staged")] == []
    importer.save_documents(docs.where("category = 'g2'"), path, "overwrite")
    assert documents.load_corpus(spark, path).count() == 10
    with pytest.raises(Exception, match="lack"):
        docs.drop("owner", "body").withColumn("x", F.lit(1)).write.format(importer.NAME).mode("append").save(path)
    assert importer.file_name("a/b") != importer.file_name("a_b")


def test_an_index_is_cleared_by_signature(spark, tmp_path):
    path = str(tmp_path / "v")
    for sign in ("hash-8-1", "hash-16-1"):
        store.save_index(spark.range(3), path, sign)
    assert importer.clear_index(spark, path, "hash-8-1") == ["sig=hash-8-1"]
    assert store.load_index(spark, path, "hash-8-1") is None and store.load_index(spark, path, "hash-16-1").count() == 3
    assert importer.clear_index(spark, path) == ["sig=hash-16-1"] and importer.clear_index(spark, path) == []


def test_a_workspace_takes_what_fits_and_evicts_nothing(spark):
    from quillstone.plans.config import Config
    from quillstone.plans.engine import Workspace

    text = "Words of a document that is long enough to be a chunk of its own. " * 6
    make = lambda names: spark.createDataFrame([(n, n, text) for n in names], "doc_id string, title string, body string")
    space = Workspace(spark, Config())
    assert space.ingest(make(["m.md", "n.exe", "o.PDF", "p.txt"]), "doc_id") == 3 and space.error is None
    assert space.ingest(make(["a.exe"]), "doc_id") == 0 and space.error.startswith("No ")
    assert space.ingest(make(["a.md", "m.md", "b.markdown", "c.txt"]), "doc_id") == 2
    assert sorted(r[0] for r in space.docs.select("doc_id").collect()) == ["a.md", "b.markdown", "m.md", "o.PDF", "p.txt"]
    assert space.ingest(make(["d.md"]), "doc_id") == 0 and "full" in space.error and space.chunks.select("doc_id").distinct().count() == 5


def test_pdf_pages_are_joined_by_a_blank_line(spark, tmp_path):
    path = tmp_path / "items.json"
    page = lambda name, n, *words: '{"name": "%s", "page": %d, "items": [%s]}' % (name, n, ", ".join('{"str": "%s", "x": %d, "y": %d, "width": 5}' % w for w in words))
    path.write_text("\n".join([page("f", 2, ("two", 0, 10)), page("f", 1, ("one", 0, 50), ("cell", 40, 50), ("next", 0, 20)), page("f", 3), page("f", 4, ("end", 0, 1)), page("g", 1)]))
    got = {r["name"]: (r["text"], r["pages"]) for r in documents.pdf_documents(documents.read_pdf_items(spark, str(path))).collect()}
    assert got == {"f": ("one | cell\nnext\n\ntwo\n\nend", 4), "g": ("", 1)}


@pytest.mark.parametrize("kept", [False, True])
def test_documents_are_added_to_every_index_without_a_rebuild(spark, tmp_path, kept):
    from quillstone.plans import engine
    from quillstone.plans.config import Config

    make = lambda rows: spark.createDataFrame([(i, f"T {i}", f"{w} and more words of document {i}. " * 20, None) for i, w in rows], "doc_id string, title string, body string, updated string")
    first = make([("a", "refunds"), ("b", "holidays"), ("c", "matters")])
    where = {"path": str(tmp_path / "i"), "stored_lexical": True} if kept else {}
    index = engine.build_index(first, Config(), **where)
    more = engine.add_documents(index, make([("b", "parcels"), ("d", "refunds refunds")]))
    whole = engine.build_index(make([("a", "refunds"), ("c", "matters"), ("b", "parcels"), ("d", "refunds refunds")]), Config())
    rows = lambda ix, q: sorted((r["key"], r["score"]) for r in engine.keyword_search(ix, q, 20).collect())
    for q in ("refunds", "holidays", "parcels words", "matters"):
        assert rows(more, q) == rows(whole, q), q
    assert store.same_keys(more.vectors, more.chunks) and more.docs.count() == 4
    ends = more.chunks.groupBy("doc_id").agg(F.min("chunk_ord").alias("o")).orderBy("o").collect()
    assert {r["doc_id"] for r in ends[:2]} == {"a", "c"} and {r["doc_id"] for r in ends[2:]} == {"b", "d"}
    best = engine.ask(more, "parcels words of document")["results"].orderBy("sem_rank").first()
    assert best["doc_id"] == "b" and engine.compare(more, "refunds").count() >= 2
    if kept:
        assert len(more.lexical.state["segments"]) == 2
        again = engine.build_index(first, Config(), **where)
        assert rows(again, "holidays") and not rows(again, "parcels")
