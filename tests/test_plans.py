import pytest
from pyspark.sql import functions as F

from quillstone.plans import engine, providers
from quillstone.plans.config import Config
from quillstone.plans.runner import Stage, StageFailure, run_pipeline
from quillstone.sources import documents, store
from quillstone.streaming import increments


def test_runner_traces_skips_and_failures():
    boom = lambda c: 1 / 0
    seen = []
    ctx = run_pipeline(
        [Stage("a", "A", lambda c: {"x": 1}), Stage("b", "B", boom, optional=True), Stage("c", "C", boom, when=lambda c: False), Stage("d", "D", lambda c: {"halt": True}), Stage("e", "E", boom)],
        {}, seen.append,
    )
    assert [(t["id"], t["status"]) for t in ctx["trace"]] == [("a", "ok"), ("b", "failed-skipped"), ("c", "skipped"), ("d", "ok")] and len(seen) == 4
    with pytest.raises(StageFailure) as e:
        run_pipeline([Stage("a", "A", boom)], {})
    assert e.value.trace[-1]["status"] == "failed"


def test_embedder_chain():
    class Missing:
        name, dims = "neural", 8

        def start(self):
            raise OSError("no weights")

    got, tried = providers.resolve_embedder([Missing(), providers.HashEmbedder()])
    assert got.name == "lexical-hash" and [t["ok"] for t in tried] == [False, True]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        [("a", "Refunds", "Refund timelines for cards. " * 30, "2024-01-02"), ("b", "Settlements", "Settlement schedules and holidays. " * 30, None), ("c", "Other", "Entirely different matter. " * 30, "2023-01-01")],
        "doc_id string, title string, body string, updated string",
    )


def test_ask_compare_and_gate(spark, docs):
    index = engine.build_index(docs, Config())
    routes = spark.createDataFrame([("chat", "Chat", True, 0, ["hello there friend"]), ("docs", "Docs", False, 1, ["refund timelines"]), ("none", "None", True, 2, [])], "route string, label string, gate boolean, ord int, exemplars array<string>")
    index.prototypes = engine.build_prototypes(routes, index.embedder)
    assert index.prototypes.count() == 2
    got = engine.ask(index, "refund timelines cards")
    assert got["results"].orderBy("sem_rank").first()["title"] == "Refunds"
    assert [t["status"] for t in got["trace"]] == ["ok", "ok", "ok", "skipped"]
    gated = engine.ask(index, "hello there friend")
    assert gated["verdict"]["gate"] and "results" not in gated
    assert engine.compare(index, "refund").count() >= 1


def test_changed_content_is_embedded_again(spark, docs, tmp_path):
    path = str(tmp_path / "index")
    first = engine.build_index(docs, Config(), path=path)
    changed = docs.withColumn("body", F.when(F.col("doc_id") == "a", F.lit("New text entirely. " * 30)).otherwise(F.col("body")))
    second = engine.build_index(changed, Config(), path=path)
    assert store.same_keys(second.vectors, second.chunks)
    assert second.vectors.select("content").exceptAll(first.chunks.select("content")).count() >= 1
    assert store.load_index(spark, path, "other-1-1") is None


def test_workspace(spark, docs):
    space = engine.Workspace(spark)
    space.ingest(docs.withColumn("body", F.concat("body", F.lit(" Paid ₹4,500 on 2024-05-06."))))
    nodes, links = space.graph()
    assert nodes.where("type = 'DOC'").count() == 3 and links.where("kind = 'cooccur'").count() >= 1
    assert space.ask("settlement schedules").orderBy("rank").first()["doc_id"] == "b"


def test_frontmatter_and_uploads(spark):
    raw = '---\r\ntitle: "A b"\r\ntags: [x, \'y\', ]\r\nbad line\r\nempty:\r\n---\r\nBody '
    got = spark.range(1).select(documents.parse_frontmatter(F.lit(raw)).alias("f")).first()["f"]
    assert got["meta"]["title"]["s"] == "A b" and got["meta"]["tags"]["a"] == ["x", "y"] and got["meta"]["empty"]["s"] == "" and got["body"] == "Body" and len(got["meta"]) == 3
    plain = spark.range(1).select(documents.parse_frontmatter(F.lit(" just text ")).alias("f")).first()["f"]
    assert plain["meta"] == {} and plain["body"] == "just text"
    files = spark.createDataFrame([("My File (1).MD", "# Head\nx कै"), ("no.pdf", "x"), ("t.txt", "---\ntitle: T\n---\nz")], "name string, text string")
    rows = {r["title"]: r for r in documents.docs_from_files(files).collect()}
    assert set(rows) == {"Head", "T"} and rows["Head"]["doc_id"].startswith("user-my-file-1-") and rows["Head"]["locale"] == "hi"


def test_corpus_and_import(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: One\nupdated: 2024-01-01\n---\nText")
    (tmp_path / "b.md").write_text("No front")
    got = {r["doc_id"]: r["title"] for r in documents.load_corpus(spark, str(tmp_path)).collect()}
    assert got == {"a": "One", "b": "b"}
    for tree, name, text in [("t1", "x/s p+1.md", "old"), ("t1", "y/s p+1.md", "other"), ("t2", "x/s p+1.md", "new")]:
        path = tmp_path / "trees" / tree / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    both = documents.load_corpus(spark, str(tmp_path / "trees/t1"), f"file://{tmp_path}/trees/t2/").collect()
    assert sorted((r["doc_id"], r["body"]) for r in both) == [("s p+1", "new"), ("s p+1", "other")]
    files = spark.createDataFrame([("Guides/Deep/a.md", "{% tag %}<p>" + "x" * 400 + "</p>"), ("b.md", "x" * 399)], "path string, text string")
    row = documents.import_tree(files).collect()
    assert [(r["doc_id"], r["category"]) for r in row] == [("ext-guides-deep-a", "Guides")]


def test_pdf_lines(spark):
    items = [("Name", 0.0, 100.4, 30.0), ("Sum", 80.0, 100.0, 20.0), ("and", 105.0, 100.0, 10.0), (" ", 0.0, 90.0, 0.0), ("next", 0.0, 80.0, 10.0)]
    df = spark.createDataFrame([(items,)], "items array<struct<str:string, x:double, y:double, width:double>>")
    assert df.select(documents.lines_from_items("items").alias("t")).first()["t"] == "Name | Sum and\nnext"


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "id long, v int, x string")
    new = spark.createDataFrame([(1, 1, "c"), (2, 4, "d"), (3, 1, "e")], "id long, v int, x string")
    got = store.upsert(old, new, "id", "v")
    assert {r["id"]: r["x"] for r in got.collect()} == {1: "c", 2: "b", 3: "e"}
    assert store.delete(got, spark.createDataFrame([(2,)], "id long"), "id").count() == 2


def test_stream_of_claims_equals_batch(spark, tmp_path):
    parts = [(1, 0, "Refunds take 5 ", False), (1, 1, "days [1]. They go ", False), (1, 2, "back [2].", True), (2, 0, "One only", True)]
    src = str(tmp_path / "in")
    for k, p in enumerate(parts):
        spark.createDataFrame([p], "answer_id long, ord int, text string, done boolean").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("answer_id long, ord int, text string, done boolean").option("maxFilesPerTrigger", 1).parquet(src)
    q = increments.stream_claims(stream).writeStream.format("memory").queryName("claims_out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["answer_id"], r["claim_ord"], r["text"]) for r in spark.table("claims_out").collect())
    assert got == [(1, 0, "Refunds take 5 days [1]."), (1, 1, "They go back [2]."), (2, 0, "One only")]


def test_appended_postings_equal_a_full_build(spark, tmp_path):
    from quillstone.operators import lexical

    docs = spark.createDataFrame([(i, f"alpha beta{i % 3} gamma{i}") for i in range(20)], "key long, text string").withColumn("ord", F.col("key"))
    src = str(tmp_path / "in")
    docs.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(src)
    increments.append_postings(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    df, stats = increments.statistics_of(spark.read.parquet(str(tmp_path / "out/postings")), spark.read.parquet(str(tmp_path / "out/lengths")))
    full = lexical.build_lexical_index(docs)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, full.frequencies.collect())) and stats.collect() == full.stats.collect()


def test_ring_keeps_the_latest(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(i, "a", float(i)) for i in range(100)], "event_id long, event_type string, value double").repartition(3).write.parquet(src)
    stream = spark.readStream.schema("event_id long, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(src)
    q = increments.ring(stream, 60, "event_type").writeStream.format("memory").queryName("ring_out").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.table("ring_out").where("latest = 99").collect()[-1]
    assert last["kept"] <= 60 and max(r["latest"] for r in spark.table("ring_out").collect()) == 99
