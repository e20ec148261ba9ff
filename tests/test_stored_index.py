"""A stored index under changes against a full rebuild."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import lexical, stored_index
from quillstone.operators.stored_index import StoredIndex, index_stream
from quillstone.sources.manifest import Manifest

SCHEMA = "key long, ord long, text string, deleted boolean, version int"
WORDS = [f"w{i}" for i in range(60)]


def text(r):
    return " ".join(WORDS[min(int(r.expovariate(0.12)), 59)] for _ in range(r.choice([0, 3, 20, 20, 90])))


def changes(seed, n=300, batches=3):
    """Batches of rows, and the documents that should be left."""
    r, live, out = random.Random(seed), {}, []
    for b in range(batches):
        rows = {}
        for key in range(n) if b == 0 else r.sample(range(n + 40), n // 3):
            kind = r.random()
            if b and kind < 0.25:
                rows[key] = [(key, key, None, True, 1)]
            elif b and kind < 0.4 and key in live:
                rows[key] = [(key, key, live[key], False, 1)]  # sent again as it is
            else:
                rows[key] = [(key, key, text(r), False, 1)]
            if r.random() < 0.2:
                rows[key].append((key, key, text(r), False, 2))  # of one key in a batch the larger version counts
        for key, x in rows.items():
            last = x[-1]
            live.pop(key, None)
            if not last[3]:
                live[key] = last[2]
        out.append([y for x in rows.values() for y in x] + [(None, 1, "w1 w2", False, 1)])
    return out, live


def equals_rebuild(spark, index, live, queries=("w0 w7 w7", "w40 w59 nothing", "")):
    docs = spark.createDataFrame([(k, k, t) for k, t in live.items()], "key long, ord long, text string")
    full = lexical.build_lexical_index(docs)
    assert sorted(map(tuple, index.frequencies().collect())) == sorted(map(tuple, full.frequencies.collect()))
    a, b = index.stats().first(), full.stats.first()
    assert a["n"] == b["n"] and a["avg_len"] == pytest.approx(b["avg_len"])
    assert sorted(map(tuple, index.postings().select("key", "term", "tf").collect())) == sorted(map(tuple, full.postings.select("key", "term", "tf").collect()))
    for q in queries:
        for k in (3, 1000):
            assert [tuple(r) for r in index.search(q, k).orderBy("rank").collect()] == [tuple(r) for r in lexical.bm25_search(full, q, k).orderBy("rank").collect()], (q, k)


@pytest.mark.parametrize("span,named", [(16, 1000), (16, 12), (1024, 1000)])
def test_changes_equal_a_rebuild_before_and_after_compaction(spark, tmp_path, monkeypatch, span, named):
    monkeypatch.setattr(stored_index, "RANGE", span)
    monkeypatch.setattr(stored_index, "NAMED", named)
    monkeypatch.setattr(stored_index, "FIRST", 2)
    monkeypatch.setattr(stored_index, "FEW", 0 if span < 100 else 64)
    batches, live = changes(span + named)
    index = StoredIndex(spark, str(tmp_path / "i"))
    for number, rows in enumerate(batches):
        assert index.apply(spark.createDataFrame(rows, SCHEMA), number, deleted_col="deleted", version_col="version")
    equals_rebuild(spark, index, live)
    before = index.state
    assert not index.apply(spark.createDataFrame(batches[1], SCHEMA), 1, deleted_col="deleted", version_col="version") and index.state == before
    reader = StoredIndex(spark, index.path)
    index.compact()
    assert len(index.state["segments"]) == 1 and index.table("gone").count() == 0
    equals_rebuild(spark, index, live, ("w0 w7 w7",))
    assert reader.search("w3", 5).count() == 5  # an older state can still be read
    assert sorted(index.vacuum()) == sorted(f"seg-{s}" for s in before["segments"]) and index.vacuum() == []
    equals_rebuild(spark, index, live, ("w3",))


def test_a_document_that_is_sent_again_writes_nothing(spark, tmp_path):
    rows = [(1, 1, "aa bb", False, 1), (2, 2, "", False, 1)]
    index = StoredIndex(spark, str(tmp_path / "i"))
    assert index.search("aa").count() == 0
    assert index.apply(spark.createDataFrame(rows, SCHEMA), 0) and not index.apply(spark.createDataFrame(rows, SCHEMA), 1)
    assert index.state["segments"] == [0] and index.state["applied"] == 1 and index.state["n"] == 2
    assert index.apply(spark.createDataFrame([(1, 1, None, True, 1), (9, 9, None, True, 1)], SCHEMA), 2, deleted_col="deleted")
    assert index.state["n"] == 1 and index.search("aa").count() == 0 and index.frequencies().count() == 0


def test_a_batch_that_died_leaves_nothing_and_a_second_writer_is_refused(spark, tmp_path):
    index, other = StoredIndex(spark, str(tmp_path / "i")), StoredIndex(spark, str(tmp_path / "i"))
    docs = spark.createDataFrame([(1, 1, "aa bb")], "key long, ord long, text string")
    index.manifest.commit = lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        index.apply(docs, 0)
    assert other.refresh().state["segments"] == []
    late = StoredIndex(spark, index.path)
    assert other.apply(docs.withColumn("text", F.lit("cc dd")), 0)
    assert [r["key"] for r in other.search("cc").collect()] == [1] and other.search("aa").count() == 0
    with pytest.raises(RuntimeError):
        late.manifest.commit(0, {})
    assert Manifest(spark, str(tmp_path / "none")).last() == (0, {})


def test_a_stream_of_changes_equals_a_rebuild_and_restarts(spark, tmp_path):
    batches, live = changes(5, n=60, batches=3)
    src = str(tmp_path / "in")
    index = StoredIndex(spark, str(tmp_path / "i"))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        index_stream(stream, index, str(tmp_path / "ck"), deleted_col="deleted", version_col="version").awaitTermination(120)
        assert index.refresh().state["applied"] == k
    equals_rebuild(spark, index, live, ("w0 w7",))


def test_blocks_that_cannot_reach_the_best_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored_index, "RANGE", 32)
    monkeypatch.setattr(stored_index, "FIRST", 2)
    monkeypatch.setattr(stored_index, "FEW", 0)
    rows = [(i, i, "rare " * (40 if i < 20 else i % 2) + "filler " * (60 if i < 20 else i % 50 + 1)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "key long, ord long, text string")
    index = StoredIndex(spark, str(tmp_path / "i"))
    index.apply(docs, 0)
    got = index.search("rare", 10)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [tuple(r) for r in lexical.bm25_search(lexical.build_lexical_index(docs), "rare", 10).orderBy("rank").collect()]
    assert index.read["ranges"] > 50 and index.read["scored"] <= 5
    plan = index.table("blocks").where(F.col("term").isin(["rare"])).select("range")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [rare])]" in plan or "EqualTo(term,rare)" in plan


def test_terms_are_counted_in_the_row_and_a_range_lies_in_one_file(spark, tmp_path):
    words = spark.createDataFrame([(1, ["b", "a", "b", "c", "b"]), (2, []), (3, None)], "key long, w array<string>")
    assert [tuple(r) for r in lexical.with_term_counts(words).orderBy("key").collect()] == [(1, ["a", "b", "c"], [1, 3, 1]), (2, [], []), (3, None, None)]
    once = spark.createDataFrame([(i, i, "aa bb aa") for i in range(9)], "key long, ord long, text string")
    built = lexical.build_lexical_index(once).postings
    assert "Exchange" not in built._jdf.queryExecution().executedPlan().toString() and built.where("term = 'aa' AND tf = 2").count() == 9
    twice = lexical.build_lexical_index(once.unionByName(once.where("key < 2").withColumn("text", F.lit("aa cc")))).postings
    assert sorted(map(tuple, twice.where("key < 2").collect())) == [(k, t, n) for k in (0, 1) for t, n in (("aa", 3), ("bb", 1), ("cc", 1))] and twice.count() == 20
    index = StoredIndex(spark, f"{tmp_path}/index")
    index.apply(spark.range(20_000).selectExpr("id key", "id ord", "concat('aa w', id % 50) text"), 0)
    files = index.table("blocks").select("range", F.input_file_name().alias("f")).distinct().groupBy("range").agg(F.count("*").alias("n"))
    assert files.count() == 40 and files.where("n <> 1").isEmpty() and index.frequencies().where("term = 'aa'").first()["df"] == 20_000
