"""The barrier over verdicts in any order, and the table functions."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quillstone.functions import registry
from quillstone.operators import chunking, claims
from quillstone.streaming import barrier

SCHEMA = "answer_id long, at timestamp, claim_ord int, status string, total int"
T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def run(spark, tmp_path, batches, name, wait=60):
    src = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        out = barrier.verification_barrier(stream, wait, "1 minute")
        job = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        job.awaitTermination(180)
    return sorted(tuple(r) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect())


def test_counts_leave_once_when_all_have_come_in_any_order_and_over_restarts(spark, tmp_path):
    r = random.Random(2)
    messages, want = [], []
    for a in range(40):
        n = r.choice([0, 1, 2, 5, 9])
        says = [r.choice(barrier.STATUSES) for _ in range(n)]
        messages += [(a, at(r.randrange(50)), k, s, None) for k, s in enumerate(says)] + [(a, at(0), None, None, n)]
        if n:
            messages.append((a, at(-1), 0, "supported", None))  # older than the verdict that counts
        want.append((a, *[says.count(s) for s in barrier.STATUSES], n, True))
    r.shuffle(messages)
    third = len(messages) // 3
    got = run(spark, tmp_path, [messages[:third], messages[third : 2 * third], messages[2 * third :]], "all")
    by = {g[0]: g for g in got}
    assert len(got) == 40 and all(by[w[0]][5:] == w[5:] for w in want)
    late = {m[0] for m in messages[2 * third :]} - {m[0] for m in messages[: 2 * third]}
    assert all(by[w[0]] == w for w in want if w[0] in late or w[5] == 0)


def test_an_answer_that_waits_too_long_leaves_incomplete(spark, tmp_path):
    first = [(1, at(0), None, None, 3), (1, at(1), 1, "supported", None), (1, at(1), 7, "supported", None), (2, at(1), 2, "contradicted", None), (3, at(2), 0, "odd", None), (3, at(2), None, None, 1)]
    got = run(spark, tmp_path, [first, [(9, at(500), None, None, 0)], [(9, at(501), 0, "supported", None)]], "late")
    assert got == [(1, 1, 0, 0, 2, 3, False), (2, 0, 1, 0, 2, 3, False), (3, 0, 0, 0, 1, 1, True), (9, 0, 0, 0, 0, 0, True)]


def test_table_functions_equal_the_operators(spark):
    registry.register(spark)
    docs = spark.createDataFrame([(1, "A", "# Head\n" + "Text one.\n\n" * 300), (2, None, None), (3, "C", "")], "doc_id long, title string, body string")
    got = spark.sql("SELECT c.* FROM {d} d, LATERAL chunk_document(d.doc_id, d.title, d.body) c", d=docs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunking.chunk(docs).collect())) and got.count() > 1
    said = spark.createDataFrame([(1, "One [1]. Two here. [2] Two here."), (2, None)], "id long, text string")
    flat = spark.sql("SELECT d.id, c.claim_ord, c.text, c.cites, c.partial FROM {d} d, LATERAL split_claims(d.text) c", d=said)
    assert sorted(map(str, flat.collect())) == sorted(map(str, claims.claims_of(said, "id", "text").collect()))
    parts = spark.createDataFrame([(1, 1, "e. Two", False), (1, 0, "On", False), (2, 0, "Done.", True)], "answer_id long, ord int, text string, done boolean")
    rows = spark.sql("SELECT * FROM answer_claims(TABLE({p}) PARTITION BY answer_id ORDER BY ord)", p=parts).collect()
    assert sorted((r[0], r[1], r[2], r[4]) for r in rows) == [(1, 0, "One.", False), (1, 1, "Two", True), (2, 0, "Done.", False)]


def test_messages_of_an_answer(spark):
    v = spark.createDataFrame([(1, 0, "supported"), (1, 1, "uncertain")], "id long, claim_ord int, status string")
    got = barrier.answer_messages(v, "id", F.lit(T0)).collect()
    assert sorted(str(r["total"]) for r in got) == ["2", "None", "None"]
    assert barrier.counted(["supported", "odd"], 3) == [1, 0, 0, 2]
