"""Places in an order that no single task holds."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import ordering, retrieval
from quillstone.plans import engine
from quillstone.sources import scratch


def made(spark, n=3000, seed=1):
    r = random.Random(seed)
    rows = [(i, None if r.random() < 0.05 else ("hot" if r.random() < 0.4 else f"g{r.randrange(20)}"), r.randrange(50) if r.random() < 0.9 else None) for i in range(n)]
    return rows, spark.createDataFrame(rows + [rows[5]] * 3, "id long, g string, x int").repartition(7)


def test_numbered_equals_a_sort_and_spreads_ties(spark):
    rows, df = made(spark)
    got = ordering.numbered(df, ["x"], parts=9).collect()
    assert sorted(r["place"] for r in got) == list(range(len(rows) + 3))
    xs = [r["x"] for r in sorted(got, key=lambda r: r["place"])]
    assert xs == sorted(xs, key=lambda v: (v is not None, v))
    one = ordering.ranged(df.withColumn("x", F.lit(1)), ["x"], 9).groupBy("_part").count().collect()
    assert max(r["count"] for r in one) < len(rows) / 3  # a tie of all rows has many tasks
    exact = ordering.numbered(df, [F.desc("x"), "id"], parts=9).collect()
    whole = sorted((-(r[2] if r[2] is not None else -1), r[0]) for r in rows + [rows[5]] * 3)
    assert [r["id"] for r in sorted(exact, key=lambda r: r["place"])] == [i for _, i in whole]
    assert ordering.numbered(df.where("false"), ["x"]).count() == 0


def test_numbered_within_equals_row_numbers_and_splits_the_hot_group(spark):
    rows, df = made(spark)
    got = ordering.numbered_within(df, ["g"], [F.desc("id")], "i", "n", parts=9).collect()
    groups = {}
    for i, g, _ in rows + [rows[5]] * 3:
        groups.setdefault(g, []).append(i)
    for g, ids in groups.items():
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["i"])
        assert [r["id"] for r in mine] == sorted(ids, reverse=True) and [r["i"] for r in mine] == list(range(len(ids))) and {r["n"] for r in mine} == {len(ids)}
    hot = ordering.ranged(df.where("g = 'hot'"), ["g", "id"], 9).groupBy("_part").count().collect()
    assert len(hot) >= 8 and max(r["count"] for r in hot) < len(groups["hot"]) / 3


@pytest.mark.parametrize("n", [0, 1, 19, 20, 21, 400, 1003])
def test_stride_sample_without_groups(spark, n):
    got = sorted(r[0] for r in retrieval.stride_sample(spark.range(n).repartition(5).withColumn("_part", F.lit("x")).drop("_part"), 20, ["id"]).collect())
    assert got == (list(range(n)) if n <= 20 else sorted({j * n // 20 for j in range(20)}))


def test_chunk_order_equals_sql(spark):
    docs = spark.createDataFrame([(f"d{i}", ["2024-01-02", None, "", "2023-05-06"][i % 4]) for i in range(200)], "doc_id string, updated string")
    chunks = docs.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"))
    got = [(r["doc_id"], r["seq"]) for r in engine.with_chunk_order(chunks, docs).orderBy("chunk_ord").collect()]
    docs.createOrReplaceTempView("ordered_docs")
    want = spark.sql("SELECT doc_id, seq FROM ordered_docs, LATERAL (SELECT explode(array(0, 1)) AS seq) ORDER BY coalesce(updated, '') DESC, doc_id, seq").collect()
    assert got == [tuple(r) for r in want]


def test_shared_folder_is_asked_for_outside_local_sessions():
    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError):
        scratch.shared_dir(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs://store/shared/"
    assert scratch.shared_dir(Session()) == "hdfs://store/shared"
