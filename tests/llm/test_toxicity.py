"""Features against a count gram by gram, recall and false alarms on held-out labels, repeated rows and ties."""

import os

import pytest
from pyspark.sql import functions as F

from quillstone.llm import toxicity


def brute_present(text):
    """The buckets of all character n-grams of 3 to 6, one by one."""
    t = f" {text.lower()} ".translate(toxicity.BLANK)
    out = set()
    for n in range(toxicity.LOW, toxicity.HIGH + 1):
        for i in range(len(t) - n + 1):
            h = ord(t[i])
            for c in t[i + 1 : i + n]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ ord(c)
            out.add((((h ^ (n * 0x3D4D51CB & 0xFFFFFFFF)) * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - toxicity.BITS))
    return out


def test_features_equal_a_count_gram_by_gram():
    for text in ("", "a", "You FOOL\nyou", "ärger \U0001f621\U0001f621", "x" * 40, "one two three one two three"):
        assert set(toxicity.present(text).tolist()) == brute_present(text)


def test_a_long_text_has_the_features_of_its_parts(monkeypatch):
    from quillstone.llm import linear

    text = "some words and others, all over again " * 40
    whole = set(toxicity.present(text).tolist())
    monkeypatch.setattr(linear, "SLICE", 100)
    assert set(toxicity.present(text).tolist()) == whole == brute_present(text)


def test_held_out_recall_and_false_alarms(spark):
    """The bound on recall fails where nothing is called toxic, that on false alarms where much is."""
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.op4_toxicity(spark, d).join(labels, "doc_id").where("held_out")
    got = rows.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("called")).collect()
    by = {r["toxic"]: (r["n"], r["called"]) for r in got}
    assert by[1][1] >= 0.8 * by[1][0] > 0 and by[0][1] <= 0.1 * by[0][0]


def test_repeated_rows_and_ties(spark):
    docs = spark.createDataFrame([(1, "you fool")] * 3 + [(2, "you fool"), (3, None), (None, "you fool")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0)], "doc_id long, toxic int")
    got = toxicity.with_toxicity(docs.withColumn("score", F.lit("x")), toxicity.train(docs, labels)).collect()
    assert len(got) == 6 and len({r["score"] for r in got if r["text"] == "you fool"}) == 1
    flat = toxicity.with_toxicity(docs, toxicity.train(docs, labels.where("toxic = 1")))
    assert {(r["score"] < 0.5, r["predicted"]) for r in flat.collect()} == {(True, 0)}
