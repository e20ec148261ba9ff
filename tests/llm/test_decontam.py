"""Short items, and the cut-offs of size partitions with and without listed hashes, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.llm import decontam


def made(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.choice([1, 2, 3, 4, 5, 5, 6, 7, 12, 40, 90]))) for i in range(60)] + [(60, None), (61, " "), (62, "W1\tw2")]
    docs = [(d, text(r.choice([0, 1, 3, 5, 6, 30, 150]))) for d in range(80)]
    docs += [(100 + i, "x " + (t or "").upper() + " y") for i, t in items if i % 2] + [(300, None), (3, docs[3][1])]
    return docs, items


def brute(docs, items, k=5):
    words = lambda t: (t or "").encode().lower().decode().split()
    sets = lambda w: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    long, short = set(), set()
    for i, t in items:
        w = words(t)
        for d, x in docs:
            v = words(x)
            if len(w) >= k and 10 * len(sets(w) & sets(v)) >= 8 * len(sets(w)):
                long.add((d, i))
            if 0 < len(w) < k and any(v[j : j + len(w)] == w for j in range(len(v))):
                short.add((d, i))
    return long, short


@pytest.mark.parametrize("listed,rows", [(2000, 200_000), (0, 200_000), (40, 200_000), (40, 0)])
def test_pairs_equal_brute_force_however_hashes_are_cut(spark, listed, rows, monkeypatch):
    monkeypatch.setattr(decontam, "LISTED", listed)
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", rows)
    docs, items = made(1)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_cut", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, text string")
    long, short = brute(docs, items)
    assert {(x["doc_id"], x["item_id"]) for x in decontam.find_contained(d, i).collect()} == long and len(long) > 15
    assert {(x["doc_id"], x["item_id"]) for x in decontam.find_short(d, i).collect()} == short and len(short) > 50
    kept = decontam.decontaminate(d, i)
    assert {x["doc_id"] for x in kept.collect()} == {x for x, _ in docs} - {x for x, _ in long}
    both = decontam.decontaminate(d, i, short_items=True)
    assert {x["doc_id"] for x in both.collect()} == {x for x, _ in docs} - {x for x, _ in long | short} and both.columns == d.columns


def test_short_items_of_empty_tables(spark):
    d, i = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert decontam.find_short(d, i.where("false")).count() == 0 and decontam.find_short(d.where("false"), i).count() == 0
    assert decontam.find_short(d, i).count() == 1
