"""Targets against exact fractions, takings against their bound, and the whole result against SQL."""

import random
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from quillstone.llm import mixing


def brute_targets(sizes: dict, weights=(5, 2, 1), epochs=3) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, held = sum(sizes.values()), {}
    while True:
        live = sum(weight[s] for s in names if s not in held)
        rest = total - sum(held.values())
        share = {s: Fraction(rest * weight[s], live) for s in names if s not in held}
        over = [s for s, x in share.items() if x > epochs * sizes[s]]
        if not over:
            return held | share
        held |= {s: epochs * sizes[s] for s in over}


def corpus(seed, hot=0.4, n=600):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if r.random() < hot else r.choice([None, "", "a", "Z", "é", "\U0001f600", "～", *(f"s{k}" for k in range(9))])
        text = None if r.random() < 0.03 else "\x0b".join("w" * r.randrange(1, 4) for _ in range(r.choice([0, 1, 5, 60, 900])))
        rows.append((i if r.random() < 0.9 else (None if r.random() < 0.3 else i // 2), source, text))
    return rows + [rows[3]] * 5 + [(n + 1, "empty", ""), (n + 2, "empty", None), (n + 3, "one", "x y")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("target", F.lit("x")).withColumn("size", F.lit("y"))


@pytest.mark.parametrize("seed,few", [(1, True), (2, False)])
def test_mix_equals_brute_force_and_sql(spark, seed, few, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10_000 if few else 0)
    rows = corpus(seed)
    out = mixing.mix_sources(mixing.with_sizes(frame(spark, rows)))
    got = out.select("doc_id", "size", "source_size", "target", "source", "repeats", "taken").collect()
    assert len(got) == len(rows)
    sizes, taken, largest = {}, {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
        assert r["taken"] == r["size"] * r["repeats"] and 0 <= r["repeats"] <= 3
    want = brute_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(float(want[r["source"]]), rel=1e-12)
    for s, x in want.items():  # six rows of one id and text go together
        assert abs(taken[s] - x) <= 3 * largest[s] + 1
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, source VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    theirs = con.execute(f"SELECT doc_id, size, source_size, target, source, repeats, taken FROM ({mixing.OP13_SQL})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(theirs, key=key)
    assert mixing.repeated(out).count() == sum(r["repeats"] for r in got)


def test_half_a_document_is_the_most_a_source_misses(spark):
    rows = [(i, "big" if i % 3 else "small", "w " * (i % 7 + 1)) for i in range(3000)]
    got = mixing.mix_sources(mixing.with_sizes(frame(spark, rows))).groupBy("source", "target").agg(F.sum("taken").alias("t"), F.max("size").alias("m")).collect()
    assert all(abs(r["t"] - r["target"]) <= r["m"] / 2 + 1 for r in got) and len(got) == 2


def test_seeds_weights_and_tables_without_words(spark):
    rows = [(i, f"s{i % 4}", "w " * 20) for i in range(200)]

    def choose(seed):
        mix = mixing.Mix((1, 3), 2, seed)
        return {r[0] for r in mixing.mix_sources(mixing.with_sizes(frame(spark, rows), mix), mix).where("repeats > 1").select("doc_id").collect()}

    assert choose("a") == choose("a") and choose("a") != choose("b")
    none = mixing.mix_sources(mixing.with_sizes(frame(spark, [(1, "a", None), (2, None, "")]))).collect()
    assert {(r["target"], r["taken"], r["source_size"]) for r in none} == {(0.0, 0, 0)}
    assert mixing.mix_sources(mixing.with_sizes(frame(spark, rows)).where("false")).count() == 0
    with pytest.raises(ValueError):
        mixing.Mix(())
