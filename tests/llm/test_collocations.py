"""Phrases against a count of every n-gram in Python."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import collocations as co


def grams(rows, longest=5):
    counts, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    counts[lang, tuple(w[i : i + m])] += 1
    return counts, n


def brute(rows, mining):
    counts, n = grams(rows, mining.longest)
    f = {k: v for k, v in counts.items() if v >= mining.least}
    out = collections.defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) < 2:
            continue
        if any(x == lang and len(t) > len(w) and 100 * b >= mining.share * a and any(t[i : i + len(w)] == w for i in range(len(t))) for (x, t), b in f.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted(
        (lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[: mining.top], 1)
    )


def corpus(seed, n=250):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(25)] + ["É", "ß", "A", "a b", "\U0001f600", "～", "don't"]
    passage = "The Quick brown Fox jumps over w1 w1 w1 w1"
    rows = []
    for _ in range(n):
        words = [r.choice(vocabulary[: r.choice([4, 12, 32])]) for _ in range(r.choice([0, 1, 3, 40, 120]))]
        text = "".join(w + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!? "]) for w in words)
        rows.append((r.choice(["en", "en", "en", "fr", None, "und"]), (passage + "; " if r.random() < 0.4 else "") + text))
    return rows + [("en", None), (None, ""), ("de", "only a few"), rows[0], rows[0], ("xx", " \t.,")]


@pytest.mark.parametrize("seed,mining", [(1, co.Mining(least=12, top=40)), (2, co.Mining(least=5, share=80)), (3, co.Mining(least=300, bits=16)), (4, co.Mining(least=8, longest=3, top=7))])
def test_collocations_equal_brute_force(spark, seed, mining, monkeypatch):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit(1)).withColumn("n", F.lit(2)).repartition(5)
    got = sorted(tuple(x) for x in co.collocations(df, mining).collect())
    want = brute(rows, mining)
    assert got == want and (len(want) > 20 or mining.least > 100)


def test_frequent_grams_of_every_length_are_exact(spark):
    rows = corpus(7)
    found, _ = co.frequent(spark.createDataFrame(rows, "lang string, text string"), co.Mining(least=10))
    counts, _ = grams(rows)
    for m, x in enumerate(found, 1):
        assert {(r["lang"], tuple(r["phrase"].split(" "))): r["f"] for r in x.collect()} == {k: v for k, v in counts.items() if v >= 10 and len(k[1]) == m}


def test_tables_without_phrases(spark):
    docs = spark.createDataFrame([("en", "a b"), (None, None)], "lang string, text string")
    assert co.collocations(docs).count() == 0 and co.collocations(docs.where("false")).count() == 0


def test_long_texts_are_cut_between_pieces_only():
    text = b"aa bb, cc dd ee. " * 50 + b"x y " * 100 + b"! tail"
    for most in (10, 64, 333, 10_000):
        parts = list(co.cut(text, most))
        assert b"".join(parts) == text and all(p[-1:] in [bytes([b]) for b in co.BREAKS] for p in parts[:-1])
    one = co.Words([("en", text)])
    many = co.Words([("en", p) for p in co.cut(text, 20)])
    assert one.code.tolist() == many.code.tolist() and one.whole(3).tolist() == many.whole(3).tolist()


def test_few_hashes_meet():
    words = pa.array([f"{i:b}".replace("0", "ab").replace("1", "ba").encode() for i in range(50_000)], pa.binary())
    assert len(np.unique(co.hashed(words))) == 50_000
