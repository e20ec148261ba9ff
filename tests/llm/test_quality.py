"""The quality model's features against a count, pairs of words, repeated rows and ties."""

import collections
import random
import zlib

import numpy as np

from quillstone.llm import quality


def brute_features(text):
    """Bucket -> summed weights, gram by gram."""
    out = collections.Counter()
    half = 1 << (quality.BITS - 1)
    words = text.encode().split()
    for w in words:
        out[(zlib.crc32(w) >> (32 - quality.BITS + 1)) | half] += quality.SCALE / len(words)
    for a, b in zip(words, words[1:], strict=False):
        h = ((zlib.crc32(a) * 0x01000193 & 0xFFFFFFFF) ^ zlib.crc32(b)) * 0x9E3779B1 & 0xFFFFFFFF
        out[(h >> (32 - quality.BITS + 1)) | half] += quality.SCALE / len(words)
    for c in text:
        out[(ord(c) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - quality.BITS + 1)] += quality.SCALE / len(text)
    for n in (2, 3):
        for i in range(len(text) - n + 1):
            h = ord(text[i])
            for c in text[i + 1 : i + n]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ ord(c)
            h = ((h ^ (n * 0x3D4D51CB & 0xFFFFFFFF)) * 0x9E3779B1) & 0xFFFFFFFF
            out[h >> (32 - quality.BITS + 1)] += quality.SCALE / len(text)
    return out


def test_features_equal_a_count_gram_by_gram():
    for text in ("", "a", "one two one two\nthree", "Zürich \U0001f600 zürich  é", "x" * 50):
        at, value = quality.Features().sparse(text)
        want = {k: v for k, v in brute_features(text).items()}
        assert set(at.tolist()) == set(want) and np.allclose([want[k] for k in at.tolist()], value, rtol=1e-4)


def test_order_of_words_decides_where_nothing_else_differs(spark):
    """Good and bad texts have the same words and the same characters around their borders; only pairs of words tell them apart."""
    r = random.Random(4)
    good, bad = [("xaax", "xbbx"), ("xccx", "xddx")], [("xaax", "xddx"), ("xccx", "xbbx")]
    docs, labels = [], []
    for i in range(240):
        pairs = good if i % 2 else bad
        chosen = pairs * 10
        r.shuffle(chosen)
        docs.append((i, " xx ".join(" ".join(p) for p in chosen)))
        labels.append((i, i % 2))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.train(d.where("doc_id < 160"), y)
    weight, f = model.linear.table(), quality.Features()
    said = [(model.slope * (model.linear.bias + f.logit(t, weight)) + model.shift > 0) == bool(i % 2) for i, t in docs[160:]]
    assert sum(said) >= 0.95 * len(said)


def test_repeated_rows_and_ties_have_one_result(spark):
    docs = spark.createDataFrame([(1, "some words that are said here and there now and then again")] * 3 + [(2, None), (None, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.with_quality(docs, quality.train(docs, none)).collect()
    assert len(got) == 5 and len({tuple(x) for x in got if x["doc_id"] == 1}) == 1
