"""What the classifiers' fit moves: bounded by the sample's rows, not by the length of its texts."""

import numpy as np
import pytest

from quillstone.llm import linear, quality, toxicity


@pytest.mark.parametrize("kind, label", [(toxicity, "toxic"), (quality, "quality")])
def test_long_texts_do_not_meet_in_one_task(spark, kind, label):
    """160 texts of 104,000 characters: their features together are over 100 MB."""
    line = "concat(sha2(concat(id, ':', i), 256), CASE WHEN id % 2 = 1 AND i % 10 = 0 THEN ' nasty' ELSE ' n' END)"
    docs = spark.range(160).selectExpr("id AS doc_id", f"concat_ws(' ', transform(sequence(1, 1500), i -> {line})) AS text")
    written = lambda: sum(x.totalShuffleWrite() for x in [spark.sparkContext._jsc.sc().statusStore().executorList(False).head()])
    before = written()
    model = kind.train(docs, docs.selectExpr("doc_id", f"cast(doc_id % 2 AS int) AS {label}"))
    assert written() - before < 60e6
    weight = (model if kind is toxicity else model.linear).table()
    assert 0 < np.count_nonzero(weight) <= kind.FEATURES


def test_a_fit_in_blocks_is_the_fit(monkeypatch):
    r = np.random.default_rng(3)
    row, col = np.repeat(np.arange(50, dtype=np.int32), 8), r.integers(0, 20, 400).astype(np.int32)
    value, y = r.random(400, np.float32), np.arange(50) % 2
    w, b = linear.fit_logistic(row, col, value, y, 20, l2=1e-3)
    monkeypatch.setattr(linear, "BLOCK", 33)
    v, c = linear.fit_logistic(row, col, value, y, 20, l2=1e-3)
    assert np.allclose(w, v, rtol=1e-6) and abs(b - c) < 1e-6


def test_a_long_text_holds_each_bucket_once(monkeypatch):
    text = " ".join(str(i * i) for i in range(4000))
    whole = toxicity.present(text)
    monkeypatch.setattr(linear, "SLICE", 500)
    monkeypatch.setattr(toxicity, "HELD", 2000)
    assert np.array_equal(toxicity.present(text), whole)
