"""Python work runs on small slices of Arrow batches; results do not depend on the cuts."""

import numpy as np
import pyarrow as pa

from quillstone.functions.slices import cuts, sizes
from quillstone.operators import ann, claims, entities
from quillstone.plans import providers
from quillstone.plans.config import AnnConfig
from quillstone.sources.documents import load_corpus


def test_cuts_hold_rows_and_bytes_and_miss_nothing():
    assert list(cuts(np.array([3, 3, 9, 1, 1, 1, 1]), rows=3, most=6)) == [(0, 2), (2, 3), (3, 6), (6, 7)]
    assert list(cuts(np.array([], np.int64))) == [] and list(cuts(np.zeros(5, np.int64), rows=2)) == [(0, 2), (2, 4), (4, 5)]
    assert sizes(pa.array(["ab", None, "ü"])).tolist() == [2, 0, 2] and sizes(pa.array([["a", "b"], None, []])).tolist() == [2, 0, 0]


def test_a_token_classifier_sees_few_texts_at_once(spark):
    def model(texts):
        assert len(texts) <= 512 and sum(map(len, texts)) <= 1 << 18 or len(texts) == 1
        return [(t.split(), [[0.0, 9.0, 0.0]] * len(t.split()), [1] * len(t.split())) for t in texts]

    texts = spark.range(0, 3000, 1, 1).selectExpr("id", "IF(id = 7, repeat('Word ', 100000), IF(id % 3 = 0, null, 'Ann Bob')) AS text")
    found = entities.extract_entities(texts, ["id"], classifier=entities.token_classifier(model, ["O", "B-PER", "I-PER"], ["id"]))
    assert found.where("id <> 7").count() == 2 * 1999 and found.where("id = 7").count() == 100000
    assert found.where("id = 8").orderBy("ord").select("type", "surface", "ord").collect() == [("PER", "Ann", 4_000_000), ("PER", "Bob", 4_000_001)]


def test_claims_are_split_in_slices(spark, monkeypatch):
    rows_of = claims.rows_of

    def few(batch, *more):
        assert len(batch) <= 512
        return rows_of(batch, *more)

    monkeypatch.setattr(claims, "rows_of", few)
    said = spark.range(0, 3000, 1, 1).selectExpr("id", "IF(id % 2 = 0, 'One is so [1]. Two is not [2][1].', null) AS text")
    got = claims.claims_of(said, "id", "text")
    assert got.count() == 3000 and [tuple(r) for r in got.where("id = 4").orderBy("claim_ord").collect()] == [(4, 0, "One is so [1].", [1], False), (4, 1, "Two is not [2][1].", [2, 1], False)]


def test_texts_are_hashed_in_slices(spark, monkeypatch):
    whole, hashed = providers.hashed_weights, providers.hashed_weights

    def few(tokens, dims):
        assert len(tokens.flatten()) <= 1 << 17
        return hashed(tokens, dims)

    monkeypatch.setattr(providers, "hashed_weights", few)
    texts = spark.range(0, 3000, 1, 1).selectExpr("id", "IF(id = 9, null, repeat(concat('word', id % 50, ' of '), 50)) AS text")
    sparse, made = providers.HashEmbedder().sparse(texts, "id", "text").toArrow(), providers.HashEmbedder().embed(texts, "text").orderBy("id").toArrow()
    row, bucket, weight = whole(pa.array([[] if i == 9 else [f"word{i % 50}", "of"] * 50 for i in range(3000)]), 512)
    assert sorted(zip(*[sparse[c].to_pylist() for c in ("id", "bucket", "weight")], strict=True)) == sorted(zip(row.tolist(), bucket.tolist(), weight.tolist(), strict=True))
    vectors = np.array(made["embedding"].to_pylist())
    assert vectors.shape == (3000, 512) and not vectors[9].any() and np.allclose(np.delete(np.linalg.norm(vectors, axis=1), 9), 1, atol=1e-6)


def test_vectors_lie_in_graphs_of_a_bounded_size(spark):
    vectors = spark.range(9000).selectExpr("id AS key", "array(cast(sin(id) AS float), cast(cos(id) AS float)) AS embedding")
    graphs = ann.build_ann(vectors, 2, AnnConfig(m=4, ef_construction=8)).select("part", "count").collect()
    assert len(graphs) == 2 and sum(g["count"] for g in graphs) == 9000


def test_a_single_tree_is_read_without_a_shuffle(spark, tmp_path):
    for name in ("a/x.md", "b/x.md"):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(f"text of {name}")
    read = load_corpus(spark, str(tmp_path))
    assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["body"] for r in read.collect()) == ["text of a/x.md", "text of b/x.md"]
