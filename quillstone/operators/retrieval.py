"""Vector search, fusion with keyword ranks, caps per document, comparison, triage and reranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.vectors import dot, dot_q8, norm, quantize
from .ordering import numbered, numbered_within


def vector(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def check_dims(vectors: DataFrame, dims: int, vec_col="embedding") -> DataFrame:
    """The vectors; reading one of another width raises."""
    wrong = F.raise_error(F.concat(F.lit(f"expected {dims} dimensions, got "), F.size(vec_col).cast("string")))
    return vectors.withColumn(vec_col, F.when(F.size(vec_col) == dims, F.col(vec_col)).otherwise(wrong))


def append_vectors(store: DataFrame, new: DataFrame, dims: int) -> DataFrame:
    return store.unionByName(check_dims(new, dims))


def score(vectors: DataFrame, query: Column, vec_col="embedding") -> DataFrame:
    return vectors.withColumn("score", F.round(dot(F.col(vec_col), query), 6))


def knn(vectors: DataFrame, query: Column, k: int, min_score: float | None = None, key_col="key", vec_col="embedding") -> DataFrame:
    """key, score, rank of the k largest dot products at or above the floor; ties by key."""
    hits = score(vectors, query, vec_col).select(F.col(key_col), "score")
    if min_score is not None:
        hits = hits.where(F.col("score") >= min_score)
    best = hits.orderBy(F.desc("score"), key_col).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), key_col)).cast("long"))


def dealt(rows: DataFrame, key_col: str, most: int, name: str) -> tuple[DataFrame, int]:
    """rows with a block number by a hash of the key, and how many blocks of about ``most`` rows there are."""
    n = max(1, -(-rows.count() // most))
    return rows.withColumn(name, F.pmod(F.xxhash64(key_col), F.lit(n)).cast("int")), n


def knn_many(
    queries: DataFrame, vectors: DataFrame, k: int, query_key="query", key_col="key", vec_col="embedding", most_queries: int = 50_000, most_vectors: int = 200_000
) -> DataFrame:
    """For each query the k best vectors: blocks of queries meet blocks of vectors, the k best of each are kept there, then merged.

    Nothing goes through the driver. A task holds one block of each at a time and scores it in slices; each hands on k rows for each
    query at most. Ties fall by key; queries that share a key are ranked together, vectors that do are rows of their own.
    """
    kind, asked = dict(vectors.dtypes)[key_col], dict(queries.dtypes)[query_key]
    q, n_q = dealt(queries.select(F.col(query_key).alias("q"), F.col(vec_col).alias("x")), "q", most_queries, "_q")
    v, n_v = dealt(vectors.select(F.col(key_col).alias("key"), F.col(vec_col).alias("x")), "key", most_vectors, "_v")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left, right = q.withColumn("_v", every(n_v)).groupBy("_q", "_v"), v.withColumn("_q", every(n_q)).groupBy("_q", "_v")
    hits = left.cogroup(right).applyInArrow(lambda a, b: nearest(a, b, k), f"q {asked}, key {kind}, score double")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "key")).cast("long")
    best = hits.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select(F.col("q").alias(query_key), F.col("key").alias(key_col), "score", "rank")


#: Scores that a task holds at once.
SLICE = 1 << 22


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def nearest(asked: pa.Table, stored: pa.Table, k: int) -> pa.Table:
    """q, key, score of the k largest rounded dot products for each row of asked."""
    if not len(asked) or not len(stored):
        return pa.table({"q": asked["q"].slice(0, 0), "key": stored["key"].slice(0, 0), "score": pa.array([], pa.float64())})
    stored = stored.sort_by("key")
    a, b = matrix(asked["x"]), matrix(stored["x"])
    rows, columns, scores = [], [], []
    step = max(1, SLICE // len(b))
    for at in range(0, len(a), step):
        s = np.round(a[at : at + step] @ b.T, 6)
        least = np.partition(s, len(b) - k, axis=1)[:, len(b) - k] if k < len(b) else None
        for i in range(len(s)):
            if least is None:
                found = np.arange(len(b))
            else:  # of those at the k-th score the ones with the smallest keys, which come first
                above = np.flatnonzero(s[i] > least[i])
                found = np.concatenate([above, np.flatnonzero(s[i] == least[i])[: k - len(above)]])
            rows.append(np.full(len(found), at + i))
            columns.append(found)
            scores.append(s[i, found])
    at, of = pa.array(np.concatenate(rows)), pa.array(np.concatenate(columns))
    return pa.table({"q": asked["q"].take(at), "key": stored["key"].take(of), "score": pa.array(np.concatenate(scores))})


def score_candidates(vectors: DataFrame, query: Column, candidates: DataFrame, key_col="key", vec_col="embedding") -> DataFrame:
    """Scores of the given keys only."""
    return score(vectors.join(candidates.select(key_col).distinct(), key_col, "left_semi"), query, vec_col).select(key_col, "score")


def quantized(vectors: DataFrame, key_col="key", vec_col="embedding") -> DataFrame:
    return vectors.select(key_col, quantize(vec_col).alias("q")).select(key_col, "q.codes", "q.scale")


def knn_q8(codes: DataFrame, query: Column, k: int, key_col="key") -> DataFrame:
    """k best by quantised dot product; the query is quantised once."""
    one = codes.sparkSession.range(1).select(quantize(query).alias("q")).select(F.col("q.codes").alias("qc"), F.col("q.scale").alias("qs"))
    hits = codes.crossJoin(F.broadcast(one)).select(key_col, F.round(dot_q8("codes", "scale", "qc", "qs"), 6).alias("score"))
    best = hits.orderBy(F.desc("score"), key_col).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), key_col)).cast("long"))


def centroids(vectors: DataFrame, by: str, vec_col="embedding") -> DataFrame:
    """by, embedding: the component-wise mean of each group, renormalised. Partial sums cross the shuffle, not vectors."""
    mean = vectors.select(by, F.posexplode(vec_col).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = mean.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
    n = norm("mean")
    return whole.select(by, F.transform("mean", lambda x: F.when(n == 0, x).otherwise(x / n)).alias("embedding"))


def per_doc_cap(hits: DataFrame, cap: int, want: int, doc_col="doc_id", score_col="score", ord_col="ord", pulled: int | None = None) -> DataFrame:
    """Of the ``pulled`` best at most ``cap`` of a document, the first ``want`` of them, with sem_rank."""
    best = hits.orderBy(F.desc(score_col), ord_col).limit(pulled) if pulled else hits
    own = F.row_number().over(W.partitionBy(doc_col).orderBy(F.desc(score_col), ord_col))
    kept = best.withColumn("_own", own).where(F.col("_own") <= cap).drop("_own").orderBy(F.desc(score_col), ord_col).limit(want)
    return kept.withColumn("sem_rank", F.row_number().over(W.orderBy(F.desc(score_col), ord_col)).cast("long"))


def annotate_keyword_rank(hits: DataFrame, keyword: DataFrame, key_col="key") -> DataFrame:
    """Hits with keyword_rank, null where the keyword search has not ranked them."""
    return hits.join(keyword.select(key_col, F.col("rank").alias("keyword_rank")), key_col, "left")


def compare(keyword: DataFrame, semantic: DataFrame, key_col="key") -> DataFrame:
    """Keyword hits (key, ord, rank) ordered anew by semantic score: new_rank and delta = old - new."""
    both = keyword.select(key_col, "ord", F.col("rank").alias("keyword_rank")).join(semantic.select(key_col, "score"), key_col, "left")
    new = F.row_number().over(W.orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "keyword_rank")).cast("long")
    return both.withColumn("new_rank", new).withColumn("delta", F.col("keyword_rank") - F.col("new_rank"))


#: Prototypes that are sent to every task at most.
FEW_PROTOTYPES = 10_000


def classify(queries: DataFrame, prototypes: DataFrame, min_confidence: float = 0.28, query_key="query", vec_col="embedding", multilingual: bool = True) -> DataFrame:
    """Each query's nearest prototype (route, label, gate, ord, embedding): first route of the best score, `unclear` below the
    threshold; `unclear` never gates. Routes without a prototype take no part. With a model that is not multilingual, queries of
    locale hi pass through and are never gated. Each query meets all prototypes: they are counted, and sent to every task while they
    are few; of many the nearest are found in blocks.
    """
    live = prototypes.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).select("route", "label", "gate", "ord", F.col(vec_col).alias("_p"))
    if live.count() <= FEW_PROTOTYPES:
        scored = queries.crossJoin(F.broadcast(live)).withColumn("score", F.round(dot(vec_col, "_p"), 6))
        best = scored.withColumn("_n", F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("score"), "ord"))).where("_n = 1")
    else:  # ord tells routes apart, as it does between equal scores
        near = knn_many(queries, live.select("ord", F.col("_p").alias(vec_col)), 1, query_key, "ord", vec_col)
        own = [query_key] + (["locale"] if "locale" in queries.columns else [])
        best = near.join(live.drop("_p"), "ord").join(queries.select(*own), query_key)
    clear = F.col("score") >= min_confidence
    passing = F.lit(False) if multilingual or "locale" not in queries.columns else F.coalesce(F.col("locale") == "hi", F.lit(False))
    return best.select(
        query_key, F.when(passing, "passthrough").when(clear, F.col("route")).otherwise("unclear").alias("route"),
        F.col("score").alias("confidence"), (clear & F.col("gate") & ~passing).alias("gate"),
    )


def rerank(results: DataFrame, query: str, scorer, candidates: int = 12, keep: int = 8, text_col="text") -> DataFrame:
    """The first ``candidates`` by sem_rank scored as pairs by ``scorer(query, texts) -> logits``; the best ``keep`` with their old
    rank as bi_rank. Without a scorer the order stands and cross_score is null.
    """
    top = results.where(F.col("sem_rank") <= candidates).withColumnRenamed("sem_rank", "bi_rank")
    if scorer is None:
        return top.where(F.col("bi_rank") <= keep).withColumn("cross_score", F.lit(None).cast("double")).withColumn("sem_rank", F.col("bi_rank"))

    @F.pandas_udf("double")
    def cross(texts: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-np.asarray(scorer(query, texts.tolist()), float))))

    done = top.withColumn("cross_score", F.round(cross(text_col), 6))
    new = F.row_number().over(W.orderBy(F.desc("cross_score"), "bi_rank")).cast("long")
    return done.withColumn("sem_rank", new).where(F.col("sem_rank") <= keep)


def stride_sample(rows: DataFrame, cap: int, order: list[str], by: list[str] | None = None) -> DataFrame:
    """``cap`` rows at even strides, floor(i * n / cap), of each group with more; all of smaller ones. Without groups all rows are one.

    Places come from ordering: a hot group, or the only one, is numbered by many tasks.
    """
    if by:
        placed = numbered_within(rows, by, order, "_i", "_n")
    else:
        placed = numbered(rows, order, "_i").crossJoin(F.broadcast(rows.agg(F.count("*").alias("_n"))))
    # row i is taken if some j < cap has floor(j * n / cap) = i: whole numbers only, products of a long and the cap
    j = F.expr(f"(_i * {cap} + _n - 1) div _n")
    return placed.where((F.col("_n") <= cap) | ((j < cap) & (F.expr(f"((_i * {cap} + _n - 1) div _n) * _n div {cap}") == F.col("_i")))).drop("_i", "_n")


def last_n(rows: DataFrame, n: int, order: list, by: list[str] | None = None) -> DataFrame:
    """The n last rows in the order; without groups a top-n, never a single-task sort."""
    newest = [F.desc(c) for c in order]
    if not by:
        return rows.orderBy(*newest).limit(n)
    return rows.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy(*newest))).where(F.col("_i") <= n).drop("_i")
