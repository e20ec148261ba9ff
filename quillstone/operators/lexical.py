"""Lexical index and BM25: postings, lengths and document frequencies are plain frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import tokenize
from ..plans.config import SearchConfig


@dataclass(frozen=True)
class LexicalIndex:
    """postings (key, term, tf), lengths (key, ord, len), frequencies (term, df), stats: one row (n, avg_len)."""

    postings: DataFrame
    lengths: DataFrame
    frequencies: DataFrame
    stats: DataFrame

    def write(self, path: str) -> None:
        """Postings are clustered by term, so a search reads the row groups of its terms."""
        self.postings.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        for name in ("lengths", "frequencies", "stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark, path: str) -> LexicalIndex:
        return cls(*[spark.read.parquet(f"{path}/{x}") for x in ("postings", "lengths", "frequencies", "stats")])


def with_term_counts(rows: DataFrame, words: str = "w") -> DataFrame:
    """rows with terms and tfs, arrays of the distinct words in order and of how often each stands, in place of the array of words: they are
    sorted and their runs counted in the row, so nothing is shuffled."""
    sorted_ = rows.withColumn(words, F.array_sort(words))
    first = lambda x, i: (i == 0) | (F.get(words, i - 1) != x)
    at = F.filter(F.transform(words, lambda x, i: F.when(first(x, i), i)), lambda i: i.isNotNull())
    runs = sorted_.withColumn("_at", at)
    tfs = F.transform("_at", lambda i, j: (F.coalesce(F.get("_at", j + 1), F.size(words)) - i).cast("long"))
    return runs.withColumn("terms", F.filter(words, first)).withColumn("tfs", tfs).drop(words, "_at")


def _postings(words: DataFrame) -> DataFrame:
    """key, term, tf. A row's terms are counted in the row; only the rows of keys that stand more than once are added up in a shuffle."""
    each = lambda rows: with_term_counts(rows.select("key", "w")).select("key", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("key", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
    again = words.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("_key"))
    if again.isEmpty():
        return each(words)
    same = F.col("key").eqNullSafe(F.col("_key"))
    added = each(words.join(again, same, "left_semi")).groupBy("key", "term").agg(F.sum("tf").alias("tf"))
    return each(words.join(again, same, "left_anti")).unionByName(added)


def build_lexical_index(units: DataFrame, key_col="key", ord_col="ord", text_col="text") -> LexicalIndex:
    """Of units with a key, an order that breaks ties and a text. Units without tokens count in n and avg_len."""
    words = units.select(F.col(key_col).alias("key"), F.col(ord_col).cast("long").alias("ord"), tokenize(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    postings = _postings(words)
    lengths = words.select("key", "ord", F.size("w").cast("long").alias("len"))
    frequencies = postings.groupBy("term").agg(F.count("*").alias("df"))
    stats = lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_len"))
    return LexicalIndex(postings, lengths, frequencies, stats)


def query_terms(spark, query: str) -> DataFrame:
    """term, qtf: a repeated term counts as often as it stands in the query."""
    return spark.range(1).select(F.explode(tokenize(F.lit(query))).alias("term")).groupBy("term").agg(F.count("*").alias("qtf"))


def bm25_scores(index: LexicalIndex, terms: DataFrame, k1: float = SearchConfig.k1, b: float = SearchConfig.b) -> DataFrame:
    """key, ord, score of the units that hold a term. terms: (term, qtf), or (query, term, qtf) for many queries at once.

    A query is a few rows, so the postings are filtered by a broadcast of them where the planner has measured that.
    """
    by = ["query"] if "query" in terms.columns else []
    hit = index.postings.join(terms, "term").join(index.frequencies, "term").join(index.lengths, "key").crossJoin(F.broadcast(index.stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return hit.groupBy(*by, "key", "ord").agg(F.sum(F.col("qtf") * idf * weight).alias("score"))


def ranked(scores: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The k best with rank, ties by ord; scores are rounded first, so that summing order decides nothing."""
    best = scores.withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), "ord").limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "ord")).cast("long"))


def bm25_search(index: LexicalIndex, query: str, k: int = 10, k1: float = SearchConfig.k1, b: float = SearchConfig.b) -> DataFrame:
    return ranked(bm25_scores(index, query_terms(index.postings.sparkSession, query), k1, b), k)


def bm25_over(
    units: DataFrame, query: str, k: int = 10, key_col="key", ord_col="ord", text_col="text", k1: float = SearchConfig.k1, b: float = SearchConfig.b
) -> DataFrame:
    """bm25_search where no index is stored: one scan counts the units that hold each term of the query, one scores; nothing but the
    counts and the k best of each task is shuffled. Only the query's own terms come to the driver."""
    asked = [(r["term"], r["qtf"]) for r in query_terms(units.sparkSession, query).orderBy("term").collect()]
    names = [t for t, _ in asked]
    words = units.select(F.col(key_col).alias("key"), F.col(ord_col).cast("long").alias("ord"), tokenize(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    held = words.select("key", "ord", F.size("w").alias("len"), F.filter("w", lambda x: x.isin(names)).alias("w"))
    dfs = [F.count_if(F.array_contains("w", t)).alias(f"_df{i}") for i, t in enumerate(names)]
    stats = held.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *dfs)
    score = F.lit(0.0)
    for i, (term, qtf) in enumerate(asked):
        df, tf = F.col(f"_df{i}"), F.size("w") - F.size(F.array_remove("w", term))
        score = score + qtf * F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    # units without a term get null and go after the limit: a filter before it would make the tokens twice
    scored = held.crossJoin(F.broadcast(stats)).select("key", "ord", F.when(F.size("w") > 0, score).alias("score"))
    return ranked(scored, k).where("score IS NOT NULL")
