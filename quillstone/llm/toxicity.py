"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .linear import UNIT, Model, char_grams, codes, fit_logistic, fitted, labelled_sample, most, sigmoid, sliced, two_classes
from .common import give_back, table

BITS, LOW, HIGH = 20, 3, 6
#: Labelled rows of each class that are learnt from at most, and n-gram buckets that are kept at most.
PER_CLASS, FEATURES = 3000, 3000
#: The likelihood ratio statistic that a bucket needs to be kept.
LEAST_G2 = 15.0
#: Buckets of a long text's pieces, where they repeat, that are held at once; twice as many as there are.
HELD = 2 << BITS


BLANK = dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")


def present(text: str, wanted: np.ndarray | None = None) -> np.ndarray:
    """The distinct buckets of a whole text's character n-grams, lower-cased; only ``wanted`` ones where given."""
    found, held = [], 0
    for piece, _ in sliced(f" {text.lower()} ".translate(BLANK), HIGH):
        for h in char_grams(codes(piece), LOW, HIGH, BITS):
            found.append(np.unique(h if wanted is None else h[wanted[h]]))
            held += len(found[-1])
            if held > HELD:
                found = [np.unique(np.concatenate(found))]
                held = len(found[0])
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint32)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, features: int = FEATURES, id_col="doc_id", text_col="text", label="toxic") -> Model:
    """Log-count ratios r of binary n-gram features, then a logistic regression on the features times r.

    Learns from at most ``per_class`` labelled rows of each class (see labelled_sample). Without rows of both
    classes every text scores 0.5 at zero weights, below it only by the bias: score 0.
    """
    sample = labelled_sample(docs, labels, label, per_class, id_col, text_col)
    return Model(*fitted(sample, lambda text: (present(text), None), 1, BITS, lambda sums, n: choose(sums[:, 0] // UNIT, n, features), fit), BITS)


def choose(of: np.ndarray, n: np.ndarray, features: int) -> np.ndarray:
    """Buckets whose presence depends on the class by the likelihood ratio statistic; of: texts that have a bucket, n: all texts, by class."""
    if not two_classes(n):
        return np.empty(0, np.int64)
    both = of[0] + of[1]
    term = lambda seen, due: np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(due, 1e-9)), 0)
    g2 = 2 * sum(term(of[k], both * n[k] / n.sum()) + term(n[k] - of[k], (n.sum() - both) * n[k] / n.sum()) for k in (0, 1))
    return most(np.where(g2 >= LEAST_G2, g2, 0), features)


def fit(row: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Chosen buckets, their weights and the bias: a logistic regression on presence times the log-count ratio."""
    if not two_classes(np.bincount(y, minlength=2)):
        return chosen, np.empty(0), -60.0
    rate = [(np.bincount(col[(y == k)[row]], minlength=len(chosen)) + 0.5) / ((y == k).sum() + 1) for k in (0, 1)]
    ratio = np.log(rate[1] / rate[0])
    w, b = fit_logistic(row, col, ratio[col], y, len(chosen), l2=1e-3, steps=150, rate=0.02)
    return chosen, w * ratio, b


def score_column(model: Model, text: Column) -> Column:
    """The probability, 0 to 1, that a text is toxic; null and empty texts score as texts without any n-gram known."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        give_back()
        weight = model.table()
        wanted = weight != 0
        return pd.Series([float(sigmoid(model.bias + weight[present(x or "", wanted)].sum(dtype=np.float64))) for x in texts])

    return score(text)


def learnable(id_col: Column) -> Column:
    """Rows whose labels may be learnt: crc32 of the id as text mod 5 is not 0. A null id counts as held out."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 != 0


def with_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score and predicted (1 if score >= 0.5). Any column of these names is replaced."""
    return docs.withColumn("score", score_column(model, F.col(text_col))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def trained(spark: SparkSession, sf_dir: str) -> Model:
    labels = table(spark, sf_dir, "labels")
    return train(table(spark, sf_dir, "documents"), labels.where(learnable(F.col("doc_id"))))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_toxicity(docs, trained(spark, sf_dir)).select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", "predicted")
