"""Quality rules: text statistics, and a calibrated logistic regression on hashed word and character n-grams."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .linear import UNIT, Model, char_grams, codes, fit_logistic, fitted, labelled_sample, most, sigmoid, sliced, two_classes
from .common import give_back, table

BITS, LOW, HIGH, FEATURES = 18, 1, 3, 6000
#: Labelled rows of each class that are learnt from at most; every fourth of them calibrates.
PER_CLASS = 3000
#: Texts of a lower calibrated probability of quality 1 are rejected.
KEEP_FROM = 0.3
SPACE = " \t\n\x0b\x0c\r"
WINDOW = 5
SCALE = 30.0  # of the relative frequencies, so that weights stay small


def statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text.

    bytes.split() splits at exactly the six ASCII white-space characters.
    """
    words = text.encode("utf-8", "surrogatepass").split()
    word_chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated(words)


def repeated(words: list) -> int:
    """How many words stand in a window of WINDOW words that occurs at least twice, first included."""
    m = len(words) - WINDOW + 1
    if m < 2:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    h = ids[:m].copy()
    for k in range(1, WINDOW):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : m + k]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(m, bool)  # windows whose hash occurs twice: hold the windows themselves against each other
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    at = np.flatnonzero(hit).tolist()
    window = [tuple(words[i : i + WINDOW]) for i in at]
    often = Counter(window)
    edge = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(at, window, strict=True):
        if often[w] > 1:
            edge[i] += 1
            edge[i + WINDOW] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


class Features:
    """Relative frequencies of hashed words, pairs of neighbouring words and character n-grams; words in the upper half of the buckets."""

    def __init__(self):
        self.known: dict = {}

    def buckets(self, text: str):
        """Arrays of buckets with the weight that one occurrence has."""
        half = np.uint32(1 << (BITS - 1))
        n = max(1, len(text))
        for piece, own in sliced(text, HIGH):
            code = codes(piece)
            yield (code[:own] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS + 1), 1 / n
            for h in char_grams(code, 2, HIGH, BITS - 1):
                yield h[:own], 1 / n
        words = text.encode("utf-8", "surrogatepass").split()
        if len(self.known) > 200_000:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = zlib.crc32(w)
        word = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
        yield (word >> np.uint32(32 - BITS + 1)) | half, 1 / max(1, len(words))
        pair = ((word[:-1] * np.uint32(0x01000193)) ^ word[1:]) * np.uint32(0x9E3779B1)
        yield (pair >> np.uint32(32 - BITS + 1)) | half, 1 / max(1, len(words))

    def sparse(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros(1 << BITS, np.float32)
        for b, one in self.buckets(text):
            np.add.at(out, b, np.float32(one * SCALE))
        at = np.flatnonzero(out)
        return at, out[at]

    def logit(self, text: str, weight: np.ndarray) -> float:
        return sum(float(weight[b].sum(dtype=np.float64)) * one * SCALE for b, one in self.buckets(text))


@dataclass(frozen=True)
class QualityModel:
    """slope and shift: the calibration of the logit on rows that the weights haven't seen."""

    linear: Model
    slope: float
    shift: float


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, features: int = FEATURES, id_col="doc_id", text_col="text", label="quality") -> QualityModel:
    """Learns from at most ``per_class`` labelled rows of each class (see labelled_sample).

    The buckets with the largest differences of mean frequency, in standard errors, get weights; three of four rows
    fit them, the others fit slope and shift (Platt's calibration, classes weighted alike). Without rows of both classes
    every text has probability 1.
    """
    sample = labelled_sample(docs, labels, label, per_class, id_col, text_col)
    bucket, weight, bias, slope, shift = fitted(sample, lambda text: Features().sparse(text), 2, BITS, lambda sums, n: choose(sums / UNIT, n, features), fit)
    return QualityModel(Model(bucket, weight, bias, BITS), slope, shift)


def choose(sums: np.ndarray, n: np.ndarray, features: int) -> np.ndarray:
    """Buckets whose mean frequencies in the classes are most standard errors apart; sums: of frequencies and of their squares by class."""
    if not two_classes(n):
        return np.empty(0, np.int64)
    one, two = ([sums[k, m] / n[k] for k in (0, 1)] for m in (0, 1))
    # rounding can bring the variance of a value that never changes below zero
    error = np.sqrt(np.maximum(0, two[0] - one[0] ** 2) / n[0] + np.maximum(0, two[1] - one[1] ** 2) / n[1] + 1e-9)
    return most(np.abs(one[1] - one[0]) / error, features)


def fit(row: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """Chosen buckets, weights, bias, slope and shift."""
    if not two_classes(np.bincount(y, minlength=2)):
        return chosen, np.empty(0), 0.0, 0.0, 60.0
    fits = np.arange(len(y)) % 4 != 0
    if len(set(y[fits])) < 2 or len(set(y[~fits])) < 2:
        fits[:] = True
    part = fits[row]
    w, b = fit_logistic(np.cumsum(fits)[row[part]] - 1, col[part], value[part], y[fits], len(chosen), l2=1e-4)
    rest = ~fits if (~fits).any() else fits
    z = (np.bincount(row, weights=value * w[col], minlength=len(y)) + b)[rest]
    slope, shift = fit_logistic(np.arange(len(z)), np.zeros(len(z), int), z, y[rest], 1, l2=1e-3)
    return chosen, w, b, float(slope[0]), shift


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, probability double"


def rated(model: QualityModel, text: Column) -> Column:
    """struct of SCHEMA for each whole text, in Arrow batches; a null text counts as empty."""

    @F.pandas_udf(SCHEMA)
    def rate(texts: pd.Series) -> pd.DataFrame:
        give_back()
        weight, kind = model.linear.table(), Features()
        rows = []
        for x in texts:
            x = x or ""
            z = model.slope * (model.linear.bias + kind.logit(x, weight)) + model.shift
            rows.append((*statistics(x), float(sigmoid(z))))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return rate(text)


def with_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """``docs`` with the statistics, probability, base_failed and kept. Any columns of these names are replaced.

    base_failed: fewer than 10 words, or over 20 % of the words in repeated windows; so empty and null texts fail.
    kept: not base_failed, and a probability of at least ``keep_from``.
    """
    out = docs.withColumn("_rated", rated(model, F.col(text_col)))
    for c in SCHEMA.split(", "):
        out = out.withColumn(c.split()[0], F.col(f"_rated.{c.split()[0]}"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.drop("_rated").withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("probability") >= keep_from))


def trained(spark: SparkSession, sf_dir: str) -> QualityModel:
    return train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_quality(docs, trained(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"
    )
