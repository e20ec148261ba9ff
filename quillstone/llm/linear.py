"""Hashed n-gram features and logistic regression in numpy, for the text classifiers."""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, stored

SLICE = 400_000  # characters hashed at once, so that a long text needs no more memory
UNIT = 1 << 32  # of the sums that buckets are chosen by
PIECES = 256  # in which these sums are added up
BLOCK = 1 << 22  # entries of a matrix that a step of the fit works on at once


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def char_grams(code: np.ndarray, low: int, high: int, bits: int):
    """Hash buckets of the character n-grams of each order from low to high, as one array for each order."""
    h = code
    for n in range(2, high + 1):
        if len(code) < n:
            return
        h = (h[:-1] * np.uint32(0x01000193)) ^ code[n - 1 :]
        if n >= low:
            yield ((h ^ np.uint32(n * 0x3D4D51CB & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


def sliced(text: str, high: int):
    """Pieces of a text that overlap so that each n-gram is in exactly one."""
    if len(text) <= SLICE:
        yield text, len(text)
        return
    for at in range(0, len(text), SLICE):
        yield text[at : at + SLICE + high - 1], min(SLICE, len(text) - at)


@dataclass(frozen=True)
class Model:
    """Weights of the chosen buckets; a text's logit is bias + scale * (sum of its features' weights)."""

    bucket: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int

    def table(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.bucket] = self.weight
        return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit_logistic(row: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, n_cols: int, l2: float, steps: int = 150, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Adam on the mean log loss over a sparse matrix in coordinates, classes weighted alike."""
    w, b = np.zeros(n_cols), 0.0
    m, v, mb, vb = np.zeros(n_cols), np.zeros(n_cols), 0.0, 0.0
    blocks = [slice(k, k + BLOCK) for k in range(0, max(1, len(row)), BLOCK)]
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for t in range(1, steps + 1):
        z = sum(np.bincount(row[k], weights=value[k] * w[col[k]], minlength=len(y)) for k in blocks) + b
        g = (sigmoid(z) - y) * share
        gw, gb = sum(np.bincount(col[k], weights=value[k] * g[row[k]], minlength=n_cols) for k in blocks) + l2 * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, float(b)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col="doc_id", text_col="text") -> DataFrame:
    """(_y, _text) of at most ``per_class`` labelled ids of each class, those with the smallest hashes.

    An id with several labels counts with the largest; ids or labels that are null are left out. Only ids are
    sorted; the bounded sample, not the documents, is broadcast.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IN (0, 1)")
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    chosen = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    # the limits bound this frame at 2 * per_class rows of two numbers
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(sample, "_id").select("_id", "_y", "_text")


def fitted(sample: DataFrame, features, moments: int, bits: int, choose, fit):
    """What ``fit(row, column, value, y, chosen)`` makes of the sample's features, rows in the order of ids.

    ``features(text)`` gives distinct buckets below 2**bits and their values, or None for ones. ``choose(sums, n)`` names the buckets
    to keep, from the values' sums (in UNIT, and of their squares where ``moments`` is 2) by class, moment and bucket and from the
    rows of each class. The sums are integers, so their order doesn't matter. Only chosen buckets are laid out as a matrix (column:
    place in chosen) and meet in one task: at most a number for each row and chosen bucket, however long the texts are. The driver
    gets the chosen buckets and the model.
    """
    sample = stored(sample, "sample")

    def count(batches):
        sums, n = np.zeros((2, moments, 1 << bits), np.int64), np.zeros(2, np.int64)
        for pdf in batches:
            for y, x in zip(pdf["_y"].tolist(), pdf["_text"], strict=True):
                at, value = features(x or "")
                n[y] += 1
                for m in range(moments):
                    sums[y, m, at] += UNIT if value is None else np.rint(value.astype(np.float64) ** (m + 1) * UNIT).astype(np.int64)
        parts = [(k, x.tobytes()) for k, x in enumerate(np.split(sums, PIECES, axis=2)) if x.any()]
        yield pd.DataFrame([(-1, n.tobytes()), *parts], columns=["piece", "sums"])
        give_back()

    def add(pdf):
        return pd.DataFrame({"piece": pdf["piece"][:1], "sums": [sum(np.frombuffer(x, np.int64) for x in pdf["sums"]).tobytes()]})

    def pick(batches):
        sums, n = np.zeros((2, moments, 1 << bits), np.int64), np.zeros(2, np.int64)
        parts = np.split(sums, PIECES, axis=2)  # views
        for pdf in batches:
            for k, x in zip(pdf["piece"], pdf["sums"], strict=True):
                whole = n if k < 0 else parts[k]
                whole[...] = np.frombuffer(x, np.int64).reshape(whole.shape)
        yield pd.DataFrame({"made": [np.sort(choose(sums, n)).astype("<u4").tobytes()]})

    counted = sample.mapInPandas(count, "piece int, sums binary").groupBy("piece").applyInPandas(add, "piece int, sums binary")
    chosen = np.frombuffer(in_one_task(counted, pick), "<u4").astype(np.int64)

    def extract(batches):
        place = np.full(1 << bits, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                own = pdf.iloc[at : at + 500]
                columns, values = [], []
                for x in own["_text"]:
                    b, v = features(x or "") if len(chosen) else (np.empty(0, np.int64), None)
                    b = place[b]
                    columns.append(b[b >= 0].astype("<u4").tobytes())
                    values.append(None if v is None else v[b >= 0].astype("<f4").tobytes())
                yield pd.DataFrame({"_id": own["_id"], "_y": own["_y"], "b": columns, "v": values})
        give_back()

    def learn(batches):
        rows = [r for pdf in batches for r in pdf.itertuples(index=False, name=None)]
        rows.sort(key=lambda r: (r[0], r[2]))
        y = np.array([r[1] for r in rows], np.int64)
        columns = [np.frombuffer(r[2], "<i4") for r in rows]
        row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(c) for c in columns])
        col = np.concatenate([np.empty(0, np.int32), *columns])
        value = np.concatenate([np.empty(0, np.float32), *(np.ones(len(c), np.float32) if r[3] is None else np.frombuffer(r[3], "<f4") for r, c in zip(rows, columns, strict=True))])
        del rows, columns
        yield pd.DataFrame({"made": [pickle.dumps(fit(row, col, value, y, chosen))]})
        del row, col, value
        give_back()

    return pickle.loads(in_one_task(sample.mapInPandas(extract, "_id long, _y int, b binary, v binary"), learn))


def in_one_task(rows: DataFrame, work) -> bytes:
    """The one value that ``work`` makes of all rows, which the caller keeps bounded."""
    made = rows.repartition(1).mapInPandas(work, "made binary").first()
    return bytes(made[0] if made else next(work(iter(())))["made"][0])  # without rows there may be no task


def two_classes(n) -> bool:
    """Whether each class has rows; n: how many."""
    return bool(n[0] > 0 and n[1] > 0)


def most(score: np.ndarray, n: int) -> np.ndarray:
    """The n buckets of the largest positive scores."""
    best = np.argsort(-score, kind="stable")[:n]
    return best[score[best] > 0]
