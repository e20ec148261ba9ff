"""Embedders, scorers and generators as plug-ins, and what stands in where none is there."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.slices import cuts, in_slices, sizes
from ..functions.text import tokenize


class Embedder(Protocol):
    name: str
    dims: int

    def start(self) -> None:
        """Raises where the model is missing."""

    def embed(self, rows: DataFrame, text_col: str, out: str = "embedding") -> DataFrame: ...


FNV_START, FNV_PRIME, FNV_MASK = 2166136261, np.uint64(16777619), np.uint64(0xFFFFFFFF)


def fnv_over(state: np.ndarray, word: np.ndarray, at: np.ndarray, size: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """The FNV-1a states after the characters of each state's word; a step takes one character of all words that are that long."""
    order = np.argsort(-size[word], kind="stable")
    state, first, left = state[order], at[word][order], size[word][order]
    for j in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -j, side="left"))  # longer than j
        state[:n] = ((state[:n] ^ chars[first[:n] + j]) * FNV_PRIME) & FNV_MASK
    out = np.empty_like(state)
    out[order] = state
    return out


def hashed_weights(tokens: pa.ListArray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, bucket, weight of a sparse matrix: words weigh 1 and pairs of neighbours 0.5 in the bucket of their FNV-1a hash."""
    size = np.asarray(tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    coded = tokens.flatten().dictionary_encode()
    words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    long = np.array([len(w) for w in words], np.int64)
    at = np.concatenate([[0], np.cumsum(long)])[:-1].astype(np.int64)
    one = fnv_over(np.full(len(words), FNV_START, np.uint64), np.arange(len(words)), at, long, chars)
    row = np.repeat(np.arange(len(size)), size)
    pair = np.flatnonzero(row[:-1] == row[1:])
    begun = ((one[code[pair]] ^ np.uint64(ord("_"))) * FNV_PRIME) & FNV_MASK
    two = fnv_over(begun, code[pair + 1], at, long, chars)
    buckets = np.concatenate([one[code], two]) % np.uint64(dims)
    cells = np.concatenate([row, row[pair]]) * dims + buckets.astype(np.int64)
    cell, place = np.unique(cells, return_inverse=True)
    weight = np.bincount(place, weights=np.repeat([1.0, 0.5], [len(code), len(pair)]), minlength=len(cell))
    return cell // dims, cell % dims, weight


#: Words that are hashed at once: the arrays made of them are several times their size.
WORDS = 1 << 17


class HashEmbedder:
    """The lexical embedding, always there; numpy over slices of Arrow batches, each distinct word of a slice hashed once."""

    name = "lexical-hash"

    def __init__(self, dims: int = 512):
        self.dims = dims

    def start(self) -> None:
        pass

    def embed(self, rows: DataFrame, text_col: str, out: str = "embedding") -> DataFrame:
        """rows with an embedding of unit length; that of a text without words is zero."""
        dims = self.dims

        def dense_rows(tokens: pa.Array) -> pa.Array:
            row, bucket, weight = hashed_weights(tokens, dims)
            norm = np.sqrt(np.bincount(row, weights=weight**2, minlength=len(tokens)))
            dense = np.zeros((len(tokens), dims), np.float32)
            dense[row, bucket] = weight / norm[row]
            return pa.ListArray.from_arrays(np.arange(0, dense.size + 1, dims, dtype=np.int32), pa.array(dense.ravel()))

        @F.arrow_udf("array<float>")
        def run(tokens: pa.Array) -> pa.Array:
            parts = [dense_rows(tokens.slice(at, end - at)) for at, end in cuts(sizes(tokens), most=WORDS)]
            return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))

        return rows.withColumn(out, run(tokenize(F.coalesce(F.col(text_col), F.lit("")))))

    def sparse(self, rows: DataFrame, key_col: str, text_col: str) -> DataFrame:
        """key, bucket, weight of the embedding before it is brought to unit length; a text's buckets are added up where it lies."""
        dims = self.dims

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, bucket, weight = hashed_weights(batch.column("_w"), dims)
            return pa.RecordBatch.from_arrays([batch.column("_k").take(pa.array(row)), pa.array(bucket), pa.array(weight)], names=[key_col, "bucket", "weight"])

        words = rows.select(F.col(key_col).alias("_k"), tokenize(F.coalesce(F.col(text_col), F.lit(""))).alias("_w"))
        return words.mapInArrow(in_slices(work, "_w", most=WORDS), f"`{key_col}` {words.schema['_k'].dataType.simpleString()}, bucket long, weight double")


def resolve_embedder(chain: list) -> tuple[object, list[dict]]:
    """The first embedder that starts, and what became of those tried: name, ok, error."""
    attempts = []
    for candidate in chain:
        try:
            candidate.start()
        except Exception as e:  # a plug-in may fail in any way; the reason is kept
            attempts.append({"name": candidate.name, "ok": False, "error": str(e)})
            continue
        attempts.append({"name": candidate.name, "ok": True, "error": None})
        return candidate, attempts
    raise RuntimeError(f"no embedder starts: {attempts}")


PairScorer = Callable[[list], list]
TokenClassifier = Callable[[DataFrame], DataFrame]


class Extractive:
    """Stands in for a text generator and is none: the first sentence of each passage with its mark."""

    name, degraded = "extractive", True

    def answer(self, passages: Column) -> Column:
        sentence = lambda p, i: F.concat(F.regexp_extract(p["text"], r"(?s)\A\s*(.*?[.!?])(?:\s|\z)", 1), F.lit(" ["), (i + 1).cast("string"), F.lit("]"))
        return F.array_join(F.transform(passages, sentence), " ")
