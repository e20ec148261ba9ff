"""Pattern entities, their clean surfaces, and their counts over texts and chunks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.slices import in_slices, rows_of
from ..functions.text import SPACE, col, trimmed

# The patterns that define the entity types. Word borders are ASCII's.
_LEFT, _RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_SHORT = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_LONG = "January|February|March|April|May|June|July|August|September|October|November|December"
PATTERNS = {
    "AMOUNT": rf"(?:₹|{_LEFT}Rs\.?\s|{_LEFT}USD\s|\$)\s?[0-9,]+(?:\.[0-9]{{1,2}})?(?:\s?(?:lakh|crore|million|billion))?",
    "DATE": rf"{_LEFT}[0-9]{{1,2}}\s(?:{_SHORT})[a-z]*\s[0-9]{{4}}{_RIGHT}|{_LEFT}(?:{_LONG})\s[0-9]{{1,2}},?\s[0-9]{{4}}{_RIGHT}|{_LEFT}[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{_RIGHT}",
    "EMAIL": rf"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]*[A-Za-z0-9_]{_RIGHT}",
    "ID": rf"{_LEFT}(?:[A-Z]{{3,}}[0-9][A-Za-z0-9_-]{{3,}}[A-Za-z0-9_]{_RIGHT}|(?:setl|rfnd|pay|evt|ord)_[A-Za-z0-9]{{6,}}{_RIGHT})",
}


#: What a text must hold for a pattern to match at all: found far faster than the pattern is tried at every place.
NEEDS = {"AMOUNT": r"[₹$]|Rs|USD", "DATE": r"[0-9]{4}", "EMAIL": "@", "ID": r"[A-Z]{3}[0-9]|_[A-Za-z0-9]{6}"}


def sanitize(surface: Column | str) -> Column:
    """No space before punctuation, no punctuation at the ends unless it holds a currency mark, single spaces; null if fewer
    than three letters or digits are left and no currency mark is."""
    s = F.regexp_replace(col(surface), rf"{SPACE}+([.,;:!?'])", "$1")
    edge = rf"(?:{SPACE}|\p{{P}})"
    # a run of punctuation and space at an end goes whole unless $ stands in it (₹ and $ are symbols, not punctuation, so end a run)
    s = F.regexp_replace(s, rf"\A{edge}+|{edge}+\z", "")
    s = trimmed(F.regexp_replace(s, rf"{SPACE}{{2,}}", " "))
    solid = F.length(F.regexp_replace(s, r"[^\p{L}\p{N}]", ""))
    return F.when((solid >= 3) | s.rlike(rf"[₹$]|{_LEFT}Rs{_RIGHT}"), s)


def pattern_entities(chunks: DataFrame, key_cols: list[str], text_col: str = "text") -> DataFrame:
    """key columns, type, surface, ord (place of the type, then of the match) for each match; each type matches on its own."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def matches(place: int, kind: str) -> Column:
        one = lambda s, i: F.struct(F.lit(kind).alias("type"), trimmed(s).alias("surface"), (F.lit(place * 1_000_000) + i).alias("ord"))
        found = F.when(text.rlike(NEEDS[kind]), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(F.expr("CAST(array() AS array<string>)"))
        return F.transform(found, one)

    found = [matches(k, t) for k, t in enumerate(PATTERNS)]
    return chunks.select(*key_cols, F.explode(F.concat(*found)).alias("e")).select(*key_cols, "e.type", "e.surface", "e.ord")


def extract_entities(chunks: DataFrame, key_cols: list[str], text_col: str = "text", classifier=None) -> DataFrame:
    """Pattern entities and, where a token classifier is given, (frame of key columns, type, surface, ord) of its own."""
    found = pattern_entities(chunks, key_cols, text_col)
    return found if classifier is None else found.unionByName(classifier(chunks))


def aggregate_entities(found: DataFrame, key_cols: list[str]) -> DataFrame:
    """Per text: entity key `TYPE:lower`, type, the first surface, count, ord of the first."""
    clean = found.withColumn("surface", sanitize("surface")).where("surface IS NOT NULL")
    named = clean.withColumn("entity", F.concat("type", F.lit(":"), F.lower("surface")))
    return named.groupBy(*key_cols, "entity", "type").agg(F.min_by("surface", "ord").alias("surface"), F.count("*").alias("count"), F.min("ord").alias("ord"))


def merge_entities(per_chunk: DataFrame, chunk_col="key", doc_col="doc_id", order_col="chunk_ord") -> DataFrame:
    """Over all chunks: count, sorted docs and chunk keys, the first surface, first_ord (of chunk, then within it)."""
    first = F.struct(order_col, "ord")
    return per_chunk.groupBy("entity", "type").agg(
        F.min_by("surface", first).alias("surface"), F.sum("count").alias("count"), F.sort_array(F.collect_set(doc_col)).alias("docs"),
        F.sort_array(F.collect_set(chunk_col)).alias("chunk_keys"), F.min(first).alias("first_ord"),
    )


def count_entities(per_chunk: DataFrame, chunk_col="key", doc_col="doc_id", order_col="chunk_ord") -> DataFrame:
    """merge_entities with the numbers of documents and chunks in place of their arrays: docs and chunks. No row grows with the table."""
    first = F.struct(order_col, "ord")
    return per_chunk.groupBy("entity", "type").agg(
        F.min_by("surface", first).alias("surface"), F.sum("count").alias("count"), F.count_distinct(doc_col).alias("docs"), F.count_distinct(chunk_col).alias("chunks"), F.min(first).alias("first_ord")
    )


def members(per_chunk: DataFrame, top: DataFrame, chunk_col="key", doc_col="doc_id") -> DataFrame:
    """entity, count, first_ord, doc, chunk: a row for each chunk that holds one of the given entities, a report's few."""
    few = top.select("entity", "type", F.col("count").alias("_count"), F.col("first_ord").alias("_first"))
    met = per_chunk.join(few, ["entity", "type"])
    return met.select("entity", F.col("_count").alias("count"), F.col("_first").alias("first_ord"), F.col(doc_col).alias("doc"), F.col(chunk_col).alias("chunk")).distinct()


def entities_per_doc(per_chunk: DataFrame, doc_col="doc_id") -> DataFrame:
    """How many entities a document's chunks hold, each chunk's distinct ones counted."""
    return per_chunk.groupBy(doc_col).agg(F.count("*").alias("entities"))


def join_pieces(pieces: list[str]) -> str:
    """Word pieces joined, continuations without a space, the first letter of each word raised."""
    import re

    text = "".join(p[2:] if p.startswith("##") else (" " if k else "") + p for k, p in enumerate(pieces)).strip()
    return re.sub(r"\b[a-z]", lambda m: m[0].upper(), text, flags=re.A)


def decode_tags(tokens: list[str], labels: list[str], probs: list[float], mask: list[int], min_score: float = 0.6) -> list[tuple[str, str]]:
    """(type, surface) of the entities in a tagged token sequence.

    Reading stops where the mask is 0; bracketed tokens are passed over. Continuation pieces follow an open entity whatever their
    tag; any other token that is outside or scores below ``min_score`` closes it; B, or another type, opens the next.
    """
    out: list[tuple[str, str]] = []
    kind, held = None, []

    def close():
        nonlocal kind, held
        if held and len(surface := join_pieces(held)) > 1:
            out.append((kind, surface))
        kind, held = None, []

    for token, label, p, on in zip(tokens, labels, probs, mask, strict=True):
        if not on:
            break
        if token.startswith("["):
            continue
        follows = token.startswith("##") and kind is not None
        if label == "O" or p < min_score:
            held.append(token) if follows else close()
            continue
        begin, _, tagged = label.partition("-")
        if follows or (begin != "B" and kind == tagged):
            held.append(token)
        else:
            close()
            kind, held = tagged, [token]
    close()
    return out


def decode_logits(tokens: list[str], logits: list, mask: list[int], labels: list[str], min_score: float = 0.6) -> list[tuple[str, str]]:
    """decode_tags of the best label of each row of logits and its softmax."""
    if not len(tokens):
        return []
    z = np.asarray([np.asarray(r, float) for r in logits])
    e = np.exp(z - z.max(axis=1, keepdims=True))
    best = z.argmax(axis=1)
    p = e[np.arange(len(z)), best] / e.sum(axis=1)
    return decode_tags(list(tokens), [labels[b] for b in best], p.tolist(), list(mask), min_score)


#: What a decoded row gives for each of its entities; words of the rows that are decoded at once.
_FOUND, _WORDS = pa.struct([("type", pa.string()), ("surface", pa.string()), ("ord", pa.int64())]), 1 << 16


def _entity_rows(rows: DataFrame, key_cols: list[str], work: Callable, by: str, most: int) -> DataFrame:
    keys = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*key_cols).schema]
    return rows.mapInArrow(in_slices(work, by, most=most), ", ".join([*keys, "type string, surface string, ord long"]))


def _numbered(found: list[tuple[str, str]]) -> list[dict]:
    return [{"type": k, "surface": s, "ord": len(PATTERNS) * 1_000_000 + i} for i, (k, s) in enumerate(found)]


def tagged_entities(rows: DataFrame, key_cols: list[str], labels: list[str], min_score: float = 0.6) -> DataFrame:
    """key columns, type, surface, ord of rows that hold a classifier's arrays: tokens, logits (an array for each token), mask."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        each = zip(*[batch.column(c).to_pylist() for c in ("tokens", "logits", "mask")], strict=True)
        return rows_of(batch, key_cols, [_numbered(decode_logits(t, z, m, labels, min_score)) if t is not None else [] for t, z, m in each], _FOUND)

    return _entity_rows(rows.select(*key_cols, "tokens", "logits", "mask"), key_cols, work, "tokens", _WORDS)


def token_classifier(model: Callable, labels: list[str], key_cols: list[str], text_col: str = "text", min_score: float = 0.6) -> Callable[[DataFrame], DataFrame]:
    """A classifier for extract_entities. ``model(texts) -> rows of (tokens, logits, mask)`` runs on slices of Arrow batches, and its
    logits are decoded where they are made: none are kept past their slice. Its entities come after the patterns'."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        tagged = model([x or "" for x in batch.column("_text").to_pylist()])
        return rows_of(batch, key_cols, [_numbered(decode_logits(t, z, m, labels, min_score)) for t, z, m in tagged], _FOUND)

    return lambda chunks: _entity_rows(chunks.select(*key_cols, F.col(text_col).alias("_text")), key_cols, work, "_text", 4 * _WORDS)
