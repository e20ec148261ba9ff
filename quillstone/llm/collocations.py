"""Phrase collocation mining: bucket counts of the next length in each pass, bitmaps of buckets and of frequent parts, exact counts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import give_back, stored, table

#: Fixed values of the contract: what ends a piece, and what parts words inside one.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
KIND, FOLD = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
KIND[list(BLANKS)], KIND[list(BREAKS)] = 1, 2
FOLD[65:91] += 32
#: Bytes of text that a task looks at together.
BLOCK = 6 << 20
#: Buckets of one row of a bucket table.
CHUNK = 1 << 13
#: Occurrences for a bucket on average, and the least and most bits of a bucket number: 2**25 take 128 MB of a worker, 4 MB as a bitmap.
LOAD, LEAST_BITS, MOST_BITS = 25, 16, 25
P, M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
ROWS = "lang string, phrase string, n long, chunk int, counts binary"


@dataclass(frozen=True)
class Mining:
    """Phrases of 2 to ``longest`` words found ``least`` times; dropped inside a longer one with ``share`` % of their count; ``top`` of each language."""

    least: int = 100
    longest: int = 5
    share: int = 100
    top: int = 2000
    bits: int | None = None


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M
    return x ^ (x >> np.uint64(29))


def hashed(words: pa.BinaryArray) -> np.ndarray:
    """A 64-bit hash of each byte string; it only chooses buckets, no count depends on it being unique."""
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    size = np.diff(at)
    out = size.astype(np.uint64)
    if len(words) and at[-1] > at[0]:
        raw = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]].astype(np.uint64) + np.uint64(1)
        powers = np.multiply.accumulate(np.full(int(size.max()), P, np.uint64))
        raw *= powers[np.arange(len(raw)) - np.repeat(at[:-1] - at[0], size)]
        full = np.flatnonzero(size)
        out[full] += np.add.reduceat(raw, at[:-1][full] - at[0])
    return mixed(out)


class Words:
    """The words of a block of (lang, text) in order: code (into dictionary), piece, lang (into langs)."""

    def __init__(self, texts: list[tuple[str, bytes]]):
        data = np.frombuffer(b"\n".join(t for _, t in texts), np.uint8)
        kind = KIND[data]
        inside = kind == 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        first, last = edge[::2], edge[1::2]
        offsets = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int32)
        whole = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(FOLD[data[inside]])])
        coded = whole.dictionary_encode()
        self.dictionary, self.code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[first]
        begin = np.cumsum([0, *(len(t) + 1 for _, t in texts)])[:-1]
        self.langs = sorted({x for x, _ in texts})
        numbers = {x: i for i, x in enumerate(self.langs)}
        self.lang = np.array([numbers[x] for x, _ in texts], np.int64)[np.searchsorted(begin, first, side="right") - 1]

    def hashes(self, longest: int) -> list[np.ndarray]:
        """[k - 1]: the hash of the k-gram that begins at each word; those that cross a piece mean nothing."""
        words = hashed(self.dictionary)[self.code]
        out = [mixed(hashed(pa.array([x.encode() for x in self.langs], pa.binary()))[self.lang] * P + words)]
        for k in range(1, longest):
            out.append(mixed(out[-1][:-1] * P + words[k:]) if len(out[-1]) > 1 else np.empty(0, np.uint64))
        return out

    def whole(self, k: int) -> np.ndarray:
        """Whether the k-gram that begins at each word lies in one piece."""
        return self.piece[: max(0, len(self.piece) - k + 1)] == self.piece[k - 1 :] if k > 1 else np.ones(len(self.piece), bool)

    def counted(self, at: np.ndarray, k: int) -> tuple[list, pa.Array, np.ndarray]:
        """lang, phrase, count of the distinct k-grams that begin at the given words, exact."""
        key, bound, size = self.lang[at], len(self.langs), max(1, len(self.dictionary))
        for j in range(k):
            if bound > 2**62 // size:
                values, key = np.unique(key, return_inverse=True)
                bound = len(values)
            key, bound = key * size + self.code[at + j], bound * size
        _, where, count = np.unique(key, return_index=True, return_counts=True)
        at = at[where]
        parts = [self.dictionary.take(pa.array(self.code[at + j])) for j in range(k)]
        phrase = pc.binary_join_element_wise(*parts, b" ") if k > 1 else parts[0]
        return pa.array(self.langs, pa.string()).take(pa.array(self.lang[at])), phrase.cast(pa.string()), count


def cut(text: bytes, most: int):
    """The text in parts of about ``most`` bytes that end where pieces end, so that no phrase is cut."""
    at = 0
    while len(text) - at > most:
        end = max(text.rfind(bytes([b]), at, at + most) for b in BREAKS) + 1
        if not end:  # a longer piece
            later = [x for b in BREAKS if (x := text.find(bytes([b]), at + most)) >= 0]
            if not later:
                break
            end = min(later) + 1
        yield text[at:end]
        at = end
    yield text[at:]


def blocks(batches, most: int = BLOCK):
    """Lists of (lang, text) of about ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            for part in cut(text.as_py() or b"", most):
                held.append((lang, part))
                size += len(part)
                if size >= most:
                    yield held
                    held, size = [], 0
    if held:
        yield held


class Buckets:
    """Counts of a task by bucket."""

    def __init__(self, bits: int, least: int):
        self.shift, self.least, self.count = np.uint64(64 - bits), least, np.zeros(1 << bits, np.int32)

    def add(self, hashes: np.ndarray, n: int = 1) -> None:
        np.add.at(self.count, (hashes >> self.shift).astype(np.int64), n)
        np.minimum(self.count, 1 << 30, out=self.count)

    def rows(self):
        """The counts in chunks, as much of each as decides whether it reaches the least."""
        kind = np.uint8 if self.least < 256 else np.int32
        for c in range(0, len(self.count), CHUNK):
            part = self.count[c : c + CHUNK]
            if part.any():
                yield c // CHUNK, pa.compress(np.minimum(part, self.least).astype(kind).tobytes(), "zstd", asbytes=True)


def rows_of(langs, phrases, counts, chunks=(), sums=()) -> pa.RecordBatch:
    n, m = len(phrases), len(chunks)
    none = lambda size, kind: pa.nulls(size, kind)
    both = lambda a, b: pa.concat_arrays([a, b])
    return pa.RecordBatch.from_arrays([
        both(langs, none(m, pa.string())), both(phrases, none(m, pa.string())), both(pa.array(counts, pa.int64()), none(m, pa.int64())),
        both(none(n, pa.int32()), pa.array(chunks, pa.int32())), both(none(n, pa.binary()), pa.array(sums, pa.binary())),
    ], ["lang", "phrase", "n", "chunk", "counts"])


def bit(bitmap: np.ndarray, hashes: np.ndarray, shift: np.uint64) -> np.ndarray:
    at = (hashes >> shift).astype(np.int64)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def counting(k: int, bits: int, mining: Mining, sent):
    """A pass over (lang, text): exact counts of the k-grams that may be frequent, bucket counts of the next length.

    sent: the bitmaps of frequent (k-1)-grams and of the k-grams' buckets. A k-gram is counted if its bucket and both its parts are
    set; a next one goes into a bucket if both its parts were counted.
    """

    def run(batches):
        give_back()
        shift, buckets = np.uint64(64 - bits), Buckets(bits, mining.least) if k < mining.longest else None
        parts, own = [np.frombuffer(x, np.uint8) for x in sent.value] if sent else (None, None)
        for block in blocks(batches):
            words = Words(block)
            grams = words.hashes(min(k + 1, mining.longest))
            ok = words.whole(k)
            if parts is not None and len(ok):
                part = bit(parts, grams[k - 2], shift)
                ok = ok & part[:-1] & part[1:]
                ok[ok] = bit(own, grams[k - 1][ok], shift)
            if buckets and len(ok) > 1:
                buckets.add(grams[k][ok[:-1] & ok[1:] & words.whole(k + 1)])
            yield rows_of(*words.counted(np.flatnonzero(ok), k))
            del words, grams, ok
            give_back()
        if buckets:
            for chunk, sums in buckets.rows():
                yield rows_of(pa.array([], pa.string()), pa.array([], pa.string()), [], [chunk], [sums])

    return run


def bitmap(chunks: DataFrame, bits: int, least: int) -> bytes:
    """One bit for each bucket whose sum over (chunk, counts) reaches the least: 2**bits / 8 bytes whatever the input."""

    def run(batches):
        sums = {}
        kind = np.uint8 if least < 256 else np.int32
        for batch in batches:
            for c, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(pa.decompress(x, CHUNK * kind().itemsize, "zstd", asbytes=True), kind)
                sums[c] = np.minimum(sums[c] + own, least) if c in sums else own.astype(np.int32)
        packed = [np.packbits(x >= least).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], ["chunk", "bits"])

    out = np.zeros(1 << bits >> 3, np.uint8)
    for c, x in chunks.select("chunk", "counts").repartition("chunk").mapInArrow(run, "chunk int, bits binary").collect():
        out[c * CHUNK >> 3 : (c + 1) * CHUNK >> 3] = np.frombuffer(x, np.uint8)
    return out.tobytes()


def marking(k: int, bits: int, least: int):
    """Bucket rows in which the bucket of each (lang, phrase) of k words has the least count."""

    def run(batches):
        marks = Buckets(bits, least)
        for block in blocks(batches):
            words = Words(block)
            if len(words.code) >= k:
                marks.add(words.hashes(k)[k - 1][words.whole(k)], least)
        for chunk, sums in marks.rows():
            yield rows_of(pa.array([], pa.string()), pa.array([], pa.string()), [], [chunk], [sums])

    return run


def frequent(docs: DataFrame, mining: Mining = Mining(), text_col: str = "text", lang_col: str = "lang") -> tuple[list[DataFrame], DataFrame]:
    """[k - 1]: lang, phrase, f of all k-grams found at least ``least`` times, stored; and lang, n, all words of each language.

    Whole texts, A-Z lower-cased, in pieces; a null lang is ``und``, a null text empty. The buckets follow the bytes of text, up to
    2**MOST_BITS; with more text they prune less, which costs time, never counts.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bits = mining.bits
    if bits is None:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(MOST_BITS, max(LEAST_BITS, (size // (6 * LOAD)).bit_length()))
    sent, found, totals = None, [], None
    for k in range(1, mining.longest + 1):
        raw = stored(texts.mapInArrow(counting(k, bits, mining, sent), ROWS), "grams")
        counts = raw.where("phrase IS NOT NULL")
        found.append(stored(counts.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= mining.least), "frequent"))
        if k == 1:
            totals = stored(counts.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        if k < mining.longest:
            marked = bitmap(found[-1].select("lang", "phrase").mapInArrow(marking(k, bits, mining.least), ROWS), bits, mining.least)
            sent = spark.sparkContext.broadcast((marked, bitmap(raw.where("chunk IS NOT NULL"), bits, mining.least)))
    return found, totals


def collocations(docs: DataFrame, mining: Mining = Mining(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language.

    A phrase's score is that of its worst cut, floor(1000 a n / (l r)), in exact decimals; of equal cuts the first. A phrase inside a
    longer one with ``share`` % of its count is dropped: looking one word further is enough, as what lies between is as frequent as
    the longer one. Repeated rows count again; empty tables, and languages without candidates, have no rows; other columns are ignored.
    """
    found, totals = frequent(docs, mining, text_col, lang_col)
    known = reduce(DataFrame.unionByName, found[:-1])
    held = [x.withColumn("_m", F.lit(m)) for m, x in enumerate(found, 1) if m > 1]
    candidates = reduce(DataFrame.unionByName, held)
    parts = candidates.where("_m > 2").select("lang", "f", F.explode(F.expr("array(substring_index(phrase, ' ', _m - 1), substring_index(phrase, ' ', 1 - _m))")).alias("phrase"))
    longer = parts.groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(f"_longer IS NULL OR 100 * _longer < {mining.share} * f").drop("_longer")
    cuts = kept.withColumn("k", F.explode(F.expr("sequence(1, _m - 1)"))).selectExpr(
        "lang", "phrase", "f AS a", "k", "substring_index(phrase, ' ', k) AS _first", "substring_index(phrase, ' ', k - _m) AS _rest",
    )
    first = known.select("lang", F.col("phrase").alias("_first"), F.col("f").alias("l"))
    rest = known.select("lang", F.col("phrase").alias("_rest"), F.col("f").alias("r"))
    met = cuts.join(first, ["lang", "_first"]).join(rest, ["lang", "_rest"]).join(totals, "lang")
    wide = "CAST({} AS DECIMAL(19, 0))".format
    scored = met.withColumn("score", F.expr(f"({wide('a')} * {wide('n')} * 1000) div ({wide('l')} * {wide('r')})"))
    worst = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("_w"))
    rows = worst.select("lang", "phrase", "a", "_w.l", "_w.r", "n", "_w.score")
    best = [F.desc("score"), F.desc("a"), "phrase"]
    salted = rows.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = salted.withColumn("_i", F.row_number().over(W.partitionBy("lang", "_s").orderBy(*best))).where(F.col("_i") <= mining.top)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= mining.top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2000 phrases of 2 to 5 words of each language over all documents."""
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, range(1, 6) t(m) WHERE len(w) >= m),
n AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase HAVING count(*) >= 100),
x AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
inside AS (
  SELECT DISTINCT s.lang, s.phrase FROM x s JOIN x t ON s.lang = t.lang AND s.m < t.m AND 100 * t.f >= 100 * s.f AND contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' ')),
c AS (SELECT lang, m, phrase, f AS a, w, unnest(range(1, m)) AS k FROM x ANTI JOIN inside USING (lang, phrase)),
s AS (
  SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, n.n, c.k, 1000::HUGEINT * c.a * n.n // (l.f::HUGEINT * r.f) AS score
  FROM c JOIN n USING (lang) JOIN f l ON l.lang = c.lang AND l.m = c.k AND l.phrase = array_to_string(c.w[:c.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.m = c.m - c.k AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
worst AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM worst QUALIFY rank <= 2000
"""
