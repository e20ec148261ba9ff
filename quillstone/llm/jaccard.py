"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

The global order puts shingles of few documents first (by a count over all documents, then by hash), so a set's prefix,
of which any linked set shares a shingle, holds what is rare: a line or passage that many documents share makes no large
group. Shingles of one document alone meet nothing and are never shuffled. For the candidates the hash range is cut into fragments;
overlaps are counted for each fragment apart and summed per pair.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, stored, table

K = 5
#: Links need NEED * union <= 100 * intersection.
NEED = 80
#: Fragments in which overlaps are counted.
FRAGMENTS = 4
#: Hash buckets that say which documents can take part; bounds what is broadcast.
BUCKETS = 1 << 17
#: A chunk ends beyond this many shingles or documents: what a task holds at once.
CHUNK, CHUNK_DOCS = 2_000_000, 20_000
#: Characters for each range of the order that is counted by itself, and the most ranges (a power of two), so that a chunk's part of a range stays
#: worth a row: beyond MOST_RANGES * RANGE_CHARS characters (256 GB) ranges grow with the input, and CHUNK should too.
RANGE_CHARS, MOST_RANGES = 8_000_000, 1 << 15
#: Bytes of text whose words are hashed at once.
SLICE = 1 << 20
#: Rounds that hold each group against one hub before all remaining pairs are made.
HUB_ROUNDS = 2
BITS = ["b0", "b1", "b2", "b3"]
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_GAP = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_ODD = 0x9E3779B97F4A7C15


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class Shingler:
    """The sorted distinct 64-bit shingle hashes of texts.

    A word's hash is a polynomial of its bytes (A-Z lower-cased), from running sums over a slice of joined texts, so no
    word is touched by itself; a shingle's mixes its words' hashes.
    """

    def __init__(self, k: int = K):
        self.k = k
        byte = mixed(np.arange(1, 257, dtype=np.uint64) * _MIX[2])
        byte[65:91] = byte[97:123]
        self.byte, self.n = byte, 0

    def _powers(self, n: int) -> None:
        if n > self.n:
            back = np.uint64(pow(_ODD, -1, 1 << 64))
            self.n = max(n, SLICE)
            self.up, self.down = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(self.n - 1, x, np.uint64)))) for x in (np.uint64(_ODD), back))

    def _slice(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of ``data`` start, and their hashes."""
        code = np.frombuffer(data, np.uint8)
        self._powers(len(code) + 1)
        gap = np.concatenate(([True], _GAP[code], [True]))
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = edge[::2], edge[1::2]
        sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(self.byte[code] * self.up[: len(code)], out=sums[1:])
        return start, mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64) * _MIX[1])

    def words(self, data: bytes) -> np.ndarray:
        """The hashes of a text's words; a long text goes in pieces that end at white space."""
        if len(data) <= SLICE:
            return self._slice(data)[1]
        out, at = [], 0
        while at < len(data):
            end = at + SLICE
            while end < len(data) and not _GAP[data[end]]:
                end += 1
            out.append(self._slice(data[at:end])[1])
            at = end
        return np.concatenate(out)

    def _set(self, words: np.ndarray) -> np.ndarray:
        if not len(words):
            return words
        if len(words) < self.k:  # the whole sequence is one shingle, unlike any longer one
            return np.array([xxhash.xxh3_64_intdigest(b"%d " % len(words) + words.tobytes())], np.uint64)
        m = len(words) - self.k + 1
        out = np.zeros(m, np.uint64)
        for j in range(self.k):
            out = mixed(out * _MIX[j % 5] + words[j : m + j])
        return np.unique(out)

    def __call__(self, text: str | None) -> np.ndarray:
        return self._set(self.words((text or "").encode("utf-8", "surrogatepass")))

    def sets(self, texts: pa.Array):
        """The sets of an Arrow array of texts, one by one."""
        held: list[bytes] = []
        size = 0

        def flush():
            if len(held) == 1:
                yield self._set(self.words(held[0]))
            elif held:
                start, words = self._slice(b"\n".join(held))
                ends = np.cumsum([len(x) + 1 for x in held])
                cut = np.searchsorted(start, ends).tolist()
                for a, b in zip([0, *cut], cut, strict=False):
                    yield self._set(words[a:b])
            held.clear()

        for x in texts.cast(pa.large_binary()):
            data = x.as_buffer().to_pybytes() if x.is_valid else b""
            if size + len(data) > SLICE // 4:
                yield from flush()
                size = 0
            held.append(data)
            size += len(data) + 1
        yield from flush()


def set_key(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def packed(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers as the byte planes of their steps, compressed."""
    step = np.diff(values.astype("<u8"), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return len(values).to_bytes(4, "little") + pa.compress(step.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    plane = np.frombuffer(pa.decompress(data[4:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(plane.T).view("<u8").ravel(), dtype=np.uint64)


def prefix(n: int) -> int:
    """Of sets of n shingles in one order: the length of the prefix that shares a shingle with that of every linked set."""
    return n + (-NEED * n // 100) + 1


def keys_of(rank: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """The join keys of a set of n shingles in the global order, from the ranks and places of those that more than one document has.

    The order is (rank, place); before these stand the n - len(place) shingles of one document alone, which no other set has.
    """
    take = prefix(n) - (n - len(place))
    if take <= 0 or not len(place):
        return place[:0]
    keys = place[np.lexsort((place, rank))[:take]]
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))]


SCAN = "doc long, n long, c long, b0 long, b1 long, b2 long, b3 long, chunk long, range int, base int, data binary, often binary"


def scanned(docs: DataFrame, id_col: str, text_col: str, bits: int, range_bits: int) -> DataFrame:
    """All documents' sets, by chunks that a task reads in one go. Two kinds of rows: a document (doc, n, c, a 64-bit key of the whole set; b0..b3, 256 parities of
    how many hashes begin with each byte; data: its places in the chunk's list) and, for each range, a part of the chunk's sorted
    list of distinct shortened hashes (base: where the part begins; often: in how many different sets of the chunk)."""
    schema = pa.schema([(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]]) for x in SCAN.split(", ")])

    def frame(rows, names):
        columns = dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {}
        return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * len(rows)), f.type) for f in schema], schema=schema)

    def run(batches):
        import pyspark

        shingler, part = Shingler(), pyspark.TaskContext.get().partitionId()
        docs_of, sets, size, number = [], [], 0, 0

        def close():
            nonlocal docs_of, sets, size, number
            chunk = (part << 32) + number
            keys = [set_key(h) for h in sets]
            first = np.zeros(len(sets), bool)
            first[list({c: i for i, c in reversed(list(enumerate(keys)))}.values())] = True  # copies count once
            lens = np.array([len(h) for h in sets], np.int64)
            short = np.concatenate([np.empty(0, np.uint64), *sets]) >> np.uint64(64 - bits)
            places, at = np.unique(short, return_inverse=True)
            often = np.minimum(np.bincount(at[np.repeat(first, lens)], minlength=len(places)), 65535).astype("<u2")
            ends = np.cumsum(lens)
            rows = []
            for doc, h, c, a, b in zip(docs_of, sets, keys, (ends - lens).tolist(), ends.tolist(), strict=True):
                parity = np.packbits(np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=256) & 1).view(np.int64).tolist()
                rows.append((doc, len(h), c, *parity, chunk, packed(at[a:b])))
                if len(rows) == 2000:
                    yield frame(rows, ["doc", "n", "c", *BITS, "chunk", "data"])
                    rows = []
            yield frame(rows, ["doc", "n", "c", *BITS, "chunk", "data"])
            edge = np.searchsorted(places, np.arange(1, 1 << range_bits, dtype=np.uint64) << np.uint64(bits - range_bits)).tolist()
            rows = [(chunk, r, a, packed(places[a:b]), often[a:b].tobytes()) for r, (a, b) in enumerate(zip([0, *edge], [*edge, len(places)], strict=True)) if a < b]
            yield frame(rows, ["chunk", "range", "base", "data", "often"])
            docs_of, sets, size, number = [], [], 0, number + 1

        for batch in batches:
            for doc, h in zip(batch.column("doc").to_pylist(), shingler.sets(batch.column("text")), strict=True):
                docs_of.append(doc)
                sets.append(h)
                size += len(h)
                if size >= CHUNK or len(sets) >= CHUNK_DOCS:
                    yield from close()
        yield from close()
        give_back()

    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, SCAN)


def ranked(parts: DataFrame) -> DataFrame:
    """For each part of a chunk's list: the shingles that more than one set has, as chunk, at (their numbers in the
    chunk's list), places and ranks (by how many sets have them, four steps for each doubling)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [unpacked(x) for x in pdf["data"]]
        places, own = np.unique(np.concatenate(lists), return_inverse=True)
        often = np.zeros(len(places), np.int64)
        np.add.at(often, own, np.concatenate([np.frombuffer(x, "<u2") for x in pdf["often"]]).astype(np.int64))
        rank = np.minimum(4 * np.log2(np.maximum(often, 1)), 255).astype(np.uint8)
        rows, at = [], 0
        for chunk, base, x in zip(pdf["chunk"], pdf["base"], lists, strict=True):
            n = own[at : at + len(x)]
            shared = np.flatnonzero(often[n] > 1)
            if len(shared):
                rows.append((chunk, packed(shared + base), packed(x[shared]), rank[n[shared]].tobytes()))
            at += len(x)
        return pd.DataFrame(rows, columns=["chunk", "at", "places", "ranks"])

    return parts.groupBy("range").applyInPandas(run, "chunk long, at binary, places binary, ranks binary")


def sets_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, n, c, b0..b3 (see scanned), keys (of any two linked sets' keys one at least is the same) and alone: how many
    shingles, none in another document, stand before them in the order.

    The texts are read once. The shortened hashes' counts are exact over all documents: each chunk sends its sorted list
    in parts to the tasks that count a range, which send back what more than one set has. Two shingles may share a
    shortened hash (about one in a thousand); they count as one in the order, which the links do not depend on.
    """
    chars = max(1, docs.agg(F.sum(F.length(text_col).cast("long"))).first()[0] or 0)
    range_bits = min(max(4, math.ceil(math.log2(chars / RANGE_CHARS))), MOST_RANGES.bit_length() - 1)
    scan = stored(scanned(docs, id_col, text_col, max(32, math.ceil(math.log2(chars)) + 7), range_bits), "scan")
    back = ranked(scan.where("range IS NOT NULL").select("chunk", "range", "base", "data", "often"))
    schema = "doc long, n long, c long, b0 long, b1 long, b2 long, b3 long, alone long, keys array<long>"

    def run(own: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        at = np.concatenate([np.empty(0, np.uint64), *map(unpacked, shared["at"])])
        places = np.concatenate([np.empty(0, np.uint64), *map(unpacked, shared["places"])])
        ranks = np.concatenate([np.empty(0, np.uint8), *(np.frombuffer(x, np.uint8) for x in shared["ranks"])])
        order = np.argsort(at)
        at, places, ranks = at[order], places[order], ranks[order]
        last = int(at[-1]) + 1 if len(at) else 0
        where = np.full(last, -1, np.int32)
        where[at] = np.arange(len(at))

        def keys(data: bytes, n: int) -> tuple[int, np.ndarray]:
            x = unpacked(data)
            x = where[x[x < last]]
            x = x[x >= 0]
            return n - len(x), keys_of(ranks[x], places[x], n).view(np.int64)

        out = own[["doc", "n", "c", *BITS]].copy()
        out["alone"], out["keys"] = zip(*(keys(x, n) for x, n in zip(own["data"], own["n"], strict=True)), strict=True) if len(own) else ([], [])
        return out.astype({"doc": "Int64"})

    own = scan.where("range IS NULL").select("doc", "n", "c", *BITS, "chunk", "data")
    return own.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(run, schema)


def segments_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """c, fragment, segment (packed sorted hashes) of the classes in ``wanted`` (c, rep), made from their texts again."""

    def make(batches):
        shingler, seen = Shingler(), set()
        cuts = (np.arange(1, FRAGMENTS, dtype=np.uint64) * np.uint64(2**64 // FRAGMENTS)).astype(np.uint64)
        for pdf in batches:
            rows = []
            for c, text in zip(pdf["c"], pdf["text"], strict=True):
                if c in seen:
                    continue
                h = shingler(text)
                if set_key(h) == c:
                    seen.add(c)
                    rows += [(c, f, x.tobytes()) for f, x in enumerate(np.split(h, np.searchsorted(h, cuts))) if len(x)]
                    if len(rows) >= 4000:
                        yield pd.DataFrame(rows, columns=["c", "fragment", "segment"])
                        rows = []
            yield pd.DataFrame(rows, columns=["c", "fragment", "segment"])
        give_back()

    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    found = nearly(texts, "doc", wanted.select("rep")).join(wanted.select("c", F.col("rep").alias("doc")), "doc").select("c", "text")
    return found.mapInPandas(make, "c long, fragment int, segment binary")


def nearly(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows whose column's hash bucket one of ``wanted`` (one column) has: keeps most others out of a shuffle. Broadcasts BUCKETS rows at most."""
    bucket = lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS))
    some = F.broadcast(wanted.select(bucket(wanted.columns[0]).alias("_b")).distinct())
    return rows.withColumn("_b", bucket(column)).join(some, "_b", "left_semi").drop("_b")


def _common(x: bytes, y: bytes) -> int:
    x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    if not len(x) or not len(y):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def linked(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) whose sets reach the similarity: overlaps by fragment, summed per pair.

    A class may have a fragment's segment twice (repeated rows); the largest count of a fragment is its count.
    """

    @F.pandas_udf("long")
    def overlap(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([_common(x, y) for x, y in zip(one, two, strict=True)], dtype="int64")

    side = lambda c: nearly(segments, "c", pairs.select(c)).select(F.col("c").alias(c), "fragment", F.col("segment").alias("s" + c))
    both = pairs.join(side("a"), "a").join(side("b"), ["b", "fragment"])
    each = both.select(*pairs.columns, "fragment", overlap("sa", "sb").alias("o")).groupBy(*pairs.columns, "fragment").agg(F.max("o").alias("o"))
    total = each.groupBy(*pairs.columns).agg(F.sum("o").alias("o"))
    return total.where((100 + NEED) * F.col("o") >= NEED * (F.col("na") + F.col("nb"))).select("a", "b")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of all nodes of the edges (a, b): alternating large and small stars, in tables of the shared folder.

    root is the smallest node of the component. The steps touch edges only; a hot node is split by the adaptive join.
    """
    stars = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(low, "u")
        small = down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        stars = stored(small.where("u <> v"), name)
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _may_meet() -> Column:
    """What two linked sets fulfil at the first key that they share, before which i and hi of their shingles stand: what is left suffices."""
    return (100 + NEED) * F.least(F.col("n") - F.col("i"), F.col("hn") - F.col("hi")) >= NEED * (F.col("n") + F.col("hn"))


def _may_link() -> Column:
    """What linked classes (c) and (hc) fulfil: no more parities apart than shingles may be."""
    apart = sum(F.bit_count(F.col(x).bitwiseXOR(F.col("h" + x))) for x in BITS)
    return (100 + NEED) * apart <= (100 - NEED) * (F.col("n") + F.col("hn"))


@dataclass
class Join:
    """What the join has found: ``sets`` (doc, n, c), ``classes`` (c, n, rep, copies), ``roots`` (node, root) and ``links``
    (a, b) between classes: enough of them for the components, not all, as pairs of one component are not compared."""

    sets: DataFrame
    classes: DataFrame
    links: DataFrame | None
    roots: DataFrame | None


def _groups(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """sets (doc, n, c); classes of equal sets (c, n, parities, rep, copies); groups (key, c, n, i): the classes of each key that several
    have, with the number of their shingles that stand before it in the order; segments of the classes in groups."""
    sets = stored(sets_of(docs, id_col, text_col), "sets")
    named = sets.where("n > 0 AND doc IS NOT NULL")
    classes = stored(named.groupBy("c", "n", *BITS).agg(F.min("doc").alias("rep"), F.count("*").alias("copies")), "classes")
    one = named.where(F.size("keys") > 0).groupBy("c", "n", "alone").agg(F.first("keys").alias("keys"))  # equal sets have equal keys
    keyed = stored(one.select("c", "n", "alone", F.posexplode("keys").alias("at", "key")).select("key", "c", "n", (F.col("alone") + F.col("at")).alias("i")), "keys")
    several = keyed.groupBy("key").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).where("_lo <> _hi").select("key")
    groups = stored(keyed.join(several, "key", "left_semi"), "groups")
    members = groups.select("c").distinct().join(classes.select("c", "rep"), "c")
    return sets, classes, groups, stored(segments_of(docs, members, id_col, text_col), "segments")


def _pairs(both: DataFrame) -> DataFrame:
    """(a, b, na, nb), a < b, of rows of (c, n) and (hc, hn)."""
    first = F.col("c") < F.col("hc")
    return both.select(
        F.least("c", "hc").alias("a"), F.greatest("c", "hc").alias("b"),
        F.when(first, F.col("n")).otherwise(F.col("hn")).alias("na"), F.when(first, F.col("hn")).otherwise(F.col("n")).alias("nb"),
    ).distinct()


def join_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Join:
    sets, classes, groups, segments = _groups(docs, id_col, text_col)
    traits = classes.select("c", "n", *BITS)
    links = roots = tried = None
    for turn in range(HUB_ROUNDS + 1):
        root_of = lambda rows, c, name: (
            rows.withColumn(name, F.col(c)) if roots is None
            else rows.join(roots.select(F.col("node").alias(c), F.col("root").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))
        )
        at = root_of(groups, "c", "root")
        # groups whose classes are not all in one component yet, with the hub of this turn: first that with the fewest rare shingles, then any
        first = [F.col("i")] if turn == 0 else []
        hub = F.min(F.struct(*first, F.col("c").bitwiseXOR(F.lit(0x1F3D5B79A2C4E608 * (turn + 1) % 2**63)).alias("_o"), F.col("c").alias("hc"), F.col("n").alias("hn"), F.col("i").alias("hi")))
        split = at.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), hub.alias("_h")).where("_lo <> _hi").select("key", "_h.hc", "_h.hn", "_h.hi")
        if turn < HUB_ROUNDS:
            met = at.join(split, "key").where((F.col("c") != F.col("hc")) & _may_meet()).select("c", "hc", "root").distinct()
            hub_traits = traits.select(*[F.col(x).alias("h" + x) for x in traits.columns])
            both = root_of(met, "hc", "hroot").where("root <> hroot").join(traits, "c").join(hub_traits, "hc").where(_may_link())
        else:  # exact for the rest: pairs of different components within a group
            both = _within(at.join(split.select("key"), "key", "left_semi"), traits)
        pairs = _pairs(both)
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            if turn < HUB_ROUNDS:
                continue
            break
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = stored(linked(pairs, segments), "links")
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            roots = components(links, "stars")
    return Join(sets, classes, links, roots)


def _within(left: DataFrame, traits: DataFrame) -> DataFrame:
    """Pairs of rows (key, c, n, i, root) of a group that have different roots and may link."""
    left = left.join(traits.drop("n"), "c")
    right = left.select("key", F.col("root").alias("hroot"), *[F.col(x).alias("h" + x) for x in ("c", "n", "i", *BITS)])
    return left.join(right, (left["key"] == right["key"]) & (F.col("root") < F.col("hroot")) & _may_meet() & _may_link())


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links: (a, b), ids of one document each of two linked classes of equal sets, a < b, and (id, class): the class, by its smallest
    document's id, of every document row; null for an empty set or a null id. The result grows with the links."""
    sets, classes, groups, segments = _groups(docs, id_col, text_col)
    links = linked(stored(_pairs(_within(groups.withColumn("root", F.col("c")), classes.select("c", "n", *BITS))), "pairs"), segments)
    rep = lambda x: classes.select(F.col("c").alias(x), F.col("rep").alias("r" + x))
    pairs = links.join(rep("a"), "a").join(rep("b"), "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
    return pairs, sets.join(classes.select("c", "rep"), "c", "left").select(F.col("doc").alias(id_col), F.when(F.col("doc").isNotNull(), F.col("rep")).alias("class"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n_shingles, component_id) for each document row.

    A set: distinct 5-word shingles of ``[^\\x20\\x09-\\x0D]+`` words, A-Z lower-cased, each known by a 64-bit hash; with
    fewer words the whole sequence as one; empty for null, empty and blank texts, which link with nothing and are
    their own component. Linked: 100 * intersection >= 80 * union. component_id: the smallest id reachable by links.
    Rows with equal sets are one class and linked; repeated rows so share a component. A row with a null id links
    with nothing (null component). Extra columns are ignored.

    Work: sets once from the texts, shingles counted, copies collapsed to classes, the keys of each set's prefix
    grouped, each group held against a hub, components contracted, and only pairs of different components
    that are left made in full; texts of classes in such groups are read once more for their segments.
    """
    return _components(join_classes(docs, id_col, text_col)).select(F.col("doc").alias(id_col), "n_shingles", "component_id")


def _components(j: Join) -> DataFrame:
    """doc, n_shingles, c, component_id, root of each document row; c and root are null for an empty set."""
    if j.roots is None:
        named = j.classes.select("c", F.col("rep").alias("component"), F.col("c").alias("root"))
    else:
        own = j.classes.join(j.roots, j.classes["c"] == j.roots["node"], "left").select("c", "rep", F.coalesce("root", "c").alias("root"))
        least = own.groupBy("root").agg(F.min("rep").alias("component"))
        named = own.join(least, "root").select("c", "component", "root")
    return j.sets.select("doc", "n", F.when(F.col("n") > 0, F.col("c")).alias("c")).join(named, "c", "left").select(
        "doc", F.col("n").alias("n_shingles"), "c", "root",
        F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component_id"),
    )


def keyed_by_set(docs: DataFrame, text_col: str) -> DataFrame:
    """The rows with _c, the key of their text's set as in sets_of; null for an empty set."""

    @F.pandas_udf("long")
    def key(texts: pd.Series) -> pd.Series:
        shingler = Shingler()
        sets = (shingler(x) for x in texts)
        return pd.Series([set_key(h) if len(h) else None for h in sets], dtype="Int64")

    return docs.withColumn("_c", key(F.coalesce(text_col, F.lit(""))))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, that are their component's first by id; rows with a null id stay.

    Of rows that share an id, those with equal or linked sets are one document, of which one row stays, and unlinked
    ones are documents of their own. Only rows of ids with unlike sets have their sets made once more to tell which is which.
    """
    found = _components(join_classes(docs, id_col, text_col)).where("doc IS NOT NULL")
    # a component's smallest id may also be that of a row elsewhere: the survivor is a pair of id and set
    least = found.where("root IS NOT NULL AND doc = component_id").groupBy("root").agg(F.min(F.struct("doc", "c")).alias("_s")).select("_s.doc", "_s.c")
    empty = found.where("root IS NULL").select("doc", "c").distinct()
    keep = stored(least.unionByName(empty), "kept")
    unlike = stored(found.groupBy("doc").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi"), F.count("*").alias("_n"), F.count("c").alias("_m")).where("_lo <> _hi OR _m > 0 AND _m < _n").select(F.col("doc").alias("_doc")), "unlike")
    named = docs.where(F.col(id_col).isNotNull()).join(keep.select(F.col("doc").alias("_kept")).distinct(), F.col(id_col) == F.col("_kept"), "left_semi")
    whole = named.join(unlike, F.col(id_col) == F.col("_doc"), "left_anti").dropDuplicates([id_col])
    if not unlike.isEmpty():
        rows = keyed_by_set(named.join(unlike, F.col(id_col) == F.col("_doc"), "left_semi"), text_col)
        kept = keep.select(F.col("doc").alias("_kept"), F.col("c").alias("_set"))
        own = rows.join(kept, (F.col(id_col) == F.col("_kept")) & F.col("_c").eqNullSafe(F.col("_set")), "left_semi")
        whole = whole.unionByName(own.dropDuplicates([id_col, "_c"]).drop("_c"))
    return whole.unionByName(docs.where(F.col(id_col).isNull()))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
