"""Best-fit packing: a configuration linear program over the length histogram, solved by multiplicative weights with
knapsack dynamic-programming pricing to a measured gap, then rounded; the rest is placed by best fit."""

from __future__ import annotations

import math
import struct
import zlib
from bisect import bisect_left, insort
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import give_back, stored, table
from .tokens import Encoder, tokenizer_path

CAPACITY = 4096
#: Rounds of pricing at most and the gap between value and bound that ends them; the first round's share of what a configuration's scarcest length
#: needs, and the rounds in which this falls to a half; how fast weights fall, and by what power lengths may be ahead that are priced.
ROUNDS, GAP, STEP, SLOW, RATE, WINDOW = 200, 0.05, 0.5, 10, 4.0, 1.0
#: Lengths priced together, and how near to the best a round's configurations are.
GROUP, NEAR = 24, 0.2
#: The part of a sequence that configurations leave empty at most, where there are such; short pieces fill it by best fit.
WASTE = 0.02
#: The share of the tokens that best fit places: lengths in about their first proportions, so that it wastes little.
REST = 0.2
#: Pieces of one length that are numbered in one task.
NUMBERED = 100_000


class Plan(NamedTuple):
    """Sequence kinds, the least number of sequences by the program's bound, and the share of the tokens (full pieces apart) that the program places."""

    kinds: list[tuple[int, list[tuple[int, int]]]]
    bound: int
    programmed: float


def best_worth(worth: np.ndarray, lengths: np.ndarray, capacity: int) -> float:
    """The largest worth of any configuration: the knapsack program over all lengths, any number of copies, each step over all lengths at once."""
    order = np.argsort(lengths)
    size, gain = lengths[order], worth[order]
    best = np.zeros(capacity + 1)
    upto = np.searchsorted(size, np.arange(capacity + 1), side="right")
    for c in range(int(size[0]), capacity + 1):
        best[c] = max(best[c - 1], (best[c - size[: upto[c]]] + gain[: upto[c]]).max())
    return float(best[capacity])


def price(worth: np.ndarray, lengths: np.ndarray, most: np.ndarray, capacity: int) -> tuple[dict[int, int], float]:
    """The configuration of the largest worth within the capacity (index of length -> copies, ``most`` at most), and its worth: a
    knapsack dynamic program, whose items are 1, 2, 4, ... copies of a length."""
    best, items = np.zeros(capacity + 1), []
    for i, (length, gain, n) in enumerate(zip(lengths.tolist(), worth.tolist(), most.tolist(), strict=True)):
        n, copies = min(n, capacity // length), 1
        while n > 0:
            copies = min(copies, n)
            size = copies * length
            found = best[: capacity + 1 - size] + copies * gain
            better = found > best[size:]
            best[size:][better] = found[better]
            items.append((i, copies, size, better))
            n -= copies
            copies *= 2
    out: dict[int, int] = {}
    c = capacity
    for i, copies, size, better in reversed(items):
        if c >= size and better[c - size]:
            out[i] = out.get(i, 0) + copies
            c -= size
    return out, float(best[capacity])


def priced(worth: np.ndarray, lengths: np.ndarray, most: np.ndarray, capacity: int, rng: np.random.Generator) -> list[dict[int, int]]:
    """Configurations of different lengths: the lengths are dealt into groups at random, each group is priced, and those nearly as good as the best are returned."""
    order = rng.permutation(len(lengths))
    found = []
    for at in range(0, len(order), GROUP):
        own = order[at : at + GROUP]
        config, value = price(worth[own], lengths[own], most[own], capacity)
        found.append(({int(own[i]): n for i, n in config.items()}, value))
    least = (1 - NEAR) * max(value for _, value in found)
    good = [config for config, value in found if value >= least]
    return [x for x in good if sum(n * int(lengths[i]) for i, n in x.items()) >= (1 - WASTE) * capacity] or good


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, gap: float = GAP) -> tuple[list[tuple[dict[int, int], float]], float, float]:
    """The covering program min sum(x), every length covered ``counts`` times, by multiplicative weights: configurations (index of length
    -> copies) with their fractional uses, the program's value so scaled that all is covered, and a bound that no packing is below.

    Each round prices configurations of different lengths, of those that lag, under the weights, uses each for a share (STEP, less in later
    rounds) of its scarcest length's count, and lowers the weights of what is covered. Weights over the best worth of any configuration solve the dual
    program, so what they are worth in all bounds the value from below. The rounds end when the two are ``gap`` apart, or after ``rounds``.
    """
    rng = np.random.default_rng(0)
    need, most = counts.astype(np.float64), np.minimum(counts, capacity)
    covered, used, value, total = np.zeros(len(lengths)), [], np.inf, 0.0
    bound = float(need @ lengths) / best_worth(lengths.astype(np.float64), lengths, capacity)  # at the weights of the beginning
    for turn in range(rounds):
        ahead = covered - covered.min()
        weight = np.exp(-RATE * ahead) * lengths
        lag = np.flatnonzero(ahead <= max(WINDOW / RATE, np.partition(ahead, min(GROUP, len(ahead)) - 1)[min(GROUP, len(ahead)) - 1]))
        for chosen in priced(weight[lag], lengths[lag], most[lag], capacity, rng):
            config = {int(lag[i]): n for i, n in chosen.items()}
            x = STEP / (1 + turn / SLOW) * min(need[i] / n for i, n in config.items())
            used.append((config, x))
            total += x
            for i, n in config.items():
                covered[i] += n * x / need[i]
        if covered.min() > 0:
            value = total / covered.min()
            if value <= (1 + gap) * bound:
                break
    weight = np.exp(-RATE * (covered - covered.min())) * lengths
    return used, value, max(bound, float(need @ weight) / best_worth(weight, lengths, capacity))


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int) -> tuple[list[tuple[dict[int, int], int]], float, float]:
    """Configurations and how often to use each: the fractional program, rounded; its value and bound.

    Uses are scaled so that no length is covered too often and cut to whole ones; then configurations whose pieces are all there are
    used once more, those with the largest parts cut off first; what is then left is priced again in whole uses. REST of the tokens stay.
    """
    used, value, bound = fractional(lengths, counts, capacity, rounds)
    left = counts.astype(np.int64)
    covered = np.zeros(len(lengths))
    for config, x in used:
        for i, n in config.items():
            covered[i] += n * x / counts[i]
    out = []

    def use(config: dict[int, int], times: int) -> None:
        times = min(times, *(int(left[i]) // n for i, n in config.items()))
        if times > 0:
            out.append((config, times))
            for i, n in config.items():
                left[i] -= n * times

    tokens, rng = int(counts @ lengths), np.random.default_rng(1)
    scaled = [(config, x / max(covered.max(), 1e-9)) for config, x in used]
    for config, x in scaled:
        use(config, int(x))
    for config, _ in sorted(scaled, key=lambda u: int(u[1]) - u[1]):
        if int(left @ lengths) <= REST * tokens:
            break
        use(config, 1)
    while int(left @ lengths) > REST * tokens:
        live = np.flatnonzero(left)
        weight = np.exp(RATE * (left[live] / counts[live] - 1)) * lengths[live]
        for config in priced(weight, lengths[live], np.minimum(left[live], capacity), capacity, rng):
            use({int(live[i]): n for i, n in config.items()}, max(1, int(min(left[live[i]] / n for i, n in config.items()) / 2)))
    return out, value, bound


def best_fit(rest: dict[int, int], capacity: int, opened: dict[tuple[tuple[int, int], ...], int]) -> dict[tuple[tuple[int, int], ...], int]:
    """Places the rest (length -> count), longest first, each into the fullest sequence that holds it: kinds of sequences ((length,
    copies), ...) and how many of each, those ``opened`` before among them. Like sequences are placed at once, so the work grows with the kinds, not the pieces."""
    begun: dict[int, dict[tuple, int]] = {capacity: {}}  # free -> kind -> how many
    for kind, n in opened.items():
        begun.setdefault(capacity - sum(x * m for x, m in kind), {})[kind] = n
    order = sorted(begun)[:-1]  # the free sizes of begun sequences, ascending
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            k = bisect_left(order, length)
            free = order[k] if k < len(order) else capacity
            each = free // length
            kind, there = next(iter(begun[free].items())) if k < len(order) else ((), n)
            copies = each if n >= each else n
            times = min(there, n // copies)
            n -= times * copies
            if k < len(order):
                if there > times:
                    begun[free][kind] = there - times
                else:
                    del begun[free][kind]
                    if not begun[free]:
                        del begun[free], order[k]
            rest_of = free - copies * length
            if rest_of not in begun:
                begun[rest_of] = {}
                insort(order, rest_of)
            grown = (*kind, (length, copies))
            begun[rest_of][grown] = begun[rest_of].get(grown, 0) + times
    return {kind: n for kinds in begun.values() for kind, n in kinds.items()}


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Plan:
    """Sequence kinds (how many, [(length, copies), ...] in place order) that hold each length exactly as often as it occurs."""
    full = histogram.get(capacity, 0)
    histogram = {x: n for x, n in histogram.items() if x < capacity and n}
    kinds = [(full, [(capacity, 1)])] if full else []
    if not histogram:
        return Plan(kinds, full, 1.0)
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    left = counts.copy()
    found, _, bound = solve(lengths, counts, capacity, rounds)
    opened: dict[tuple, int] = {}
    for chosen, times in found:
        kind = tuple(sorted(((int(lengths[i]), n) for i, n in chosen.items()), reverse=True))
        opened[kind] = opened.get(kind, 0) + times
        for i, n in chosen.items():
            left[i] -= n * times
    rest = {int(x): int(n) for x, n in zip(lengths, left, strict=True) if n}
    kinds += [(n, list(kind)) for kind, n in best_fit(rest, capacity, opened).items()]
    return Plan(kinds, full + math.ceil(bound - 1e-6), 1 - float(left @ lengths) / float(counts @ lengths))


def slots(kinds: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple]:
    """length -> (first number, sequence of its first kind, copies, offset) as arrays, one entry for each kind that holds the length."""
    seen: dict[int, int] = {}
    out: dict[int, list] = {}
    sequence = 0
    for times, kind in kinds:
        offset = 0
        for length, copies in kind:
            out.setdefault(length, []).append((seen.get(length, 0), sequence, copies, offset))
            seen[length] = seen.get(length, 0) + times * copies
            offset += length * copies
        sequence += times
    return {x: tuple(np.array(v, np.int64).T) for x, v in out.items()}


def numbered(pieces: DataFrame, order: list[str]) -> DataFrame:
    """``pieces`` with _k, a number from 0 for each piece among those of its length.

    A length is dealt over as many salts as NUMBERED makes of its count, so a hot length is many tasks; the
    salts' counts, one row each, say where each begins.
    """
    often = pieces.groupBy("length").agg(F.count("*").alias("_n"))  # a row for each length: CAPACITY at most
    salted = pieces.join(F.broadcast(often), "length").withColumn("_s", F.pmod(F.xxhash64(*order), F.ceil(F.col("_n") / NUMBERED).cast("long"))).drop("_n")
    begins = salted.groupBy("length", "_s").agg(F.count("*").alias("_n")).withColumn(
        "_from", F.coalesce(F.sum("_n").over(W.partitionBy("length").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).drop("_n")
    own = salted.withColumn("_i", F.row_number().over(W.partitionBy("length", "_s").orderBy(*order)) - 1)
    return own.join(begins, ["length", "_s"]).withColumn("_k", F.col("_from") + F.col("_i")).drop("_s", "_from", "_i")


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` with sequence_id and offset: sequences of at most ``capacity``, gapless from 0.

    pieces needs ``length`` (1 to capacity) and columns ``order`` that tell rows apart (equal rows may trade places).
    The driver sees the histogram (at most ``capacity`` rows) and makes the plan; numbers within a length meet its
    slots in a lookup table of at most capacity**2 entries, in practice thousands.
    """
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    found = slots(plan(histogram, capacity, rounds).kinds)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, k: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
        lengths, ks = length.to_numpy(), k.to_numpy()
        for x in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == x)
            first, begin, copies, where = found[x]
            j = np.searchsorted(first, ks[at], side="right") - 1
            i = ks[at] - first[j]
            sequence[at] = begin[j] + i // copies[j]
            offset[at] = where[j] + i % copies[j] * x
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = numbered(pieces, order).withColumn("_p", place("length", "_k"))
    return placed.select(*pieces.columns, F.col("_p.sequence_id").alias("sequence_id"), F.col("_p.offset").alias("offset"))


def cut(docs: DataFrame, path: str, end_id: int | None = 1, capacity: int = CAPACITY, id_col="doc_id", text_col="text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: id, piece, start, length, ids_crc32, and ids if asked for.

    A document's ids are its text's (null: empty) and ``end_id``; only longer documents than ``capacity`` are cut, into
    pieces of that size and the rest. Without an end id an empty text has no piece.
    """

    def run(batches):
        encode = Encoder.of_worker(path)
        end = b"" if end_id is None else struct.pack("<I", end_id)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc"], pdf["text"], strict=True):
                ids = memoryview(encode(text) + end)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(own) // 4, zlib.crc32(own), *([np.frombuffer(own, "<u4").astype(np.int64)] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids).astype({"doc": "Int64"})
        give_back(encoders=False)

    schema = "doc long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInPandas(run, schema).withColumnRenamed("doc", id_col)


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of every document (see cut) with its place (see pack). Repeated rows are packed as often as they occur."""
    pieces = stored(cut(docs, path, id_col=id_col, text_col=text_col, with_ids=with_ids), "pieces")
    return pack(pieces, [id_col, "piece", "ids_crc32"])


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
