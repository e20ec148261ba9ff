"""Token ids and their binary output: an adaptive context-mixing range coder over independently reset, checksummed blocks.

File format, little-endian: MAGIC; sections, each `B` + a group of blocks or `I` + the document index; see TokenWriter.
Each id is coded over mixed predictions: of the last two ids (order 2), of the last id (order 1) and of the group's id counts (order 0),
with counts and weights that adapt to what was coded; see _Model. All blocks of a group start from the same state, the group's
alphabet, so each can be decoded alone. A block is coded as up to STREAMS streams in step, which share its model.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import unicodedata
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.slices import cuts, sizes
from .common import give_back, shared_dir, stored, table

MAGIC = b"QSTOK03\n"
#: Ids in a block at most, so that the numbers of three symbols fit 63 bits, and streams of a block at most.
BLOCK_BITS, STREAMS = 21, 4096
BLOCK = 1 << BLOCK_BITS
#: What a context's symbols and its escape have together.
ALL_BITS = 16
ALL = 1 << ALL_BITS
#: How often a pair is seen before it is a context; kinds of contexts; steps of a round from whose symbols weights learn; what weights begin with; the largest.
LEAST, KINDS, LEARN, PRIOR, MOST = 12, 64, 64, 0.4, 0.996
LOW_BITS, LEAST_SPAN = np.uint64(0xFFFFFFFF), np.uint64(1 << 32)

#: Rows and bytes of texts that are encoded together at most.
SLICE = 4096, 4 << 20
#: The pieces of a lower-case ASCII part, as the tokenizer's pattern cuts it.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Texts without these split at white space into parts that are encoded alike alone and together.
NOT_PLAIN = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa1-\u012f\u0131-\u024f]|<\\|")
ASCII_PLAIN = bytes([9, 10, 11, 12, 13, *range(32, 127)])
#: The characters of plain texts that are neither letters nor numbers nor white space.
MARKS = "".join(c for c in map(chr, [*range(33, 127), *range(0xA1, 0x250)]) if unicodedata.category(c)[0] not in "LN")


def plain(text: str) -> bool:
    if text.isascii():
        return "<|" not in text and not text.encode().translate(None, ASCII_PLAIN)
    return not NOT_PLAIN.search(text)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers in bytes.

    For word_bpe_49k each part between white space is encoded by itself, so a part is given to the tokenizer once and
    then looked up. Texts that are not plain (compositions, special white space or case rules,
    control strings) go through the tokenizer whole.
    """

    def __init__(self, path: str, by_part: bool = True, keep: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.by_part, self.keep, self.known = Tokenizer.from_file(path), by_part, keep, {}
        # for parts of plain lower-case texts, which its normalizer leaves as they are, and words of letters, which its pattern leaves whole
        self.of_words = Tokenizer.from_file(path) if by_part else None
        if by_part:
            self.of_words.normalizer, self.pattern = None, self.tokenizer.pre_tokenizer
            self.whole = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values(), default=0) + 1, bool)  # ids that end a word
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True

    @classmethod
    def of_worker(cls, path: str) -> Encoder:
        """One for each worker process: what it has looked up serves later tasks as well."""
        kept = sys.__dict__.setdefault("_quillstone_encoders", {})
        if path not in kept:
            kept[path] = cls(path, by_part=path.endswith("word_bpe_49k.json"))
        return kept[path]

    def _ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 2000):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts[at : at + 2000], add_special_tokens=False)]
        return out

    def _learn(self, parts: set[str], to: dict[str, bytes]) -> None:
        """Looks up new parts. A word of letters and the marks behind it are encoded apart, as the tokenizer parts them; parts go
        together, and the ids that end pieces part them."""
        known, cores, words, rest = self.known, {}, set(), []
        for x in parts:
            if x.isalpha():
                words.add(x)
            elif (core := x.rstrip(MARKS)).isalpha():
                cores[x] = core
                if core not in known:
                    words.add(core)
            else:
                rest.append(x)
        rest += [m for m in {x[len(c) :] for x, c in cores.items()}.difference(rest) if m not in known]
        joined = [x for x in rest if x and x.isascii()]
        self._learn_joined(joined, [len(PIECES.findall(x)) for x in joined], self.pattern, to)
        rest = [x for x in rest if not x or not x.isascii()]
        to.update(zip(rest, self._ids(rest), strict=True))
        self._learn_joined(list(words), [1] * len(words), self.whole, to)
        for x, core in cores.items():
            mark = x[len(core) :]
            to[x] = (known[core] if core in known else to[core]) + (known[mark] if mark in known else to[mark])

    def _learn_joined(self, parts: list[str], pieces: list[int], way, to: dict[str, bytes]) -> None:
        """Parts that the tokenizer cuts into known numbers of pieces, encoded as one text: the ids that end pieces part them."""
        self.of_words.pre_tokenizer = way
        for at in range(0, len(parts), 500):
            own, stop = parts[at : at + 500], np.cumsum(pieces[at : at + 500])
            ids = np.array(self.of_words.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) != stop[-1]:
                raise ValueError("the tokenizer has made other pieces of the parts")
            data, stops = ids.tobytes(), ends[stop - 1].tolist()
            to.update(zip(own, [data[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_part or not plain(text):
            return self._ids([text])[0]
        parts, known = text.lower().split(), self.known
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            if len(known) > self.keep:
                known.clear()
            self._learn(set(parts).difference(known), known)
            return b"".join(map(known.__getitem__, parts))

    def each(self, texts: pa.Array) -> list[bytes]:
        """The same of many texts: Arrow parts them, and a part that occurs often is looked up once."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        apart = pc.match_substring_regex(texts, NOT_PLAIN.pattern).to_numpy(zero_copy_only=False) if self.by_part else np.ones(len(texts), bool)
        lists = pc.utf8_split_whitespace(pc.utf8_lower(texts.filter(pa.array(~apart))))
        parts, known = lists.flatten().dictionary_encode(), self.known
        words = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(known.get, words))
        if new := [k for k, x in enumerate(ids) if x is None]:
            fresh: dict[str, bytes] = {}
            self._learn({words[k] for k in new}, fresh)
            for k in new:
                ids[k] = fresh[words[k]]
            if len(known) > self.keep:
                known.clear()
            # parts that these texts have once are mostly names and numbers that do not come again
            often = np.bincount(parts.indices.to_numpy(), minlength=len(words))[new] > 1
            known.update((words[k], ids[k]) for k, x in zip(new, often.tolist(), strict=True) if x)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        part = parts.indices.to_numpy()
        long = size[part]
        end = np.concatenate(([0], np.cumsum(long)))
        data = np.frombuffer(b"".join(ids), "<u4")[np.arange(end[-1]) + np.repeat((np.cumsum(size) - size)[part] - end[:-1], long)].tobytes()
        offsets = lists.offsets.to_numpy()
        stops = (end[offsets - offsets[0]] * 4).tolist()
        plain = iter(zip(stops, stops[1:], strict=False))
        return [self(text.as_py()) if whole else data[slice(*next(plain))] for text, whole in zip(texts, apart.tolist(), strict=True)]


class _Model:
    """What a block's coder predicts: mixed masses of orders 2, 1 and 0, with counts and weights that follow the ids coded so far.

    A block is cut into streams that are coded in step. Its counts begin empty, with the group's order-0 counts, and are taken
    anew after 1, 2, 4, 8... steps from all ids of all its streams. A symbol's mass after a context is what the context's counts
    give it, times a weight, plus the mass by the next lower order, times the rest. The weights, one for each kind of
    context (how often seen, how many symbols), follow the share that the order had in the symbols coded. What a context has not
    seen is coded by an escape and the next lower order. Only integers and single sums, products and quotients of doubles are
    used, so every machine decodes alike.
    """

    def __init__(self, cumulated: np.ndarray):
        self.zero, self.bits = cumulated, int(cumulated[-1]).bit_length() - 1
        self.share = np.diff(cumulated)
        self.n = len(self.share)
        self.part0 = self.share / float(cumulated[-1])
        self.gain = [np.tile(np.array([0.5, 1.0]) * PRIOR, (KINDS, 1)) for _ in range(2)]  # of orders 1 and 2: shares and symbols seen

    def count(self, seen: np.ndarray) -> None:
        """Counts pairs and triples of the ids coded so far (steps, streams) and lays out the masses anew."""
        pairs = seen[:-1] * self.n + seen[1:]
        triples, often = _counted((pairs[:-1] * self.n + seen[2:]).ravel())
        first = triples // self.n
        head = _heads(first)
        found = _counted(pairs.ravel())
        self.lay_out(*found, np.repeat(np.searchsorted(found[0], first[head]), np.diff(np.append(head, len(first)))), triples - first * self.n, often)

    def lay_out(self, pairs: np.ndarray, often: np.ndarray, first: np.ndarray, symbol: np.ndarray, often2: np.ndarray) -> np.ndarray:
        """Of ascending pairs and triples (first: the place of the first two) and how often each was seen. Returns which triples are kept."""
        n, self.pairs = self.n, pairs
        context = pairs // n
        self.symbol1 = pairs - context * n
        total = np.bincount(context, often, n)
        self.kind1 = _kind(total, np.bincount(context, minlength=n))
        self.weight1 = (self.gain[0][:, 0] / self.gain[0][:, 1])[self.kind1]
        self.part1 = (self.weight1 / np.maximum(total, 1))[context] * often
        mixed = self.part1 + (1 - self.weight1)[context] * self.part0[self.symbol1]
        self.table1 = _Table(mixed, context, n)
        # contexts of order 2 are pairs; those seen seldom are left to order 1
        head = _heads(first)
        length = np.diff(np.append(head, len(first)))
        total = np.add.reduceat(often2, head) if len(head) else np.zeros(0, np.int64)
        enough = total >= LEAST
        kept = np.repeat(enough, length)
        first, symbol, often2, head, length, total = first[kept], symbol[kept], often2[kept], first[head[enough]], length[enough], total[enough]
        rows = len(head)
        self.row1 = np.full(len(pairs) + 1, rows)  # of a pair, the row of what follows it; the last row is empty
        self.row1[head] = np.arange(rows)
        row = np.repeat(np.arange(rows), length)
        self.pair2 = np.searchsorted(pairs, self.symbol1[first] * n + symbol)  # of a triple, its last two
        self.kind2 = _kind(np.append(total, 0), np.append(length, 0))
        self.weight2 = (self.gain[1][:, 0] / self.gain[1][:, 1])[self.kind2]
        self.part2 = (self.weight2[:-1] / total)[row] * often2
        self.table2 = _Table(self.part2 + (1 - self.weight2)[row] * mixed[self.pair2], row, rows + 1)
        self.symbol2 = symbol
        return kept

    def learn(self, row: np.ndarray, triple: np.ndarray, last: np.ndarray, pair: np.ndarray, x: np.ndarray) -> None:
        """Of symbols coded: their contexts and the places of their triples and pairs (-1: none)."""
        one, weight = np.append(self.part1, 0)[pair], self.weight1[last]
        low = one + (1 - weight) * self.part0[x]
        two, weight = np.append(self.part2, 0)[triple], self.weight2[row]
        for gain, kind, share in ((self.gain[0], self.kind1[last], one / low), (self.gain[1], self.kind2[row], two / (two + (1 - weight) * low))):
            gain *= 0.5
            gain[:, 0] += np.bincount(kind, (share * ALL).astype(np.int64), KINDS) / ALL + PRIOR / 4
            gain[:, 1] += np.bincount(kind, minlength=KINDS) + PRIOR / 2
            np.minimum(gain[:, 0], gain[:, 1] * MOST, out=gain[:, 0])


def _heads(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    head = _heads(keys)
    return keys[head], np.diff(np.append(head, len(keys)))


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys, below 2 ** 42, and the place of each of at most BLOCK keys among them."""
    keys = np.sort((keys << BLOCK_BITS) | np.arange(len(keys)))
    at = keys & (BLOCK - 1)
    keys >>= BLOCK_BITS
    head = _heads(keys)
    number = np.empty(len(keys), np.int32)
    number[at] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(keys))))
    return keys[head], number


def _kind(total: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    often = np.minimum(np.frexp(total.astype(np.float64))[1], KINDS // 4 - 1)
    return often * 4 + (distinct > 1) + (distinct * 4 > total) + (distinct * 2 > total)


class _Table:
    """Of ALL each symbol's start and size, and what each row's symbols have together; an escape has the rest.

    Rows are cut into cells, two or more for each symbol; of each the last symbol that starts in it or before is kept.
    """

    def __init__(self, mixed: np.ndarray, row: np.ndarray, rows: int):
        size = (mixed * (ALL - 1)).astype(np.int64)
        end, length = np.cumsum(size), np.bincount(row, minlength=rows)
        base = np.concatenate(([0], end))[np.concatenate(([0], np.cumsum(length)))]
        self.row, self.known = row, np.diff(base)
        start = end - size - base[row]
        bits = np.minimum(np.frexp(length.astype(np.float64))[1] + 1, ALL_BITS)
        cells = 1 << bits
        self.shift, self.cell = ALL_BITS - bits, np.cumsum(cells) - cells
        self.upto = (np.cumsum(np.bincount(self.cell[row] + (start >> self.shift[row]), minlength=cells.sum())) - 1).astype(np.int32)
        self.start, self.size = start.astype(np.int32), np.append(size, 0).astype(np.int32)  # no symbol (-1) has no size

    def at(self, row: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The symbol at a value, below the row's known, of each row."""
        place = self.upto[self.cell[row] + (value >> self.shift[row])].astype(np.int64)
        over = np.flatnonzero(self.start[place] > value)
        for _ in range(16):
            if not len(over):
                return place
            place[over] -= 1
            over = over[self.start[place[over]] > value[over]]
        place[over] = np.searchsorted(self.start + (self.row << ALL_BITS), (row[over] << ALL_BITS) + value[over], side="right") - 1
        return place


def streams_of(longest: int) -> tuple[int, int]:
    """Streams of a block and the steps of each; the last is filled up."""
    streams = max(1, min(STREAMS, longest // 512))
    return streams, -(-longest // streams)


def _rounds(steps: int):
    """Steps between which the counts stay as they are."""
    ends = [1 << k for k in range(steps.bit_length()) if 1 << k < steps]
    return zip([0, *ends], [*ends, steps], strict=True)


def alphabet_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, ascending, and their order-0 counts as running sums to a power of two, one at least for each."""
    found, often = np.unique(ids, return_counts=True)
    total = 1 << max(17, len(found).bit_length() + 2)
    share = 1 + often * (total - len(found)) // max(1, often.sum())
    if len(found):
        share[often.argmax()] += total - share.sum()
    return found.astype(np.uint32), np.concatenate(([0], np.cumsum(share))).astype(np.int64)


def encode_blocks(symbols: np.ndarray, cumulated: np.ndarray) -> list[bytes]:
    """The code of each row of symbols (blocks, length), numbers in the alphabet: bytes of each stream (unsigned 32-bit), then the streams."""
    return [_encode(row, cumulated) for row in symbols]


def _encode(ids: np.ndarray, cumulated: np.ndarray) -> bytes:
    streams, steps = streams_of(len(ids))
    x = np.ascontiguousarray(np.append(ids, np.full(streams * steps - len(ids), ids[-1])).astype(np.int64).reshape(streams, steps).T)
    model, room = _Model(cumulated), 4 * steps + 2
    at = np.arange(streams) * room
    words, begin = np.zeros(streams * room, np.uint32), at.copy()
    low, span = np.zeros(streams, np.uint64), np.full(streams, 1 << 48, np.uint64)

    def narrow(own, start, size, bits):
        part = span[own] >> bits
        lows, spans = low[own] + start * part, size * part
        while len(due := np.flatnonzero(spans < LEAST_SPAN)):
            to = due if isinstance(own, slice) else own[due]
            words[at[to]] = lows[due] >> 32  # with a carry to the word before, if any
            at[to] += 1
            lows[due] = (lows[due] & LOW_BITS) << 16
            spans[due] <<= 16
            if bits == ALL_BITS:
                break  # one word is enough
        low[own], span[own] = lows, spans

    n = model.n
    pairs, pair_at = _numbered((x[:-1] * n + x[1:]).ravel())
    triples, triple_at = _numbered(pair_at[:-streams].astype(np.int64) * n + x[2:].ravel())
    pair_at, triple_at = pair_at.reshape(-1, streams), triple_at.reshape(-1, streams)
    first, symbol = triples // n, triples % n
    often, often2 = np.zeros(len(pairs), np.int64), np.zeros(len(triples), np.int64)
    for lo, hi in _rounds(steps):
        if lo > 1:
            # what the decoder counts of the ids coded so far
            often += np.bincount(pair_at[max(0, lo // 2 - 1) : lo - 1].ravel(), minlength=len(pairs))
            often2 += np.bincount(triple_at[max(0, lo // 2 - 2) : lo - 2].ravel(), minlength=len(triples))
            seen, seen2 = np.flatnonzero(often), np.flatnonzero(often2)
            pairs_now, triples_now = np.full(len(pairs), -1, np.int32), np.full(len(triples), -1, np.int32)
            pairs_now[seen] = np.arange(len(seen))
            kept = seen2[model.lay_out(pairs[seen], often[seen], pairs_now[first[seen2]], symbol[seen2], often2[seen2])]
            triples_now[kept] = np.arange(len(kept))
            one, two = model.table1, model.table2
            start1, start2 = np.append(one.start, 0), np.append(two.start, 0)
            row = model.row1[pairs_now[pair_at[lo - 2]]]
            kept = []
        for t in range(lo, hi):
            now, own = x[t], slice(None)
            if lo > 1:
                last, pair, triple = x[t - 1], pairs_now[pair_at[t - 1]], triples_now[triple_at[t - 2]]
                size, known = two.size[triple], two.known[row]
                rest = size == 0
                narrow(own, np.where(rest, known, start2[triple]).astype(np.uint64), np.where(rest, ALL - known, size).astype(np.uint64), ALL_BITS)
                triple[rest] = -1
                own = np.flatnonzero(rest)
                context, place = last[own], pair[own]
                size, known = one.size[place], one.known[context]
                rest = size == 0
                narrow(own, np.where(rest, known, start1[place]).astype(np.uint64), np.where(rest, ALL - known, size).astype(np.uint64), ALL_BITS)
                own = own[rest]
                pair[own] = -1
                if t >= hi - LEARN:
                    kept.append((row, triple, last, pair, now))
                row = model.row1[pair]
            if lo < 2 or len(own):
                narrow(own, model.zero[now[own]].astype(np.uint64), model.share[now[own]].astype(np.uint64), model.bits)
        if lo > 1:
            model.learn(*map(np.concatenate, zip(*kept, strict=True)))
    words[at] = (low + LOW_BITS) >> 32  # zeros behind it lie within the span
    length = at + 1 - begin
    flat = words[np.arange(length.sum()) + np.repeat(begin - np.cumsum(length) + length, length)]
    while (carry := flat >> 16).any():
        flat &= 0xFFFF
        flat[:-1] += carry[1:]
    return (length * 2).astype("<u4").tobytes() + flat.astype("<u2").tobytes()


def decode_blocks(coded: list[bytes], longest: int, cumulated: np.ndarray) -> np.ndarray:
    return np.stack([_decode(x, longest, cumulated) for x in coded]) if coded else np.zeros((0, longest), np.int64)


def _decode(coded: bytes, longest: int, cumulated: np.ndarray) -> np.ndarray:
    streams, steps = streams_of(longest)
    length = np.frombuffer(coded, "<u4", streams).astype(np.int64) // 2
    if (len(coded) - 4 * streams) != 2 * length.sum():
        raise ValueError("a block's length is wrong")
    at = np.concatenate(([0], np.cumsum(length + 2)[:-1]))  # two zeros behind each stream
    words = np.zeros(length.sum() + 2 * streams + 4 * steps + 8, np.uint64)
    words[np.arange(length.sum()) + np.repeat(2 * np.arange(streams), length)] = np.frombuffer(coded, "<u2", offset=4 * streams)
    model, x = _Model(cumulated), np.zeros((steps, streams), np.int64)
    code, span = (words[at] << 32) | (words[at + 1] << 16) | words[at + 2], np.full(streams, 1 << 48, np.uint64)
    at += 3

    def value(codes, part, bits):
        return np.minimum(codes // part, (1 << bits) - 1).astype(np.int64)

    def narrow(own, codes, part, start, size, bits=ALL_BITS):
        codes, spans = codes - start.astype(np.uint64) * part, size.astype(np.uint64) * part
        while len(due := np.flatnonzero(spans < LEAST_SPAN)):
            to = due if isinstance(own, slice) else own[due]
            codes[due] = (codes[due] << 16) | words[at[to]]
            at[to] += 1
            spans[due] <<= 16
            if bits == ALL_BITS:
                break
        code[own], span[own] = codes, spans

    for lo, hi in _rounds(steps):
        if lo > 1:
            model.count(x[:lo])
        if lo > 1:
            row, last = model.row1[np.searchsorted(model.pairs, x[lo - 2] * model.n + x[lo - 1])], x[lo - 1]
        kept = []
        for t in range(lo, hi):
            own, now = np.arange(streams), x[t]
            if lo > 1:
                pair, triple = np.full(streams, -1), np.full(streams, -1)
                part = span >> ALL_BITS
                v = value(code, part, ALL_BITS)
                start = model.table2.known[row]
                hit, size = v < start, ALL - start
                own = np.flatnonzero(hit)
                place = model.table2.at(row[own], v[own])
                triple[own], pair[own], now[own] = place, model.pair2[place], model.symbol2[place]
                start[own], size[own] = model.table2.start[place], model.table2.size[place]
                narrow(slice(None), code, part, start, size)
                own = np.flatnonzero(~hit)
                codes, part, context = code[own], span[own] >> ALL_BITS, last[own]
                v = value(codes, part, ALL_BITS)
                start = model.table1.known[context]
                escaped, size = v >= start, ALL - start
                hit = np.flatnonzero(~escaped)
                place = model.table1.at(context[hit], v[hit])
                pair[own[hit]], now[own[hit]] = place, model.symbol1[place]
                start[hit], size[hit] = model.table1.start[place], model.table1.size[place]
                narrow(own, codes, part, start, size)
                own = own[escaped]
            if len(own):
                codes, part = code[own], span[own] >> model.bits
                place = np.searchsorted(model.zero, value(codes, part, model.bits), side="right") - 1
                now[own] = place
                narrow(own, codes, part, model.zero[place], model.share[place], model.bits)
            if lo > 1:
                if t >= hi - LEARN:
                    kept.append((row, triple, last, pair, now))
                row, last = model.row1[pair], now
        if kept:
            model.learn(*map(np.concatenate, zip(*kept, strict=True)))
    return x.T.ravel()[:longest]


class TokenWriter:
    """Writes ids of documents, in the order given, to a stream; holds a block at most.

    A group: `B`, number of blocks, length of a block, ids in the group (the last block is filled up with its last id), bytes of the alphabet,
    CRC-32 of it (5 unsigned 32-bit), the alphabet (zlib: ids and their order-0 counts, unsigned 32-bit), then for each block bytes of code
    and CRC-32 of its ids and code (2 unsigned 32-bit), then the codes. The index, at the end: `I`, number of documents, their ids
    (signed 64-bit; 1 byte each before that says whether it is null) and lengths (unsigned 64-bit), CRC-32 of that.
    """

    def __init__(self, stream):
        self.stream, self.held, self.n, self.index = stream, [], 0, []
        stream.write(MAGIC)

    def add(self, doc, ids: bytes) -> None:
        self.index.append((doc, len(ids) // 4))
        self.held.append(ids)
        self.n += len(ids) // 4
        if self.n >= BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        while len(ids) >= BLOCK or last and len(ids):
            self._group(ids[: BLOCK])
            ids = ids[BLOCK :]
        self.held, self.n = [ids.tobytes()], len(ids)

    def _group(self, ids: np.ndarray) -> None:
        found, cumulated = alphabet_of(ids)
        blocks = -(-len(ids) // BLOCK)
        longest = -(-len(ids) // blocks)
        blocks = -(-len(ids) // longest)
        rows = np.concatenate((ids, np.full(blocks * longest - len(ids), ids[-1], np.uint32))).astype("<u4").reshape(blocks, longest)
        if found[-1] < 1 << 20:
            number = np.zeros(int(found[-1]) + 1, np.int64)
            number[found] = np.arange(len(found))
            symbols = number[rows]
        else:
            symbols = np.searchsorted(found, rows)
        coded = encode_blocks(symbols, cumulated)
        table = zlib.compress(found.astype("<u4").tobytes() + np.diff(cumulated).astype("<u4").tobytes())
        head = [struct.pack("<II", len(x), zlib.crc32(x, zlib.crc32(row.tobytes()))) for x, row in zip(coded, rows, strict=True)]
        self.stream.write(b"B" + struct.pack("<IIIII", blocks, longest, len(ids), len(table), zlib.crc32(table)) + table + b"".join(head) + b"".join(coded))

    def close(self) -> None:
        self._flush(True)
        body = bytes(d is None for d, _ in self.index) + np.array([d or 0 for d, _ in self.index], "<i8").tobytes() + np.array([n for _, n in self.index], "<u8").tobytes()
        self.stream.write(b"I" + struct.pack("<QI", len(self.index), zlib.crc32(body)) + body)


def read_groups(stream):
    """The id arrays of a file's groups, then its index [(doc, length)]: ("ids", array)... ("index", list). Checks all checksums."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    while kind := stream.read(1):
        if kind == b"B":
            n, longest, count, size, crc = struct.unpack("<IIIII", stream.read(20))
            table = stream.read(size)
            if zlib.crc32(table) != crc:
                raise ValueError("an alphabet's checksum is wrong")
            found, share = np.frombuffer(zlib.decompress(table), "<u4").reshape(2, -1)
            heads = list(struct.iter_unpack("<II", stream.read(8 * n)))
            coded = [stream.read(h[0]) for h in heads]
            ids = found[decode_blocks(coded, longest, np.concatenate(([0], np.cumsum(share, dtype=np.int64))))].astype("<u4")
            for x, row, h in zip(coded, ids, heads, strict=True):
                if zlib.crc32(x, zlib.crc32(row.tobytes())) != h[1]:
                    raise ValueError("a block's checksum is wrong")
            yield "ids", ids.ravel()[:count]
        elif kind == b"I":
            n, crc = struct.unpack("<QI", stream.read(12))
            body = stream.read(17 * n)
            if zlib.crc32(body) != crc:
                raise ValueError("the index's checksum is wrong")
            ids, lengths = np.frombuffer(body[n : 9 * n], "<i8").tolist(), np.frombuffer(body[9 * n :], "<u8").tolist()
            yield "index", [(None if no else d, k) for no, d, k in zip(body[:n], ids, lengths, strict=True)]
        else:
            raise ValueError("unknown section")


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int | None, id_col="doc_id", text_col="text") -> DataFrame:
    """Writes the ids of all documents in ascending id order (nulls first, then text) to files in ``folder``.

    Returns the files that count: file, name, n_ids, n_docs. A task that runs again writes under another name. Null texts
    count as empty. The documents are dealt by ranges of (id, hash of the text), so a repeated id is no hot key.
    """

    def run(batches):
        import pyspark

        encode, part = Encoder.of_worker(path), pyspark.TaskContext.get().partitionId()
        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name, end, n, docs_seen = f"part-{part:06d}-{uuid.uuid4().hex}.qtok", b"" if end_id is None else struct.pack("<I", end_id), 0, 0
        with fs.open_output_stream(f"{root}/{name}") as stream:
            writer = TokenWriter(stream)
            for batch in (b.slice(at, to - at) for b in batches for at, to in cuts(sizes(b.column("text")), *SLICE)):
                for doc, ids in zip(batch.column("doc").to_pylist(), encode.each(batch.column("text")), strict=True):
                    writer.add(doc, ids + end)
                    n, docs_seen = n + (len(ids) + len(end)) // 4, docs_seen + 1
            writer.close()
        give_back(encoders=False)
        yield pa.RecordBatch.from_pydict({"file": [part], "name": [name], "n_ids": [n], "n_docs": [docs_seen]}, schema=pa.schema([("file", pa.int64()), ("name", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())]))

    ordered = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).repartitionByRange(F.col("doc"), F.xxhash64("text")).sortWithinPartitions("doc", "text")
    return stored(ordered.mapInArrow(run, "file long, name string, n_ids long, n_docs long"), "token-files")


def read_tokens(files: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc, start (ids of all documents before it), n_tokens, ids_crc32, and its ids if asked for."""
    before = F.sum("n_ids").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1))  # a row for each file, not for each document
    placed = files.select("file", "name", F.coalesce(before, F.lit(0)).alias("base"))
    n = max(1, files.count())

    def run(batches):
        fs, root = pa.fs.FileSystem.from_uri(folder)
        for pdf in batches:
            for name, base in zip(pdf["name"], pdf["base"], strict=True):
                with fs.open_input_stream(f"{root}/{name}") as stream:  # the index stands behind the ids: a first, light pass fetches it
                    lengths = _index(stream)
                yield from _documents(fs, f"{root}/{name}", lengths, int(base), with_ids)

    schema = "doc long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return placed.repartition(n, "file").mapInPandas(run, schema)


def _index(stream) -> list:
    stream.read(len(MAGIC))
    while kind := stream.read(1):
        if kind == b"B":
            n, _, _, size, _ = struct.unpack("<IIIII", stream.read(20))
            stream.read(size)
            skip = sum(h[0] for h in struct.iter_unpack("<II", stream.read(8 * n)))
            while skip:
                skip -= len(stream.read(min(skip, 1 << 22)))
        else:
            n, _ = struct.unpack("<QI", stream.read(12))
            body = stream.read(17 * n)
            ids, lengths = np.frombuffer(body[n : 9 * n], "<i8").tolist(), np.frombuffer(body[9 * n :], "<u8").tolist()
            return [(None if no else d, k) for no, d, k in zip(body[:n], ids, lengths, strict=True)]
    return []


def _documents(fs, file: str, index: list, start: int, with_ids: bool):
    rows, crc, own, parts, k = [], 0, 0, [], 0

    def frame():
        out = pd.DataFrame(rows, columns=["doc", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)
        rows.clear()
        return out.astype({"doc": "Int64"})

    def close():
        nonlocal crc, own, parts, k, start
        rows.append((index[k][0], start, own, crc, *([np.concatenate([np.empty(0, np.int64), *parts])] if with_ids else [])))
        start, crc, own, parts, k = start + own, 0, 0, [], k + 1

    with fs.open_input_stream(file) as stream:
        for kind, ids in read_groups(stream):
            if kind != "ids":
                continue
            view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            at = 0
            while at < len(ids):
                take = min(index[k][1] - own, len(ids) - at)
                crc = zlib.crc32(view[4 * at : 4 * (at + take)], crc)
                if with_ids:
                    parts.append(ids[at : at + take].astype(np.int64))
                own, at = own + take, at + take
                while k < len(index) and own == index[k][1]:
                    close()
            if rows:
                yield frame()
    while k < len(index):  # documents without ids at the end
        close()
    if rows:
        yield frame()


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else "file://" + folder
    files = write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_path(), end_id=2)
    return read_tokens(files, folder).withColumnRenamed("doc", "doc_id")
