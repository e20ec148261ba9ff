"""WordPiece: BERT's uncased basic tokens, then the longest pieces of a vocabulary."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 200
# The blocks of CJK ideographs.
CJK = (
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F),
    (0x2B820, 0x2CEAF), (0x2F800, 0x2FA1F),
)
PAIR = "struct<ids array<int>, mask array<int>, types array<int>>"


def basic_tokens(text: str) -> list[str]:
    """Words and single marks: controls go, ideographs stand alone, lower case, accents off, non-alphanumeric ASCII counts as punctuation."""
    kept = []
    for ch in text:
        kind = unicodedata.category(ch)
        if ch in "\t\n\r" or kind == "Zs":
            kept.append(" ")
        elif ch not in "\0�" and kind not in ("Cc", "Cf"):
            kept.append(f" {ch} " if any(a <= ord(ch) <= b for a, b in CJK) else ch)
    out = []
    for word in "".join(kept).split(" "):
        run = ""
        for ch in unicodedata.normalize("NFD", word.lower()):
            kind = unicodedata.category(ch)
            if kind == "Mn":
                continue
            if kind[0] == "P" or "!" <= ch <= "~" and not ch.isalnum():
                out += [run, ch] if run else [ch]
                run = ""
            else:
                run += ch
        out += [run] if run else []
    return out


class WordPiece:
    """Over a vocabulary, a token a line; raises if a special token is missing."""

    def __init__(self, vocabulary: str):
        self.ids = {t: i for i, line in enumerate(vocabulary.split("\n")) if (t := line.removesuffix("\r"))}
        for name in ("[PAD]", "[UNK]", "[CLS]", "[SEP]"):
            if name not in self.ids:
                raise ValueError(f"the vocabulary lacks {name}")
        self.pad, self.unknown, self.begin, self.end = (self.ids[x] for x in ("[PAD]", "[UNK]", "[CLS]", "[SEP]"))

    def word(self, word: str) -> list[int]:
        out, at = [], 0
        if len(word) > LONGEST:
            return [self.unknown]
        while at < len(word):
            prefix = "##" if at else ""
            stop = next((e for e in range(len(word), at, -1) if prefix + word[at:e] in self.ids), None)
            if stop is None:
                return [self.unknown]
            out.append(self.ids[prefix + word[at:stop]])
            at = stop
        return out

    def tokenize(self, text: str | None) -> list[int]:
        return [i for w in basic_tokens(text or "") for i in self.word(w)]

    def _filled(self, first: list[int], second: list[int] | None, length: int) -> dict:
        ids = [self.begin, *first, self.end]
        types = [0] * len(ids)
        if second is not None:
            ids += [*second, self.end]
            types += [1] * (len(second) + 1)
        rest = length - len(ids)
        return {"ids": ids + [self.pad] * rest, "mask": [1] * len(ids) + [0] * rest, "types": types + [0] * rest}

    def encode_single(self, text: str | None, length: int) -> dict:
        return self._filled(self.tokenize(text)[: length - 2], None, length)

    def encode_pair(self, a: str | None, b: str | None, length: int) -> dict:
        """The longer side is cut, the second of equal ones."""
        x, y = self.tokenize(a), self.tokenize(b)
        while len(x) + len(y) > length - 3:
            (x if len(x) > len(y) else y).pop()
        return self._filled(x, y, length)

    def tokens_column(self, text: Column) -> Column:
        @F.pandas_udf("array<int>")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(self.tokenize)

        return run(text)

    def single_column(self, text: Column, length: int = 256) -> Column:
        @F.pandas_udf(PAIR)
        def run(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([self.encode_single(x, length) for x in texts], columns=["ids", "mask", "types"])

        return run(text)

    def pair_column(self, a: Column, b: Column, length: int = 256) -> Column:
        @F.pandas_udf(PAIR)
        def run(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([self.encode_pair(x, y, length) for x, y in zip(xs, ys, strict=True)], columns=["ids", "mask", "types"])

        return run(a, b)
