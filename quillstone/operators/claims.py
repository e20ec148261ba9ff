"""Answer texts split into claims, their cited passages, and verification."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.slices import in_slices, rows_of
from ..functions.text import cites, col
from ..functions.vectors import softmax, verdict

# The rules for sentences with [n] marks.
CITE = re.compile(r"\[([0-9]+)\]")
SENTENCE = re.compile(r"[^.!?\n]+[.!?]?(?:\s*\[[0-9]+\](?:\s*,\s*\[[0-9]+\])*)*[.!?]?\s*")
ONLY_CITES = re.compile(r"[\s,;.]*(?:\[[0-9]+\][\s,;.]*)*")
ENDED = re.compile(r"[.!?]\s*(?:\[[0-9]+\])*\s*\Z")
#: Stand-ins for sentence marks within code spans: private characters, put back afterwards.
SHIELD = {".": "", "!": "", "?": ""}
CLAIM = "claim_ord int, text string, cites array<int>, partial boolean"
CLAIMS = f"array<struct<{CLAIM}>>"
_CLAIM = pa.struct([("claim_ord", pa.int32()), ("text", pa.string()), ("cites", pa.list_(pa.int32())), ("partial", pa.bool_())])


def split_claims(text: str | None, done: bool = True) -> list[tuple[str, list[int], bool]]:
    """(text, cites, partial) of each claim.

    A leading `Answer:` goes. Sentence marks within code spans end nothing. A part of marks and [n] alone joins the claim kept
    before it; a part that repeats that claim, [n] apart, is dropped. Unless done, a last claim without an end is partial.
    """
    clean = re.sub(r"\AAnswer:\s*", "", text or "", flags=re.I).strip()
    shielded = re.sub(r"`[^`]*`", lambda m: m[0].translate(str.maketrans(SHIELD)), clean)
    back = str.maketrans({v: k for k, v in SHIELD.items()})
    kept: list[tuple[str, list[int]]] = []
    for part in SENTENCE.findall(shielded) or [shielded]:
        part = part.translate(back).strip()
        if not part:
            continue
        numbers = [int(n) for n in CITE.findall(part)]
        if kept and ONLY_CITES.fullmatch(part):
            before, seen = kept[-1]
            kept[-1] = (f"{before} {part}".strip(), list(dict.fromkeys(seen + numbers)))
        elif not kept or CITE.sub("", kept[-1][0]).strip() != CITE.sub("", part).strip():
            kept.append((part, list(dict.fromkeys(numbers))))
    last = len(kept) - 1
    return [(t, c, not done and i == last and not ENDED.search(t)) for i, (t, c) in enumerate(kept)]


def claims_of(answers: DataFrame, id_col: str, text_col: str, done: bool = True) -> DataFrame:
    """A row for each claim: id, claim_ord, text, cites, partial."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"claim_ord": i, "text": t, "cites": c, "partial": p} for i, (t, c, p) in enumerate(split_claims(x, done))] for x in batch.column("_text").to_pylist()]
        return rows_of(batch, [id_col], found, _CLAIM)

    kind = answers.schema[id_col].dataType.simpleString()
    return answers.select(id_col, F.col(text_col).alias("_text")).mapInArrow(in_slices(work, "_text"), f"`{id_col}` {kind}, {CLAIM}")


def cited_passages(claims: DataFrame, passages: DataFrame, id_col: str) -> DataFrame:
    """Each claim with its passages (n, heading, text) as an array: the cited ones in order of the marks, numbers without a passage
    left out; all, in order, if it cites none. passages: id, n from 1, heading, text; a few for each answer.
    """
    own = passages.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("n", "heading", "text"))).alias("_all"))
    joined = claims.join(own, id_col, "left").withColumn("_all", F.coalesce("_all", F.expr("cast(array() as array<struct<n int, heading string, text string>>)")))
    picked = F.filter(F.transform("cites", lambda n: F.get(F.filter("_all", lambda p: p["n"] == n), 0)), lambda p: p.isNotNull())
    return joined.withColumn("passages", F.when(F.size("cites") == 0, F.col("_all")).otherwise(picked)).drop("_all")


def verify_claims(claims: DataFrame, scorer=None, logits_col: str | None = None, least: float = 0.5) -> DataFrame:
    """Claims with entailment and status. ``scorer(pairs) -> rows of three logits`` (contradiction, entailment, neutral) judges
    (premise, text); or the logits stand in a column; with neither every claim is unverified."""
    from ..functions.text import premise

    if scorer is not None:
        logits_col = "_logits"

        @F.pandas_udf("array<double>")
        def judge(premises: pd.Series, texts: pd.Series) -> pd.Series:
            return pd.Series([[float(v) for v in r] for r in scorer(list(zip(premises, texts, strict=True)))])

        claims = claims.withColumn(logits_col, judge(premise("passages"), F.col("text")))
    if logits_col is None:
        return claims.withColumn("entailment", F.lit(None).cast("double")).withColumn("status", F.lit("unverified"))
    p = softmax(logits_col)
    out = claims.withColumn("entailment", F.get(p, 1)).withColumn("status", verdict(F.get(p, 1), F.get(p, 0), F.col("text"), least))
    return out.drop("_logits").withColumn("entailment", F.when(F.col("status") != "unverified", F.col("entailment")))


def claim_summary(claims: DataFrame, by: list[str]) -> DataFrame:
    return claims.groupBy(*by).agg(F.count_if(F.col("status") == "supported").alias("supported"), F.count("*").alias("total"))


def cited_sources(answers: DataFrame, passages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pos, n, title, heading for each passage that the text cites, in order of the first mark; a heading that equals the title is null."""
    marks = answers.select(id_col, F.posexplode(F.array_distinct(cites(text_col))).alias("pos", "n"))
    found = marks.join(passages.select(id_col, "n", "title", "heading"), [id_col, "n"])
    return found.select(id_col, "pos", "n", "title", F.when((F.col("heading") != "") & (F.col("heading") != F.col("title")), F.col("heading")).alias("heading"))


def tokens_per_second(text: Column | str, ms: Column | str) -> Column:
    """The estimate of a token for four characters."""
    return F.length(col(text)) / 4.0 / (col(ms) / 1000.0)
