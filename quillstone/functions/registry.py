"""The engine's functions by name, for SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import chunk_text
from ..operators.claims import CLAIMS, split_claims


@F.udtf(returnType="key string, doc_id string, seq int, heading string, text string")
class ChunkDocument:
    """A row for each chunk of a document: chunk_document(doc_id, title, body)."""

    def eval(self, doc_id, title, body):
        for k, (heading, text) in enumerate(chunk_text(title, body)):
            yield f"{doc_id}#{k}", str(doc_id), k, heading, text


@F.udtf(returnType="claim_ord int, text string, cites array<int>, partial boolean")
class SplitClaims:
    """A row for each claim of a text: split_claims(text)."""

    def eval(self, text: str):
        for k, (claim, marks, partial) in enumerate(split_claims(text)):
            yield k, claim, marks, partial


@F.udtf(returnType="answer_id bigint, claim_ord int, text string, cites array<int>, partial boolean")
class AnswerClaims:
    """The claims of answers that come in pieces, a table argument of (answer_id, ord, text, done): PARTITION BY answer_id ORDER BY ord.

    An answer that has not ended yet has a last claim that is partial, unless it has ended its sentence.
    """

    def __init__(self):
        self.answer, self.pieces, self.done = None, [], False

    def eval(self, row: Row):
        self.answer = row["answer_id"]
        self.pieces.append(row["text"] or "")
        self.done = self.done or bool(row["done"])

    def terminate(self):
        for k, (claim, marks, partial) in enumerate(split_claims("".join(self.pieces), self.done)):
            yield self.answer, k, claim, marks, partial


def register(spark: SparkSession) -> list[str]:
    """Registers chunk_document(title, body) and split_claims(text) as vectorised functions, fnv1a and dot as SQL functions, and as
    table functions chunk_document(doc_id, title, body), split_claims(text) and answer_claims(TABLE(...) PARTITION BY ...)."""

    @F.pandas_udf("array<struct<heading string, text string>>")
    def chunk_document(titles: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([[{"heading": h, "text": t} for h, t in chunk_text(a, b)] for a, b in zip(titles, bodies, strict=True)])

    @F.pandas_udf(CLAIMS)
    def claims(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: [{"claim_ord": i, "text": t, "cites": c, "partial": p} for i, (t, c, p) in enumerate(split_claims(x))])

    spark.udf.register("chunk_document", chunk_document)
    spark.udf.register("split_claims", claims)
    spark.udtf.register("chunk_document", ChunkDocument)
    spark.udtf.register("split_claims", SplitClaims)
    spark.udtf.register("answer_claims", AnswerClaims)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION fnv1a(t STRING) RETURNS BIGINT RETURN aggregate(filter(split(t, ''), c -> c <> ''), 2166136261L, (h, c) -> ((h ^ CAST(ascii(c) AS BIGINT)) * 16777619L) % 4294967296L)"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)")
    return ["chunk_document", "split_claims", "fnv1a", "dot", "answer_claims"]
