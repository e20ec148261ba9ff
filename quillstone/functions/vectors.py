"""Vector and hashing functions as Column expressions over arrays; all arithmetic in double."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(a: Column | str) -> Column:
    """A zero vector stays zero."""
    n = norm(a)
    return F.transform(col(a), lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))


def largest(a: Column | str) -> Column:
    return F.array_max(F.transform(col(a), lambda x: F.abs(x.cast("double"))))


def quantize(a: Column | str) -> Column:
    """struct<codes array<tinyint>, scale float>: codes round half up from -127 to 127, the scale is the largest magnitude; zeros give zeros."""
    top = largest(a)
    gain = F.lit(127.0) / top
    codes = F.transform(col(a), lambda x: F.when(top == 0, 0).otherwise(F.floor(x.cast("double") * gain + 0.5)).cast("tinyint"))
    return F.struct(codes.alias("codes"), top.cast("float").alias("scale"))


def dot_q8(a: Column | str, sa: Column | str, b: Column | str, sb: Column | str) -> Column:
    codes = F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return codes.cast("double") * col(sa).cast("double") * col(sb).cast("double") / F.lit(127.0 * 127.0)


def fnv1a(text: Column | str) -> Column:
    """32-bit FNV-1a over the characters of a text (basic multilingual plane), as long."""
    chars = F.filter(F.split(col(text), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, c: h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619).cast("long") % F.lit(4294967296).cast("long"))


def softmax(a: Column | str) -> Column:
    top = F.array_max(col(a)).cast("double")
    e = F.transform(col(a), lambda x: F.exp(x.cast("double") - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def sigmoid(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x).cast("double")))


def apply_homography(h: Column | str, x: Column | str, y: Column | str) -> Column:
    """struct<x, y> of a point under a 3 x 3 matrix given as 9 numbers by rows."""
    at = lambda i: F.get(col(h), i)
    row = lambda i: at(i) * col(x) + at(i + 1) * col(y) + at(i + 2)
    return F.struct((row(0) / row(6)).alias("x"), (row(3) / row(6)).alias("y"))


def verdict(entailment: Column | str, contradiction: Column | str, claim: Column | str, least: float = 0.5) -> Column:
    """supported, contradicted or uncertain; unverified without scores or for claims under 12 characters."""
    e, c = col(entailment), col(contradiction)
    return (
        F.when(e.isNull() | col(claim).isNull() | (F.length(col(claim)) < 12), "unverified").when(e >= least, "supported")
        .when(c > 0.5, "contradicted").otherwise("uncertain")
    )


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
