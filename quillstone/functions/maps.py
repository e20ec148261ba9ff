"""JSON texts in one form, and maps as counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col


def canonical_json(c: Column | str) -> Column:
    """The text of a JSON value with keys in order and without blanks, so that equal values are equal texts; null where it is none."""
    return F.to_json(F.try_parse_json(col(c)))


def same_json(a: Column | str, b: Column | str) -> Column:
    """Whether two texts hold the same JSON value, whatever the order of keys; texts that are no JSON are only like themselves."""
    return F.coalesce(canonical_json(a), col(a)).eqNullSafe(F.coalesce(canonical_json(b), col(b)))


def counters(rows: DataFrame, by: list[str], key: Column) -> DataFrame:
    """by, counts: a map from each value of ``key`` to how often it stands in the group, keys in order; null keys are not counted.

    Counts are made before the groups meet, so a row of a map is as large as its group has keys, not rows.
    """
    each = rows.select(*by, key.cast("string").alias("_k")).where("_k IS NOT NULL").groupBy(*by, "_k").agg(F.count("*").alias("_n"))
    return each.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_n")))).alias("counts"))


def merged_counters(a: Column | str, b: Column | str) -> Column:
    """The sum of two counters."""
    none = F.expr("CAST(map() AS map<string, bigint>)")
    x, y = F.coalesce(col(a), none), F.coalesce(col(b), none)
    return F.map_zip_with(x, y, lambda k, p, q: F.coalesce(p, F.lit(0)) + F.coalesce(q, F.lit(0)))
