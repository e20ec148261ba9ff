"""Places in a global order, or in that of each group, without a task that holds all rows of an order or of a group."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.scratch import stored


def ranged(rows: DataFrame, order: list, parts: int | None = None) -> DataFrame:
    """rows dealt into ranges of the order and written, with _part, the number of the range: all rows of a smaller one come first.

    Rows that tie in the order are spread by a hash of the whole row, so a hot tie has no task of its own; only rows that are alike
    in every column stay together. The written table fixes the ranges: whatever reads it again, after a lost executor too, sees the same.
    """
    tie = F.xxhash64(*[F.col(f"`{c}`") if not kind.startswith(("map", "variant")) else F.lit(0) for c, kind in rows.dtypes])
    keys = [*order, "_tie"]
    tied = rows.withColumn("_tie", tie)
    dealt = tied.repartitionByRange(parts, *keys) if parts else tied.repartitionByRange(*keys)
    return stored(dealt.withColumn("_part", F.spark_partition_id()), "ranged")


def numbered(rows: DataFrame, order: list[str | Column], name: str = "place", parts: int | None = None) -> DataFrame:
    """rows with their place from 0 in the whole order, a long. Nulls come where the order's columns put them, ties in an order
    that stays the same for the same rows; no rows, no places.

    Ranges are counted, their counts summed up on the driver (one number for each range), and each range numbers its own rows.
    """
    dealt = ranged(rows, order, parts)
    counts = dict(dealt.groupBy("_part").count().collect())
    most = max(counts, default=0)
    before = [0, *accumulate(counts.get(p, 0) for p in range(most + 1))]
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order, "_tie"))
    return dealt.withColumn(name, F.get(F.lit(before), F.col("_part")).cast("long") + own - 1).drop("_part", "_tie")


def numbered_within(rows: DataFrame, by: list[str], order: list[str | Column], name: str = "place", size: str | None = None, parts: int | None = None) -> DataFrame:
    """rows with their place from 0 within their group (null is a group), and if asked the group's size.

    A group that is larger than a range lies in several; its counts by range are summed up for each group, so a hot group is
    numbered by as many tasks as it has ranges.
    """
    dealt = ranged(rows, [*by, *order], parts)
    counts = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    w = W.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = counts.select(*[F.col(f"`{c}`").alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_at"), before.alias("_before"), F.sum("_n").over(w).alias("_size"))
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    met = dealt.join(sums, [F.col("_part") == F.col("_at"), *same])
    own = F.row_number().over(W.partitionBy("_part", *by).orderBy(*order, "_tie"))
    out = met.withColumn(name, (F.col("_before") + own - 1).cast("long"))
    return (out.withColumn(size, F.col("_size")) if size else out).drop("_part", "_tie", "_at", "_before", "_size", *[f"_by{i}" for i in range(len(by))])
