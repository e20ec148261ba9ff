"""Route prototypes under edits: exact sums of exemplars that can be added to and taken from, and routes that are stale meanwhile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import norm

#: Components are summed as whole numbers of this unit's inverse, so that sums are exact and taking out undoes putting in.
UNIT = float(2**40)


def exemplar_sums(exemplars: DataFrame, route_col: str = "route", vec_col: str = "embedding", sign: int = 1) -> DataFrame:
    """route, pos, n, total: for each component of a route's exemplars (of components between -1 and 1) how many there are and their sum.

    Counts and partial sums cross the shuffle, not vectors. Exemplars without a route or a vector are none.
    """
    rows = exemplars.where(F.col(route_col).isNotNull()).select(F.col(route_col).alias("route"), F.posexplode(vec_col).alias("pos", "x"))
    return rows.groupBy("route", "pos").agg((F.count("*") * sign).alias("n"), (F.sum(F.round(F.col("x").cast("double") * UNIT).cast("long")) * sign).alias("total"))


def merge_sums(*sums: DataFrame) -> DataFrame:
    """The sums of all; routes that no exemplar is left of go."""
    both = reduce(DataFrame.unionByName, sums)
    return both.groupBy("route", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0")


def edited(sums: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """The sums after exemplars (route, embedding) were added and removed. Only these are read: no other exemplar is embedded again."""
    parts = [sums] + ([exemplar_sums(added)] if added is not None else []) + ([exemplar_sums(removed, sign=-1)] if removed is not None else [])
    return merge_sums(*parts)


def prototypes(routes: DataFrame, sums: DataFrame) -> DataFrame:
    """route, label, gate, ord, embedding of routes that have exemplars: the direction of their sum. Labels, gates and order are the
    routes' own: a toggled gate needs no new sums."""
    whole = sums.groupBy("route").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "total"))), lambda s: s["total"] / F.lit(UNIT)).alias("_v"))
    n = norm("_v")
    unit = F.transform("_v", lambda x: F.when(n == 0, x).otherwise(x / n))
    return routes.select("route", "label", "gate", "ord").join(whole, "route").select("route", "label", "gate", "ord", unit.alias("embedding"))


def mark_stale(protos: DataFrame, touched: DataFrame) -> DataFrame:
    """Prototypes in which the routes of ``touched`` (route) have no embedding until they are rebuilt: classify passes them over."""
    marks = touched.select("route").distinct().withColumn("_stale", F.lit(True))
    out = protos.join(marks, "route", "left")
    return out.withColumn("stale", F.coalesce("_stale", F.lit(False))).withColumn("embedding", F.when(~F.col("stale"), F.col("embedding"))).drop("_stale")
