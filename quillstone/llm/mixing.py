"""Mixing sources to target weights: capped water-filling over sources, whole and seeded fractional repetitions (native)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.ordering import numbered
from .common import WORD, stored, table

#: Sources go to every task up to this count, beyond it they are joined by a salted shuffle.
BROADCAST_SOURCES = 10_000
SALTS = 64
#: Bits of a draw, of one digit of it, and how many digits are counted before single documents are looked at.
DRAW, DIGIT, LEVELS = 60, 10, 2


@dataclass(frozen=True)
class Mix:
    """Weights go to the sources in code point order, null last, and repeat; no document is taken more than ``epochs`` times."""

    weights: tuple[int, ...] = (5, 2, 1)
    epochs: int = 3
    seed: str = "mix"

    def __post_init__(self):
        if not self.weights or min(self.weights) < 1 or self.epochs < 1:
            raise ValueError("weights and epochs are whole numbers from 1")


def with_sizes(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with size (words of the whole text, null: 0) and _draw, 60 bits that the seed, the id and the text decide."""
    said = F.coalesce(F.col(text_col), F.lit(""))
    seeded = F.concat_ws(":", F.lit(mix.seed), F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.md5(said))
    draw = F.conv(F.substring(F.md5(seeded), 1, DRAW // 4), 16, 10).cast("long")
    return docs.withColumn("size", F.regexp_count(said, F.lit(WORD)).cast("long")).withColumn("_draw", draw)


def source_targets(sized: DataFrame, mix: Mix = Mix(), source_col: str = "source") -> DataFrame:
    """_source, source_size, target (double), _want (the target's whole words): a stored row for each source.

    A source's share of all words is by weight, but at most epochs times its size. Each round clamps the sources whose share is above
    that and deals what is left to the others by weight, until a round clamps none. A round is one exact sum over the sources.
    """
    sums = sized.groupBy(F.col(source_col).alias("_source")).agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.lit(list(mix.weights)), (F.col("_i") % len(mix.weights) + 1).cast("int")).cast("long")
    sources = stored(numbered(sums, [F.asc_nulls_last("_source")], "_i").select("_source", "source_size", weight.alias("_weight")), "sources")
    exact = "CAST({} AS DECIMAL(19, 0))".format
    cap = f"{exact('source_size')} * {mix.epochs}"
    total, live = sources.agg(F.sum("source_size"), F.sum("_weight")).first()
    rest, total, live, clamped = total or 0, total or 0, live or 1, 0
    while True:
        above = f"{cap} * {exact(live)} < {exact(rest)} * _weight"
        n, held, free = sources.agg(F.count_if(F.expr(above)), F.expr(f"sum(CASE WHEN {above} THEN source_size * {mix.epochs} END)"), F.expr(f"sum(CASE WHEN NOT ({above}) THEN _weight END)")).first()
        if n == clamped or not free:
            break
        rest, live, clamped = total - held, free, n
    above = F.expr(above)
    whole = F.expr(f"({exact(rest)} * _weight) div {exact(live)}")
    share = F.lit(float(rest)) * F.col("_weight") / F.lit(float(live))
    top = F.col("source_size") * mix.epochs
    out = sources.select("_source", "source_size", F.when(above, top.cast("double")).otherwise(share).alias("target"), F.when(above, top).otherwise(whole).alias("_want"))
    return stored(out, "targets")


def meet(sized: DataFrame, sources: DataFrame, source_col: str, few: bool) -> DataFrame:
    """Each document beside its source's row: sources by broadcast while they are few, else by a join in which a hot source has many keys."""
    same = F.col(source_col).eqNullSafe(F.col("_source"))
    if few:
        return sized.join(F.broadcast(sources), same).drop("_source")
    dealt = sources.withColumn("_salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    return sized.withColumn("_own", F.pmod("_draw", F.lit(SALTS))).join(dealt, same & (F.col("_own") == F.col("_salt"))).drop("_source", "_own", "_salt")


def with_thresholds(sized: DataFrame, targets: DataFrame, source_col: str, few: bool) -> DataFrame:
    """targets with _repeats, the whole repetitions, and _least: documents whose draw is at most this are taken once more.

    Documents of a source in order of their draws are taken while half of the next still fits into the words that are missing. No
    source is sorted: digits of the draws are counted, which leaves the one span of draws that the missing words end in, and then
    the digits inside it; only the draws of the last span are looked at one by one.
    """
    spans = targets.selectExpr(
        "*", "_want div greatest(source_size, 1) AS _repeats", "_want % greatest(source_size, 1) AS _extra", "0L AS _span", "0L AS _before",
    )
    keep = ["_source", "source_size", "target", "_repeats", "_extra"]
    shift = DRAW
    for _ in range(LEVELS):
        inside = meet(sized, spans, source_col, few).where(F.shiftright("_draw", shift) == F.col("_span"))
        shift -= DIGIT
        counted = inside.groupBy(F.col(source_col).alias("_source"), F.shiftright("_draw", shift).alias("_digit")).agg(F.sum("size").alias("_words"), F.first("_before").alias("_b"), F.first("_extra").alias("_e"))
        upto = counted.withColumn("_upto", F.col("_b") + F.sum("_words").over(W.partitionBy("_source").orderBy("_digit")))
        ends = upto.where("_upto > _e").groupBy("_source").agg(F.min(F.struct("_digit", (F.col("_upto") - F.col("_words")).alias("_before"))).alias("_end"))
        at = spans.select(*keep).join(ends.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left")
        # a source without words ends nowhere: a span that no draw has
        spans = stored(at.select(*keep, F.coalesce("_end._digit", F.lit(-1)).alias("_span"), F.coalesce("_end._before", F.lit(0)).alias("_before")), "spans")
    inside = meet(sized, spans, source_col, few).where(F.shiftright("_draw", shift) == F.col("_span"))
    units = inside.groupBy(F.col(source_col).alias("_source"), "_draw").agg(F.sum("size").alias("_words"), F.first("_before").alias("_b"), F.first("_extra").alias("_e"))
    upto = units.withColumn("_upto", F.col("_b") + F.sum("_words").over(W.partitionBy("_source").orderBy("_draw")))
    last = upto.where("2 * _upto - _words <= 2 * _e").groupBy(F.col("_source").alias("_s")).agg(F.max("_draw").alias("_last"))
    ended = spans.join(last, F.col("_source").eqNullSafe(F.col("_s")), "left")
    return stored(ended.select("_source", "source_size", "target", "_repeats", F.coalesce("_last", F.shiftleft("_span", shift) - 1).alias("_least")), "thresholds")


def mix_sources(sized: DataFrame, mix: Mix = Mix(), source_col: str = "source") -> DataFrame:
    """``sized`` (of with_sizes; read several times, so store it where sizes are dear) with source_size, target, repeats and taken.

    repeats: how often the mix takes the document, 0 to epochs; taken: size times that. The words taken of a source miss its target
    by half of one document at most, or by half of all rows that share id and text, which go together. Null sources are one source,
    the last; empty and null texts have size 0 and are taken for nothing; a table without words has targets of 0; repeated rows stay
    repeated. Columns of the same names are replaced. The seed decides the choice, so reruns agree.
    """
    sized = sized.drop("source_size", "target", "repeats", "taken")
    targets = source_targets(sized, mix, source_col)
    few = targets.count() <= BROADCAST_SOURCES
    shares = with_thresholds(sized, targets, source_col, few)
    met = meet(sized, shares, source_col, few).withColumn("repeats", (F.col("_repeats") + (F.col("_draw") <= F.col("_least")).cast("int")).cast("int"))
    return met.withColumn("repeats", F.when(F.col("size") > 0, F.col("repeats")).otherwise(0)).withColumn("taken", F.col("size") * F.col("repeats")).drop("_draw", "_repeats", "_least")


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of mix_sources as often as it is taken, with repetition from 1."""
    return mixed.where("repeats > 0").withColumn("repetition", F.explode(F.sequence(F.lit(1), F.col("repeats"))))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under weights 5, 2, 1 and three epochs; sizes and draws are stored once, texts are read once."""
    sized = stored(with_sizes(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text"), "sized")
    return mix_sources(sized).select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS draw
  FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, (SELECT sum(source_size) FROM s) AS total FROM s),
o AS (
  SELECT *, total - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS live
  FROM w),
f AS (SELECT rest, live FROM o WHERE 3 * source_size * live >= rest * weight ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
g AS (
  SELECT source, source_size, CASE WHEN above THEN 3 * source_size ELSE rest * weight // live END AS want,
    CASE WHEN above THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(rest AS DOUBLE) * weight / live END AS target
  FROM (SELECT w.source, w.source_size, w.weight, f.rest, f.live, 3 * w.source_size * f.live < f.rest * w.weight AS above FROM w, f)),
u AS (SELECT source, draw, sum(size) AS size FROM d GROUP BY source, draw),
t AS (
  SELECT u.source, u.draw, 2 * sum(u.size) OVER (PARTITION BY u.source ORDER BY u.draw) - u.size <= 2 * (CASE WHEN source_size > 0 THEN want % source_size ELSE 0 END) AS more
  FROM u JOIN g ON u.source IS NOT DISTINCT FROM g.source)
SELECT d.doc_id, d.size, CAST(g.source_size AS BIGINT) AS source_size, g.target, d.source,
  CAST(CASE WHEN d.size > 0 THEN g.want // g.source_size + CAST(t.more AS INTEGER) ELSE 0 END AS INTEGER) AS repeats, d.size * repeats AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source JOIN t ON t.source IS NOT DISTINCT FROM d.source AND t.draw = d.draw
"""
