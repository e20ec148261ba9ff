"""A lexical index on shared storage: segments with tombstones, postings in blocks with bounds, search that skips blocks."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..plans.config import SearchConfig
from ..sources.manifest import Manifest
from ..sources.scratch import stored
from .lexical import ranked, with_term_counts
from .ordering import numbered

#: Documents of a range. A block has the postings of one term in one range. Ranges that one task makes blocks of, about.
RANGE, TOGETHER = 512, 16
#: So few ranges are scored without a look at bounds; ranges that are scored first, to learn what the k-th score is at least; ranges
#: that are named to the reader one by one.
FEW, FIRST, NAMED = 64, 8, 1000


@dataclass
class StoredIndex:
    """An index at ``path``: what the last state of its manifest names.

    A segment has four tables. ``docs``: key, ord, len, range, content, terms, tfs. ``blocks``: term, range, n, most_tf, least_len and
    the postings as arrays; a file has whole ranges, sorted by term and range, so that a reader skips the pages of other terms. ``counts``: term, df, with
    negative rows for documents that the segment takes out of older ones. ``gone``: seg, range, key of these.
    Ranges are made in the order of length: documents of a range are alike in length, which keeps the bounds of blocks low.
    The state: segments, n and length (live documents and their tokens), ranges, applied (the number of the last batch).
    """

    spark: SparkSession
    path: str
    key_type: str = "long"

    def __post_init__(self):
        self.path = self.path.rstrip("/")
        self.manifest = Manifest(self.spark, f"{self.path}/manifest")
        self.refresh()

    def refresh(self) -> StoredIndex:
        """Takes the last committed state."""
        self.number, self.state = self.manifest.last()
        self.state = self.state or {"segments": [], "n": 0, "length": 0, "ranges": 0, "applied": None}
        self._tables: dict = {}
        return self

    # Tables

    def schema(self, name: str) -> str:
        k = self.key_type
        return {
            "docs": f"seg int, range long, key {k}, ord long, len long, content string, terms array<string>, tfs array<long>",
            "blocks": f"seg int, term string, range long, n long, most_tf long, least_len long, keys array<{k}>, ords array<long>, tfs array<long>, lens array<long>",
            "counts": "term string, df long",
            "gone": f"seg int, range long, key {k}",
        }[name]

    def table(self, name: str) -> DataFrame:
        """Over all segments of the state."""
        if name not in self._tables:
            paths = [f"{self.path}/seg-{s}/{name}" for s in self.state["segments"]]
            self._tables[name] = self.spark.read.schema(self.schema(name)).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema(name))
        return self._tables[name]

    def live_docs(self) -> DataFrame:
        return self.table("docs").join(self.table("gone"), ["seg", "range", "key"], "left_anti")

    def postings(self) -> DataFrame:
        """seg, range, key, ord, len, term, tf of live documents."""
        rows = self.table("blocks").select("seg", "range", "term", F.explode(F.arrays_zip("keys", "ords", "tfs", "lens")).alias("p"))
        flat = rows.select("seg", "range", F.col("p.keys").alias("key"), F.col("p.ords").alias("ord"), F.col("p.lens").alias("len"), "term", F.col("p.tfs").alias("tf"))
        return flat.join(self.table("gone"), ["seg", "range", "key"], "left_anti")

    def frequencies(self) -> DataFrame:
        """term, df of live documents: sums of what segments have put in and taken out."""
        return self.table("counts").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def stats(self) -> DataFrame:
        n, length = self.state["n"], self.state["length"]
        return self.spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(length / n if n else 0.0).alias("avg_len"))

    # Writing

    def apply(self, batch: DataFrame, number: int, key_col="key", ord_col="ord", text_col="text", deleted_col: str | None = None, version_col: str | None = None) -> bool:
        """Puts a batch of new, changed and deleted documents in as one segment; whether anything was written.

        Of rows of one key that with the largest version counts (of equal ones, or without versions, any, the same each time). A
        document that stands in the index under its key is taken out, one that has not changed stays as it is. A null text is
        empty, a null key has no document and is passed over. A batch whose number is not above the last applied one has been
        applied before and changes nothing, and what a writer left that died before its commit is overwritten.
        """
        if self.state["applied"] is not None and number <= self.state["applied"]:
            return False
        seg = max(self.state["segments"], default=-1) + 1
        text = F.coalesce(F.col(text_col), F.lit(""))
        dead = F.coalesce(F.col(deleted_col), F.lit(False)) if deleted_col else F.lit(False)
        rows = batch.select(
            F.col(key_col).cast(self.key_type).alias("key"), F.col(ord_col).cast("long").alias("ord"), F.sha2(text, 256).alias("content"), tokenize(F.when(~dead, text).otherwise("")).alias("w"),
            dead.alias("deleted"), (F.col(version_col) if version_col else F.lit(0)).alias("version"),
        ).where("key IS NOT NULL")
        # the batch is read once and written with its words counted; what follows shuffles short rows, and once the terms of those that go in
        read = stored(with_term_counts(rows.withColumn("len", F.size("w").cast("long"))).withColumn("_row", F.monotonically_increasing_id()), "batch", compression="zstd")
        newest = F.max(F.struct("version", "deleted", "content", "ord", "len", "_row")).alias("_r")  # combined before the shuffle: no hot key
        latest = read.groupBy("key").agg(newest).select("key", "_r.ord", "_r.len", "_r.content", "_r.deleted", "_r._row")
        old = self.live_docs().select("key", F.col("seg").alias("_seg"), F.col("range").alias("_range"), F.col("len").alias("_len"), F.col("ord").alias("_ord"), F.col("content").alias("_content"))
        same = F.coalesce((F.col("content") == F.col("_content")) & F.col("ord").eqNullSafe(F.col("_ord")) & ~F.col("deleted"), F.lit(False))
        met = stored(latest.join(old, "key", "left").where(~same), "met")
        taken = met.where("_seg IS NOT NULL")
        fresh = met.where("NOT deleted")
        n, length = fresh.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        placed = numbered(fresh.select("key", "len", "_row"), ["len", "key"]).select("_row", F.expr(f"place div {RANGE}").alias("range"))
        docs = read.join(placed, "_row").select(F.lit(seg).alias("seg"), "range", "key", "ord", "len", "content", "terms", "tfs")
        out = taken.select(F.col("_seg").alias("seg"), F.col("_range").alias("range"), "key")
        less = self.table("docs").join(out, ["seg", "range", "key"], "left_semi").select(F.explode("terms").alias("term"), F.lit(-1).cast("long").alias("df"))
        self._write(seg, docs, -(-n // RANGE), less, out)
        gone, lost = taken.agg(F.count("*"), F.coalesce(F.sum("_len"), F.lit(0))).first()
        segments = self.state["segments"] + ([seg] if n or gone else [])
        counts = {"n": self.state["n"] + n - gone, "length": self.state["length"] + length - lost, "ranges": self.state["ranges"] + -(-n // RANGE)}
        self._commit({"segments": segments, **counts, "applied": number})
        return bool(n or gone)

    def compact(self) -> None:
        """One segment of all live documents, without tombstones, in place of all segments; readers keep the state they have."""
        if len(self.state["segments"]) < 2 and self.table("gone").isEmpty():
            return
        seg = max(self.state["segments"]) + 1
        docs = self.live_docs()
        placed = stored(numbered(docs.select("seg", "range", "key", "len"), ["len", "key"]).select("seg", "range", "key", F.expr(f"place div {RANGE}").alias("_range")), "placed")
        old = ["seg", "range", "key"]
        moved = docs.join(placed, old).select(F.lit(seg).alias("seg"), F.col("_range").alias("range"), "key", "ord", "len", "content", "terms", "tfs")
        self._write(seg, moved, -(-self.state["n"] // RANGE), self.spark.createDataFrame([], self.schema("counts")), self.spark.createDataFrame([], self.schema("gone")))
        self._commit(self.state | {"segments": [seg], "ranges": -(-self.state["n"] // RANGE)})

    def vacuum(self) -> list[str]:
        """Deletes the segments that the last state does not name; to be called when no reader uses an older one."""
        self.refresh()
        named = {f"seg-{s}" for s in self.state["segments"]}
        left = [x for x in self.manifest.folders(self.path) if x.startswith("seg-") and x not in named]
        for x in left:
            self.manifest.delete(f"{self.path}/{x}")
        return left

    def _write(self, seg: int, docs: DataFrame, ranges: int, less: DataFrame, gone: DataFrame) -> None:
        """A document's terms are shuffled once, as arrays, to the task of its range, which makes the blocks of its ranges: a file of them."""
        at = f"{self.path}/seg-{seg}"
        docs.write.mode("overwrite").option("compression", "zstd").parquet(f"{at}/docs")
        lying = self.spark.read.schema(self.schema("docs")).parquet(f"{at}/docs").select("range", "key", "ord", "len", "terms", "tfs").repartition(max(1, -(-ranges // TOGETHER)), "range")
        counted = lying.select("range", "key", "ord", "len", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("range", "key", "ord", "len", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
        p = F.array_sort(F.collect_list(F.struct("ord", "key", "tf", "len")))
        blocks = counted.groupBy("term", "range").agg(F.count("*").alias("n"), F.max("tf").alias("most_tf"), F.min("len").alias("least_len"), p.alias("_p"))
        flat = blocks.select(
            F.lit(seg).alias("seg"), "term", "range", "n", "most_tf", "least_len", F.col("_p.key").alias("keys"), F.col("_p.ord").alias("ords"), F.col("_p.tf").alias("tfs"), F.col("_p.len").alias("lens"),
        )
        flat.sortWithinPartitions("term", "range").write.mode("overwrite").option("compression", "zstd").parquet(f"{at}/blocks")
        written = self.spark.read.schema(self.schema("blocks")).parquet(f"{at}/blocks")
        df = written.select("term", F.col("n").alias("df")).unionByName(less).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        df.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{at}/counts")
        gone.write.mode("overwrite").parquet(f"{at}/gone")

    def _commit(self, state: dict) -> None:
        self.manifest.commit(self.number, state)
        self.refresh()

    # Reading

    def search(self, query: str, k: int = 10, k1: float = SearchConfig.k1, b: float = SearchConfig.b) -> DataFrame:
        """key, ord, score, rank of the k best live documents; the same as bm25_search over all of them.

        The bound of a range is the sum over the query's terms of what their blocks can score there at most. The ranges with the
        largest bounds are scored first; the k-th score of these is one that a range must be able to reach, or it is not read. Past
        NAMED ranges that can, the reader is not told which, and blocks are dropped behind it.
        """
        n, asked = self.state["n"], self._terms(query)
        of = lambda name, terms: self.table(name).where(F.col("term").isin(list(terms)))
        df: dict[str, int] = {}
        for t, x in of("counts", asked).select("term", "df").collect() if asked and n else []:  # a row for each segment and term at most
            df[t] = df.get(t, 0) + x
        idf = {t: asked[t] * _idf(n, x) for t, x in df.items() if x > 0}
        self.read = {"ranges": self.state["ranges"], "scored": self.state["ranges"]}
        hit = f"key {self.key_type}, ord long, score double"
        if not idf:
            return ranked(self.spark.createDataFrame([], hit), k)
        avg = self.state["length"] / n
        weight = reduce(lambda x, t: x.when(F.col("term") == t, idf[t]), idf, F).otherwise(0.0)
        blocks = of("blocks", idf)
        score = lambda rows: self._scored(rows, weight, avg, k1, b)
        if self.state["ranges"] <= FEW:
            return ranked(score(blocks), k)
        each = blocks.select("seg", "range", (weight * _weight(F.col("most_tf"), F.col("least_len"), avg, k1, b)).alias("bound"))
        bounds = each.groupBy("seg", "range").agg(F.sum("bound").alias("bound"))
        if self.state["ranges"] <= NAMED:  # so few that they are summed here
            sums: dict = {}
            for seg, at, x in each.collect():
                sums[seg, at] = sums.get((seg, at), 0.0) + x
            best = sorted(((x, *at) for at, x in sums.items()), key=lambda r: (-r[0], r[1:]))
        else:
            best = [(r["bound"], r["seg"], r["range"]) for r in bounds.orderBy(F.desc("bound"), "seg", "range").limit(NAMED + 1).collect()]
        first, rest = best[:FIRST], best[FIRST:]
        # a few blocks: one task adds them up without a shuffle
        tops = score(_named(blocks, first).coalesce(1)).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "ord").limit(k).toArrow()
        least = tops["score"][k - 1].as_py() - 1e-5 if len(tops) == k else None  # scores are rounded
        able = [r for r in rest if least is None or r[0] >= least]
        self.read = {"ranges": len(best), "scored": len(first) + len(able)}
        known = self.spark.createDataFrame(tops, hit)
        if not able:
            return ranked(known, k)
        if len(best) > NAMED and len(able) == len(rest):
            more = bounds if least is None else bounds.where(F.col("bound") >= least)
            return ranked(score(blocks.join(more.select("seg", "range"), ["seg", "range"], "left_semi")), k)
        return ranked(known.unionByName(score(_named(blocks, able))), k)

    def _terms(self, query: str) -> dict[str, int]:
        # VALUES is folded by the optimizer: no job runs
        words = self.spark.sql("SELECT q FROM VALUES (:q) AS t(q)", {"q": query}).select(tokenize("q")).first()[0]
        return {t: words.count(t) for t in words}

    def _scored(self, blocks: DataFrame, weight: Column, avg: float, k1: float, b: float) -> DataFrame:
        rows = blocks.select("seg", "range", weight.alias("_w"), F.explode(F.arrays_zip("keys", "ords", "tfs", "lens")).alias("p"))
        each = rows.select("seg", "range", F.col("p.keys").alias("key"), F.col("p.ords").alias("ord"), (F.col("_w") * _weight(F.col("p.tfs"), F.col("p.lens"), avg, k1, b)).alias("s"))
        sums = each.groupBy("seg", "range", "key", "ord").agg(F.sum("s").alias("score"))
        if len(self.state["segments"]) > 1:  # a lone segment has taken nothing out of another
            sums = sums.join(self.table("gone"), ["seg", "range", "key"], "left_anti")
        return sums.select("key", "ord", "score")


def _idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def _weight(tf: Column, length: Column, avg: float, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(avg)))


def _named(blocks: DataFrame, ranges: list) -> DataFrame:
    """The blocks of the ranges, as a filter that the reader can hold against the bounds of its pages."""
    by: dict = {}
    for _, seg, at in ranges:
        by.setdefault(seg, []).append(at)
    return blocks.where(reduce(lambda x, y: x | y, [(F.col("seg") == s) & F.col("range").isin(x) for s, x in by.items()]))


def index_stream(changes: DataFrame, index: StoredIndex, checkpoint: str, **columns):
    """A streaming query that applies each batch of changes as a segment. A batch that runs again after a restart changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        index.refresh().apply(batch, number, **columns)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
