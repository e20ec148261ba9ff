"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, table

#: Items up to this many sketch rows are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Sketch hashes of small size partitions that are named one by one; those of all others only have a cut-off.
LISTED = 2000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _hashes(k: int) -> str:
    """SQL: a 64-bit hash for each window of k words of ``_w``, from one hash for each word; repeated windows stay."""
    parts = ", ".join(f"get(_wh, i + {j})" for j in range(k))
    return f"transform(array(transform(_w, w -> xxhash64(w))), _wh -> if(size(_wh) < {k}, cast(array() as array<bigint>), transform(sequence(0, size(_wh) - {k}), i -> xxhash64({parts}))))[0]"


def item_sketches(items: DataFrame, id_col: str, text_col: str, k: int, threshold: float) -> DataFrame:
    """Bottom-m MinHash sketches of the items: _item, _n, _shingles, _hash, _part.

    An item of n shingles keeps the m = n - ceil(threshold * n) + 1 smallest hashes. A text that holds at least
    ceil(threshold * n) of its shingles misses at most m - 1, so it holds one of the m: no item is lost. m
    depends on n alone; _part is n's power of two and has its own cut-off, the largest hash that its sketches keep.
    """
    worded = items.select(F.col(id_col).alias("_item"), words_of(F.col(text_col)).alias("_w")).where(F.size("_w") >= k)
    sized = worded.select("_item", F.array_sort(F.array_distinct(F.expr(_hashes(k)))).alias("_shingles"))
    sized = sized.withColumn("_n", F.size("_shingles")).withColumn("_m", F.col("_n") - F.ceil(F.lit(threshold) * F.col("_n") - 1e-9) + 1)
    return sized.select("_item", "_n", "_shingles", F.floor(F.log2("_n")).cast("int").alias("_part"), F.explode(F.expr("slice(_shingles, 1, cast(_m as int))")).alias("_hash"))


def find_contained(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_id_col="item_id", item_text_col="text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row (id, item id, n_shingles, n_shared, containment) for each document and item with containment >= threshold.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, shingles are sets of k words.
    containment = shared shingles / the item's shingles, counted over all of them, each known by a 64-bit hash. Items with fewer than k
    words have no shingles and match nothing; so do null and empty texts. Repeated rows of a document or an item
    give one row for each pair of ids (the largest containment). Extra columns are ignored.

    Plan: each document row becomes its window hashes. Those stay that are at or below the largest cut-off of the size partitions
    whose items a text of its size can hold, or are named: the LISTED hashes at most of small partitions with high cut-offs. They
    meet the sketches in a hash join, and a match is verified within its row. With at most BROADCAST_ROWS
    sketch rows (counted first) documents are never shuffled; with more, the hashes are, and the candidate pairs
    fetch their texts by id.
    """
    spark = docs.sparkSession
    sketches = item_sketches(items, item_id_col, item_text_col, k, threshold)
    parts = sketches.groupBy("_part").agg(F.max("_hash").alias("cut"), F.count("*").alias("n")).collect()  # one row for each power of two
    # a text below the smallest size that a partition needs cannot hold one of its items
    needs = lambda part: max(1, int(threshold * 2**part))
    least = min((needs(r["_part"]) for r in parts), default=1)
    small = sum(r["n"] for r in parts) <= BROADCAST_ROWS
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_t")).where(F.length("_t") >= 2 * k - 1)
    worded = rows.select("_doc", words_of(F.col("_t")).alias("_w")).where(F.size("_w") >= k + least - 1)
    hashed = worded.select("_doc", F.expr(_hashes(k)).alias("_hs"))
    # partitions with the highest cut-offs, of tiny items mostly, are listed while they are small, so that they don't lift the cut for all
    listed, left = [], LISTED
    for r in sorted(parts, key=lambda r: -r["cut"]):
        if r["n"] > left:
            break
        listed.append(r["_part"])
        left -= r["n"]
    named = [r["_hash"] for r in sketches.where(F.col("_part").isin(listed)).select("_hash").distinct().collect()] if listed else []
    cut, size = F.lit(None).cast("long"), F.size("_hs")
    for need in sorted({needs(r["_part"]) for r in parts if r["_part"] not in listed}):
        most = max(r["cut"] for r in parts if r["_part"] not in listed and needs(r["_part"]) <= need)
        cut = F.when(size >= need, F.lit(most)).otherwise(cut)
    kept = lambda h: F.coalesce(h <= F.col("_cut"), F.lit(False)) | h.isin(named)
    below = hashed.withColumn("_cut", cut).select("_doc", "_hs", F.array_distinct(F.filter("_hs", kept)).alias("_low"))
    shared = F.size(F.array_intersect("_shingles", "_hs"))
    if small:
        # array_intersect runs within the stage's generated code, so no wide row outlives its match
        pairs = below.select("_doc", "_hs", F.explode("_low").alias("_hash")).join(F.broadcast(sketches), "_hash").select("_doc", "_item", "_n", shared.alias("_shared"))
    else:
        found = below.select("_doc", F.explode("_low").alias("_hash")).join(sketches.select("_hash", "_item"), "_hash").select("_doc", "_item").distinct()
        whole = sketches.select("_item", "_n", "_shingles").dropDuplicates(["_item", "_shingles"])
        pairs = found.join(whole, "_item").join(hashed, "_doc").select("_doc", "_item", "_n", shared.alias("_shared"))
    best = pairs.where(F.col("_shared") >= F.ceil(F.lit(threshold) * F.col("_n") - 1e-9)).groupBy("_doc", "_item").agg(
        F.max(F.struct((F.col("_shared") / F.col("_n")).alias("c"), "_n", "_shared")).alias("b")
    )
    return best.select(
        F.col("_doc").alias(id_col), F.col("_item").alias(item_id_col), F.col("b._n").cast("long").alias("n_shingles"),
        F.col("b._shared").cast("long").alias("n_shared"), F.col("b.c").alias("containment"),
    )


def find_short(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_id_col="item_id", item_text_col="text", k: int = 5) -> DataFrame:
    """One row (id, item id, n_words) for each document that holds an item of fewer than k words word for word, A-Z lower-cased.

    Items without words match nothing. A one-word item is found in every document that has the word, which is why nothing removes
    documents for short items unless it is asked to. Of a document the windows of 1 to k - 1 words are made that some item has.
    """
    line = lambda w: F.array_join(w, " ")
    short = items.select(F.col(item_id_col).alias("_item"), words_of(F.col(item_text_col)).alias("_w")).where(F.size("_w").between(1, k - 1))
    short = short.select("_item", F.size("_w").alias("_n"), line("_w").alias("_line")).distinct()
    widths = [r["_n"] for r in short.select("_n").distinct().collect()]
    words = docs.select(F.col(id_col).alias("_doc"), words_of(F.col(text_col)).alias("_w"))
    windows = [
        F.expr(f"if(size(_w) < {n}, cast(array() as array<string>), array_distinct(transform(sequence(0, size(_w) - {n}), i -> array_join(slice(_w, i + 1, {n}), ' '))))") for n in widths
    ]
    each = words.select("_doc", F.explode(F.flatten(F.array(*windows)) if windows else F.expr("cast(array() as array<string>)")).alias("_line"))
    found = each.join(F.broadcast(short) if short.count() <= BROADCAST_ROWS else short, "_line")
    return found.select(F.col("_doc").alias(id_col), F.col("_item").alias(item_id_col), F.col("_n").cast("long").alias("n_words")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", short_items: bool = False, **named) -> DataFrame:
    """The documents, all columns, that hold no item; with ``short_items`` none of fewer than k words either. Rows with a null id
    stay, as no pair can name them."""
    leaks = find_contained(docs, items, id_col=id_col, **named).select(F.col(id_col).alias("_leak"))
    if short_items:
        leaks = leaks.unionByName(find_short(docs, items, id_col=id_col, **{x: v for x, v in named.items() if x != "threshold"}).select(F.col(id_col).alias("_leak")))
    return docs.join(leaks.distinct(), docs[id_col] == leaks["_leak"], "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SHINGLES = r"""
  SELECT {id}, unnest(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i+4], 'string_agg', ' '))) AS s
  FROM (SELECT {id}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {t}) WHERE len(w) >= 5"""
OP8_SQL = f"""
WITH i AS (SELECT DISTINCT * FROM ({_SHINGLES.format(id="item_id", t="benchmark")})),
d AS (SELECT DISTINCT * FROM ({_SHINGLES.format(id="doc_id", t="documents")})),
n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles AS containment
FROM d JOIN i USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_shingles HAVING 10 * count(*) >= 8 * n_shingles
"""
