"""Tables of an index on shared storage: vectors under a signature, upserts by key, reuse by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.errors import AnalysisException


def signature(provider: str, dims: int, index_version: int = 1) -> str:
    return f"{provider}-{dims}-{index_version}"


def content_hash(*columns: str):
    """Of the texts that an embedding is made of; changes with any of them."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in columns]), 256)


def save_index(vectors: DataFrame, path: str, sign: str) -> None:
    vectors.write.mode("overwrite").parquet(f"{path}/sig={sign}")


def load_index(spark: SparkSession, path: str, sign: str) -> DataFrame | None:
    """None if there is no index of the signature."""
    try:
        return spark.read.parquet(f"{path}/sig={sign}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def list_documents(spark: SparkSession, path: str, schema) -> DataFrame:
    """The stored documents; none if nothing has been stored."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def upsert(stored: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key over both (largest version, new before stored among equals)."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = F.row_number().over(W.partitionBy(key).orderBy(F.desc(version), F.desc("_new")))
    return both.withColumn("_i", latest).where("_i = 1").drop("_i", "_new")


def delete(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return stored.join(keys.select(key).distinct(), key, "left_anti")


def to_embed(chunks: DataFrame, stored: DataFrame | None, key="key", hash_col="content") -> DataFrame:
    """Chunks whose key and content hash have no stored vector: new ones and changed ones."""
    return chunks if stored is None else chunks.join(stored.select(key, hash_col), [key, hash_col], "left_anti")


def same_keys(a: DataFrame, b: DataFrame, key="key") -> bool:
    x, y = a.select(key), b.select(key)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()
