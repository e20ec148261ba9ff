"""The entity graph: nodes, mention and co-occurrence links, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.config import WorkspaceConfig


def top_entities(entities: DataFrame, cfg: WorkspaceConfig = WorkspaceConfig()) -> DataFrame:
    """The most frequent entities, first seen first among equals; a fixed small number, as the graph is a report."""
    return entities.where(F.col("count") >= cfg.min_mentions).orderBy(F.desc("count"), "first_ord", "entity").limit(cfg.max_entities)


def nodes(docs: DataFrame, top: DataFrame) -> DataFrame:
    """docs: doc_id, name, chunks. id, label, type, weight: 3 + chunks for documents, 1 + the count up to 8 for entities."""
    of_docs = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("name").alias("label"), F.lit("DOC").alias("type"), (3 + F.col("chunks")).cast("long").alias("weight"))
    of_entities = top.select(F.col("entity").alias("id"), F.col("surface").alias("label"), "type", (1 + F.least("count", F.lit(8))).cast("long").alias("weight"))
    return of_docs.unionByName(of_entities)


def mention_links(top: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Entity to document; the weight is the entity's whole count, up to 6, on each of its links. The documents come from ``members``
    (entities.members), or from the arrays of a small table's entities."""
    pairs = members.select("entity", "count", "doc").distinct() if members is not None else top.select("entity", "count", F.explode(F.col("docs")).alias("doc"))
    return pairs.select(F.col("entity").alias("source"), F.col("doc").cast("string").alias("target"), F.least("count", F.lit(6)).cast("long").alias("weight"), F.lit("mention").alias("kind"))


def cooccurrence_links(top: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Pairs of the given entities, the higher placed first, with the number of chunks they share: an equi-join on the chunk.

    The entities are the limited top of a report, so a chunk has few."""
    rows = members.select("entity", "count", "first_ord", "chunk").distinct() if members is not None else top.select("entity", "count", "first_ord", F.explode("chunk_keys").alias("chunk"))
    place = F.struct((-F.col("count")).alias("c"), "first_ord", "entity")
    a = rows.select("chunk", F.col("entity").alias("source"), place.alias("_a"))
    b = rows.select("chunk", F.col("entity").alias("target"), place.alias("_b"))
    return a.join(b, "chunk").where("_a < _b").groupBy("source", "target").agg(F.count("*").alias("weight")).withColumn("kind", F.lit("cooccur"))


def build_graph(docs: DataFrame, entities: DataFrame, cfg: WorkspaceConfig = WorkspaceConfig()) -> tuple[DataFrame, DataFrame]:
    top = top_entities(entities, cfg)
    return nodes(docs, top), mention_links(top).unionByName(cooccurrence_links(top))


def chunks_for_entity(entities: DataFrame, chunks: DataFrame, entity: str, most: int = 4) -> DataFrame:
    """The first chunks that hold the entity; entities: a row for each chunk with its key, or one with an array of keys."""
    own = entities.where(F.col("entity") == entity)
    keys = own.select(F.explode("chunk_keys").alias("key")) if "chunk_keys" in entities.columns else own.select("key")
    return chunks.join(keys, "key", "left_semi").orderBy("chunk_ord").limit(most)


def neighbours(links: DataFrame, node: str) -> DataFrame:
    """The node and all that a link ties to it."""
    tied = links.where((F.col("source") == node) | (F.col("target") == node))
    return tied.select(F.explode(F.array("source", "target")).alias("id")).distinct()
