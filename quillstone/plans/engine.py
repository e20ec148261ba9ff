"""The retrieval engine: index build, ask, compare, answers, and the workspace."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import detect_locale
from ..operators import chunking, claims, entities, graph, lexical, retrieval
from ..operators.ordering import numbered
from ..operators.stored_index import StoredIndex
from ..sources.scratch import stored
from ..sources.store import content_hash, load_index, save_index, signature, to_embed
from .config import Config
from .providers import HashEmbedder
from .runner import Stage, run_pipeline


def with_chunk_order(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks with chunk_ord, a long that orders them by (updated descending, doc_id, seq) and breaks all ties.

    Documents are numbered, not chunks, and in ranges: no task sees all of them. A null ``updated`` comes last; of rows that share a
    doc_id the first counts.
    """
    sized = docs.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.max(F.coalesce(F.col("updated"), F.lit(""))).alias("_u"))
    placed = numbered(sized, [F.desc("_u"), "doc_id"], "_i")
    return chunks.join(placed.select("doc_id", "_i"), "doc_id").withColumn("chunk_ord", (F.col("_i") + 1) * 1_000_000 + F.col("seq")).drop("_i")


@dataclass
class Index:
    docs: DataFrame
    chunks: DataFrame
    lexical: lexical.LexicalIndex | StoredIndex
    vectors: DataFrame
    embedder: object
    config: Config
    prototypes: DataFrame | None = None


def build_index(docs: DataFrame, cfg: Config = Config(), embedder=None, path: str | None = None, stored_lexical: bool = False) -> Index:
    """Chunks, lexical index and vectors of documents. With a path vectors are kept under the embedder's signature and only chunks
    whose key or content is new are embedded; with ``stored_lexical`` the lexical index is kept there too, brought up to these documents."""
    embedder = embedder or HashEmbedder(cfg.hash_dims)
    spark = docs.sparkSession
    chunks = with_chunk_order(chunking.chunk(docs, cfg.chunk), docs).withColumn("content", content_hash("heading", "text"))
    text = chunks.withColumn("_t", F.concat_ws(" ", "heading", "text"))
    index = lexical.build_lexical_index(text, "key", "chunk_ord", "_t")
    if path and stored_lexical:
        index = StoredIndex(spark, f"{path}/lexical", "string")
        apply_chunks(index, text, index.live_docs())
    need = chunks.withColumn("_t", F.concat_ws("\n", "heading", "text"))
    kept = load_index(spark, path, signature(embedder.name, embedder.dims)) if path else None
    fresh = embedder.embed(to_embed(need, kept), "_t").select("key", "content", "embedding")
    vectors = fresh if kept is None else fresh.unionByName(kept.join(need.select("key", "content"), ["key", "content"], "left_semi"))
    if path:
        fresh_path = f"{path}/next"
        vectors.write.mode("overwrite").parquet(fresh_path)
        save_index(spark.read.parquet(fresh_path), path, signature(embedder.name, embedder.dims))
        vectors = load_index(spark, path, signature(embedder.name, embedder.dims))
    return Index(docs, chunks, index, vectors, embedder, cfg)


def apply_chunks(index: StoredIndex, text: DataFrame, before: DataFrame) -> None:
    """Brings the stored index from the live rows ``before`` (key) to chunks with key, chunk_ord and _t."""
    rows = text.select("key", "chunk_ord", "_t", F.lit(False).alias("_gone"))
    gone = before.select("key").join(text.select("key"), "key", "left_anti").select("key", F.lit(0).cast("long").alias("chunk_ord"), F.lit(None).cast("string").alias("_t"), F.lit(True).alias("_gone"))
    applied = index.state["applied"]
    index.apply(rows.unionByName(gone), 0 if applied is None else applied + 1, "key", "chunk_ord", "_t", "_gone")


def keyword_search(index: Index, query: str, k: int) -> DataFrame:
    s = index.config.search
    if isinstance(index.lexical, StoredIndex):
        return index.lexical.search(query, k, s.k1, s.b)
    return lexical.bm25_search(index.lexical, query, k, s.k1, s.b)


def add_documents(index: Index, docs: DataFrame) -> Index:
    """The index with more documents (doc_id, title, body), after all that it has, without building it anew.

    Documents that it holds under the same id are replaced. Only the new chunks are embedded, and a stored lexical index gets one
    segment; prototypes stay. The frames of the old index stay as they are.
    """
    docs = stored(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "title", "body"), "added")
    own = docs.select("doc_id").distinct()
    last = index.chunks.agg(F.max("chunk_ord")).first()[0] or 0
    placed = with_chunk_order(chunking.chunk(docs, index.config.chunk), docs.withColumn("updated", F.lit("")))
    fresh = placed.withColumn("chunk_ord", F.col("chunk_ord") + (last // 1_000_000 + 1) * 1_000_000).withColumn("content", content_hash("heading", "text"))
    old = index.chunks.join(own, "doc_id", "left_anti")
    chunks = stored(old.unionByName(fresh.select(*old.columns)), "chunks")
    vectors = index.embedder.embed(fresh.withColumn("_t", F.concat_ws("\n", "heading", "text")), "_t").select("key", "content", "embedding")
    kept = index.vectors.join(old.select("key"), "key", "left_semi").select("key", "content", "embedding")
    more = docs.select(*[F.col(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in index.docs.dtypes])
    text = lambda rows: rows.withColumn("_t", F.concat_ws(" ", "heading", "text"))
    if isinstance(index.lexical, StoredIndex):
        apply_chunks(index.lexical, text(fresh), index.chunks.join(own, "doc_id", "left_semi"))
        words = index.lexical
    else:
        words = lexical.build_lexical_index(text(chunks), "key", "chunk_ord", "_t")
    all_docs = index.docs.withColumn("doc_id", F.col("doc_id").cast("string")).join(own, "doc_id", "left_anti").select(*index.docs.columns)
    return replace(index, docs=all_docs.unionByName(more), chunks=chunks, lexical=words, vectors=stored(kept.unionByName(vectors), "vectors"))


def build_prototypes(routes: DataFrame, embedder) -> DataFrame:
    """route, label, gate, ord, embedding: the mean of each route's exemplar embeddings; routes without exemplars have none and go."""
    rows = routes.select("route", "label", "gate", "ord", F.explode("exemplars").alias("text"))
    mean = retrieval.centroids(embedder.embed(rows, "text"), "route")
    return routes.select("route", "label", "gate", "ord").join(mean, "route")


def embed_query(index: Index, query: str) -> DataFrame:
    one = index.docs.sparkSession.range(1).select(F.lit(query).alias("query"))
    return index.embedder.embed(one, "query").withColumn("locale", detect_locale("query"))


def retrieve(index: Index, query: str, qvec: list[float], want: int) -> DataFrame:
    """The semantic hits with chunk and document, at most 2 of a document, and the keyword rank of those in the keyword top."""
    s = index.config.search
    hits = retrieval.knn(index.vectors, retrieval.vector(qvec), s.pulled, s.min_score).drop("rank")
    placed = hits.join(index.chunks.select("key", "doc_id", "heading", "text", "chunk_ord"), "key")
    capped = retrieval.per_doc_cap(placed, s.per_doc, want, "doc_id", "score", "chunk_ord")
    ranked = retrieval.annotate_keyword_rank(capped, keyword_search(index, query, s.keyword_depth))
    titles = index.docs.select(F.col("doc_id").cast("string").alias("doc_id"), "title")
    return ranked.join(titles, "doc_id", "left").withColumn("title", F.coalesce("title", "doc_id")).withColumn("delta", F.col("keyword_rank") - F.col("sem_rank"))


def ask(index: Index, query: str, scorer=None, on_stage=None, observe: bool = False) -> dict:
    """Embeds, triages, retrieves and reranks a query. ctx: results (a frame), verdict, trace; a gated query stops before retrieval.

    The verdict is fetched first, as it decides whether the larger job is built at all.
    """
    s = index.config.search

    def embed(ctx):
        row = embed_query(index, query).first()
        return {"qvec": [float(x) for x in row["embedding"]], "locale": row["locale"]}

    def triage(ctx):
        got = retrieval.classify(embed_query(index, query), index.prototypes, s.min_confidence).first()
        verdict = got.asDict() if got else {"route": "unclear", "gate": False, "confidence": None}
        return {"verdict": verdict, "halt": bool(verdict["gate"])}

    def fetch(ctx):
        return {"results": retrieve(index, query, ctx["qvec"], s.top_k if scorer else s.shown)}

    def cross(ctx):
        return {"results": retrieval.rerank(ctx["results"], query, scorer, s.rerank_candidates, s.rerank_keep)}

    stages = [
        Stage("embed", "Embed", embed),
        Stage("triage", "Triage", triage, when=lambda c: index.prototypes is not None),
        Stage("retrieve", "Retrieve", fetch),
        Stage("rerank", "Rerank", cross, optional=True, when=lambda c: scorer is not None),
    ]
    return run_pipeline(stages, {"query": query}, on_stage, observe)


def compare(index: Index, query: str) -> DataFrame:
    """The keyword top with the ranks that semantic scores give it."""
    s = index.config.search
    keyword = keyword_search(index, query, s.compare)
    qvec = [float(x) for x in embed_query(index, query).first()["embedding"]]
    return retrieval.compare(keyword, retrieval.score_candidates(index.vectors, retrieval.vector(qvec), keyword))


def answer_claims(answers: DataFrame, passages: DataFrame, id_col: str, text_col: str, scorer=None) -> DataFrame:
    """Claims of answers, each judged against the passages it cites (all where it cites none)."""
    split = claims.claims_of(answers, id_col, text_col)
    return claims.verify_claims(claims.cited_passages(split, passages, id_col), scorer)


class Workspace:
    """A few documents of their own: chunks, vectors, entities and graph, apart from the library and never persisted."""

    def __init__(self, spark: SparkSession, cfg: Config = Config(), embedder=None, classifier=None):
        self.spark, self.cfg, self.embedder, self.classifier = spark, cfg, embedder or HashEmbedder(cfg.hash_dims), classifier
        self.docs = self.chunks = self.vectors = self.entities = self.error = None

    def ingest(self, docs: DataFrame, name_col: str | None = None) -> int:
        """Adds documents (doc_id, title, body) while there is room, in the order of their ids; long ones are sampled at even strides.

        With a name column only .md, .txt, .markdown and .pdf names count, in any case. Documents that are there stay as they are, and
        one of the same id is not taken again. Returns how many were added; ``error`` says why none was, and is None else.
        """
        w = self.cfg.workspace
        held = 0 if self.docs is None else self.docs.count()
        files = docs.where(F.lower(name_col).rlike(r"\.(md|txt|markdown|pdf)$")) if name_col else docs
        new = files.select(F.col("doc_id").cast("string").alias("doc_id"), "title", "body").dropDuplicates(["doc_id"])
        if self.docs is not None:
            new = new.join(self.docs.select("doc_id"), "doc_id", "left_anti")
        # a workspace is a few documents: they are fixed here, so that later intakes can't change which they were
        rows = new.orderBy("doc_id").limit(max(0, w.max_docs - held)).collect()
        self.error = None if rows else f"Workspace is full ({w.max_docs} documents max)." if held >= w.max_docs else "No .md/.txt/.pdf files found."
        if not rows:
            return 0
        taken = self.spark.createDataFrame(rows, "doc_id string, title string, body string")
        self.docs = taken if self.docs is None else self.docs.unionByName(taken)
        placed = with_chunk_order(chunking.chunk(self.docs, self.cfg.chunk), self.docs.withColumn("updated", F.lit("")))
        self.chunks = retrieval.stride_sample(placed, w.max_chunks_per_doc, ["seq"], ["doc_id"])
        self.vectors = self.embedder.embed(self.chunks.withColumn("_t", F.concat_ws("\n", "heading", "text")), "_t").select("key", "embedding")
        read = retrieval.stride_sample(self.chunks, w.entity_chunks_per_doc, ["seq"], ["doc_id"])
        keys = ["key", "doc_id", "chunk_ord"]
        per_chunk = entities.aggregate_entities(entities.extract_entities(read, keys, classifier=self.classifier), keys)
        self.entities = entities.merge_entities(per_chunk)
        return len(rows)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        counts = self.chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
        named = self.docs.select("doc_id", F.col("title").alias("name")).join(counts, "doc_id", "left").fillna(0, ["chunks"])
        return graph.build_graph(named, self.entities, self.cfg.workspace)

    def ask(self, question: str) -> DataFrame:
        """The best chunks, without a floor or a cap per document."""
        one = self.embedder.embed(self.spark.range(1).select(F.lit(question).alias("q")), "q").first()
        hits = retrieval.knn(self.vectors, retrieval.vector(one["embedding"]), self.cfg.workspace.chat_top_k)
        return hits.join(self.chunks, "key")
