"""Approximate neighbours: a navigable small-world graph for each partition, searched where it lies, best hits merged."""

from __future__ import annotations

import heapq
import math
import pickle
import random
from dataclasses import astuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.config import AnnConfig
from .retrieval import check_dims, dealt, knn, vector

GRAPHS = "part long, count long, graph binary"
#: Vectors of a graph, about. A beam of one width misses more the larger its graph is (recall at 10 on one graph of the check tool's vectors:
#: 0.95 at 8,000, 0.91 at 16,000), and a graph is built by one task.
PER_GRAPH = 8_192


class SmallWorld:
    """A hierarchical graph over unit vectors; near means a large dot product. Seeded, so builds repeat."""

    def __init__(self, dims: int, cfg: AnnConfig = AnnConfig()):
        self.dims, self.cfg, self.random = dims, cfg, random.Random(cfg.seed)
        self.keys: list = []
        self.rows = np.empty((0, dims), np.float32)
        self.links: list[list[list[int]]] = []  # node -> layer -> neighbours
        self.entry, self.top = -1, -1

    def __len__(self) -> int:
        return len(self.keys)

    def _near(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        return self.rows[nodes] @ q

    def _descend(self, q: np.ndarray, at: int, high: int, low: int) -> int:
        best = float(self.rows[at] @ q)
        for layer in range(high, low, -1):
            moved = True
            while moved:
                moved = False
                around = self.links[at][layer]
                if around:
                    s = self._near(q, around)
                    k = int(s.argmax())
                    if s[k] > best:
                        at, best, moved = around[k], float(s[k]), True
        return at

    def _beam(self, q: np.ndarray, start: int, width: int, layer: int) -> list[tuple[float, int]]:
        """(score, node) of the best found, best first."""
        first = float(self.rows[start] @ q)
        seen, todo, held = {start}, [(-first, start)], [(first, start)]
        while todo:
            s, at = heapq.heappop(todo)
            if -s < held[0][0] and len(held) >= width:
                break
            fresh = [x for x in self.links[at][layer] if x not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for score, node in zip(self._near(q, fresh).tolist(), fresh, strict=True):
                if len(held) < width or score > held[0][0]:
                    heapq.heappush(todo, (-score, node))
                    heapq.heappush(held, (score, node))
                    if len(held) > width:
                        heapq.heappop(held)
        return sorted(held, reverse=True)

    def _chosen(self, q: np.ndarray, found: list[tuple[float, int]], most: int) -> list[int]:
        """Nodes nearer to q than to any chosen before them, best first; filled up with the others."""
        kept, rest = [], []
        for score, node in found:
            if len(kept) == most:
                break
            (rest if kept and self._near(self.rows[node], kept).max() >= score else kept).append(node)
        return kept + rest[: most - len(kept)]

    def add(self, key, values) -> None:
        v = np.asarray(values, np.float32)
        if v.shape != (self.dims,):
            raise ValueError(f"expected {self.dims} dimensions, got {v.shape}")
        me, height = len(self.keys), min(16, int(-math.log(1 - self.random.random())))
        if me == len(self.rows):  # room doubles
            self.rows = np.vstack([self.rows, np.zeros((max(64, me), self.dims), np.float32)])
        self.rows[me] = v
        self.keys.append(key)
        self.links.append([[] for _ in range(height + 1)])
        if me == 0:
            self.entry, self.top = 0, height
            return
        at = self._descend(v, self.entry, self.top, height)
        for layer in range(min(height, self.top), -1, -1):
            found = self._beam(v, at, self.cfg.ef_construction, layer)
            at = found[0][1]
            self.links[me][layer] = self._chosen(v, found, self.cfg.m)
            most = self.cfg.m * (1 if layer else 2)
            for other in self.links[me][layer]:
                around = self.links[other][layer]
                around.append(me)
                if len(around) > most:
                    scores = self._near(self.rows[other], around).tolist()
                    self.links[other][layer] = self._chosen(self.rows[other], sorted(zip(scores, around, strict=True), reverse=True), most)
        if height > self.top:
            self.entry, self.top = me, height

    def search(self, values, k: int, ef: int | None = None) -> list[tuple[float, object]]:
        if not self.keys:
            return []
        q = np.asarray(values, np.float32)
        at = self._descend(q, self.entry, self.top, 0)
        return [(s, self.keys[n]) for s, n in self._beam(q, at, max(ef or self.cfg.ef_search, k), 0)[:k]]

    def to_bytes(self) -> bytes:
        return pickle.dumps((self.dims, astuple(self.cfg), self.random.getstate(), self.keys, self.rows[: len(self.keys)], self.links, self.entry, self.top))

    @classmethod
    def from_bytes(cls, data: bytes) -> SmallWorld:
        out = cls.__new__(cls)
        out.dims, cfg, state, out.keys, out.rows, out.links, out.entry, out.top = pickle.loads(data)
        out.cfg, out.random = AnnConfig(*cfg), random.Random()
        out.random.setstate(state)
        return out


def build_ann(vectors: DataFrame, dims: int, cfg: AnnConfig = AnnConfig(), per_graph: int = PER_GRAPH, key_col="key", vec_col="embedding") -> DataFrame:
    """part, count, graph: vectors are dealt by a hash of the key over as many graphs as ``per_graph`` makes; all are indexed."""
    n = max(1, -(-vectors.count() // per_graph))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        graph = SmallWorld(dims, cfg)
        for key, values in pdf.sort_values("key")[["key", "v"]].itertuples(index=False):
            graph.add(key, values)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "count": [len(graph)], "graph": [graph.to_bytes()]})

    dealt = vectors.select(F.col(key_col).alias("key"), F.col(vec_col).alias("v"), F.pmod(F.xxhash64(key_col), F.lit(n)).alias("part"))
    return dealt.repartition(4 * n, "part").groupBy("part").applyInPandas(run, GRAPHS)


def ann_search(index: DataFrame, queries: DataFrame, k: int, query_key="query", vec_col="embedding", key_type: str = "long", ef: int | None = None, most_queries: int = 10_000) -> DataFrame:
    """query, key, score, rank: each graph answers every query, a block of ``most_queries`` at a time, and the k best are merged.

    Blocks of queries are rows of a frame and meet the graphs in a shuffle; the driver sees neither."""
    asked = dict(queries.dtypes)[query_key]
    blocks, n = dealt(queries.select(F.col(query_key).alias("q"), F.col(vec_col).alias("x")), "q", most_queries, "_q")
    parts = index.select("part", "graph").withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    each = blocks.crossJoin(F.broadcast(index.agg(F.collect_set("part").alias("_parts")))).select("q", "x", "_q", F.explode("_parts").alias("part"))

    def run(own: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for data in own["graph"]:
            graph = SmallWorld.from_bytes(data)
            rows += [(q, key, s) for q, v in zip(said["q"], said["x"], strict=True) for s, key in graph.search(v, k, ef)]
        return pd.DataFrame(rows, columns=["q", "key", "score"])

    hits = parts.groupBy("part", "_q").cogroup(each.groupBy("part", "_q")).applyInPandas(run, f"q {asked}, key {key_type}, score double")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "key")).cast("long")
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("q", query_key)


def insert_ann(index: DataFrame, vectors: DataFrame, key_col="key", vec_col="embedding") -> DataFrame:
    """The index with more vectors: each joins the graph of its hash, as in build_ann."""
    n = index.count()

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"part": [], "count": [], "graph": []})
        graph = SmallWorld.from_bytes(left["graph"].iloc[0])
        for k, v in right.sort_values("key")[["key", "v"]].itertuples(index=False):
            graph.add(k, v)
        return pd.DataFrame({"part": left["part"].iloc[:1], "count": [len(graph)], "graph": [graph.to_bytes()]})

    dealt = vectors.select(F.col(key_col).alias("key"), F.col(vec_col).alias("v"), F.pmod(F.xxhash64(key_col), F.lit(n)).alias("part"))
    return index.groupBy("part").cogroup(dealt.groupBy("part")).applyInPandas(run, GRAPHS)


def search_vectors(vectors: DataFrame, query: list[float], k: int, min_score: float | None = None, index: DataFrame | None = None, cfg: AnnConfig = AnnConfig(), key_col="key") -> DataFrame:
    """Exact below ``cfg.threshold`` vectors or without an index, approximate from there on; the floor holds for both."""
    if index is None or vectors.count() < cfg.threshold:
        return knn(check_dims(vectors, len(query)), vector(query), k, min_score, key_col)
    one = vectors.sparkSession.range(1).select(F.lit(0).alias("query"), vector(query).alias("embedding"))
    hits = ann_search(index, one, k, key_type=dict(vectors.dtypes)[key_col]).select(F.col("key").alias(key_col), "score", "rank")
    return hits.where(F.col("score") >= min_score) if min_score is not None else hits
