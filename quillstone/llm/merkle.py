"""Merkle dataset manifest: ranks by digit histograms of ids, a trie over base-fanout digits of the ranks, proofs down its paths."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.ordering import numbered
from .common import ascii_lower, stored, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node, and how many levels of nodes one row of the trie holds: its leaves share all digits but the last LEVELS.
FANOUT, LEVELS = 8, 3
BLOCK = FANOUT**LEVELS
#: Bits of a digit of an id: a histogram has 256 children at most under a prefix.
DIGIT = 8
#: Alike rows that are given their places together; their places are dealt out in runs of so many.
COPIES = 8192
LEAST = -(2**63)
STEP = "array<struct<l binary, r binary>>"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    """The digest of a row, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


@dataclass(frozen=True)
class Trie:
    """blocks[r]: _k, _block, _n, items of the r-th round, lowest first; tops the same over the groups; groups: _k, place, subroot; root."""

    blocks: list[DataFrame]
    tops: list[DataFrame]
    groups: DataFrame
    root: str | None


def ranked(leaves: DataFrame) -> DataFrame:
    """leaves (_k, _o, id, leaf, seen) with _rank from 0 within _k by (_o, leaf), exact and without a sort of a group.

    Ids are counted by ever shorter prefixes, DIGIT bits less each time. From the shortest down, a prefix begins where the smaller
    ones under the same longer part end; so does an id. Rows that share an id are told apart in the same way by the first two bytes
    of their leaves and then by the leaves; rows that are wholly alike are one row with a count until they get their places.
    """
    ids = stored(leaves.groupBy("_k", "_o").agg(F.count("*").alias("_c")), "ids")
    low, high = ids.agg(F.min("_o"), F.max("_o")).first()
    up = lambda shift: F.lit(0).cast("long") if shift >= 64 else F.shiftright("_p", DIGIT)  # noqa: E731  all 64 bits gone: one prefix
    levels, shift = [(stored(ids.groupBy("_k", F.shiftright("_o", DIGIT).alias("_p")).agg(F.sum("_c").alias("_c")), "prefixes"), 2 * DIGIT)], DIGIT
    while shift < 64 and low is not None and low >> shift != high >> shift:
        shift += DIGIT
        levels.append((levels[-1][0].groupBy("_k", up(shift).alias("_p")).agg(F.sum("_c").alias("_c")), shift + DIGIT))
    before = lambda w: F.coalesce(F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = levels.pop()[0].select("_k", "_p", F.lit(0).cast("long").alias("_start"))
    for counts, over in [*reversed(levels), (ids.withColumnRenamed("_o", "_p"), DIGIT)]:
        own = counts.withColumn("_up", up(over)).withColumn("_own", before(W.partitionBy("_k", "_up").orderBy("_p")))
        above = begins.select("_k", F.col("_p").alias("_up"), F.col("_start").alias("_a"))
        begins = own.join(above, ["_k", "_up"]).select("_k", "_p", (F.col("_a") + F.col("_own")).alias("_start"), "_c")
    placed = stored(leaves.join(begins.withColumnRenamed("_p", "_o"), ["_k", "_o"]), "placed")
    one = placed.where("_c = 1").select("_k", F.col("_start").alias("_rank"), "id", "leaf", "seen")
    alike = placed.where("_c > 1").groupBy("_k", "_o", "_start", "leaf", "seen").agg(F.first("id").alias("id"), F.count("*").alias("_c")).withColumn("_d", F.substring("leaf", 1, 2))
    digits = alike.groupBy("_k", "_o", "_d").agg(F.sum("_c").alias("_c"))
    digits = digits.select("_k", "_o", "_d", before(W.partitionBy("_k", "_o").orderBy("_d")).alias("_b"))
    met = alike.join(digits, ["_k", "_o", "_d"]).withColumn("_at", F.col("_start") + F.col("_b") + before(W.partitionBy("_k", "_o", "_d").orderBy("leaf", "id")))
    runs = met.withColumn("_run", F.explode(F.expr(f"sequence(_at, _at + _c - 1, {COPIES}L)"))).repartition("_k", "_run")
    many = runs.select("_k", F.explode(F.expr(f"sequence(_run, least(_run + {COPIES}, _at + _c) - 1)")).alias("_rank"), "id", "leaf", "seen")
    return one.unionByName(many)


def blocked(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """nodes (_k, _rank, id, leaf, seen) as rows of BLOCK at most in the order of ranks; _n: all nodes of the group. Stored."""
    item = F.struct("_rank", "id", "leaf", "seen")
    rows = nodes.groupBy("_k", F.shiftright("_rank", BLOCK.bit_length() - 1).alias("_block")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return stored(rows.join(counts.select("_k", "_n"), "_k").select("_k", "_block", "_n", "items"), "blocks")


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climbed(leaves: list[str], alone: bool) -> list[list[str]]:
    """The levels of nodes over a block: up to one node, LEVELS of them unless the block is alone in its group."""
    levels = [leaves]
    while len(levels[-1]) > 1 if alone else len(levels) <= LEVELS:
        here = levels[-1]
        levels.append([digest(here[i : i + FANOUT]) for i in range(0, len(here), FANOUT)])
    return levels


def steps(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """What stands left and right of the i-th leaf's path at each level below the last."""
    out = []
    for here in levels[:-1]:
        first = i // FANOUT * FANOUT
        out.append(("".join(here[first:i]), "".join(here[i + 1 : first + FANOUT])))
        i //= FANOUT
    return out


def climb(blocks: DataFrame) -> DataFrame:
    """The node over each block as a node of the next round: _k, _rank, id (none), leaf, seen (none), _n."""

    def run(batches):
        for batch in batches:
            out = []
            for key, block, n, items in zip(*[batch.column(c).to_pylist() for c in ("_k", "_block", "_n")], batch.column("items"), strict=True):
                leaves = [x.hex() for x in items.values.field("leaf").to_pylist()]
                out.append((key, block, None, bytes.fromhex(climbed(leaves, n <= BLOCK)[-1][0]), None, -(-n // BLOCK)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names)

    names = ["_k", "_rank", "id", "leaf", "seen", "_n"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
    return blocks.mapInArrow(run, "_k string, _rank long, id long, leaf binary, seen binary, _n long")


def built(nodes: DataFrame, counts: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of blocks, and one node for each group (_k, leaf): a group ends with the round that leaves it one node."""
    rounds, ended = [], []
    while True:
        rounds.append(blocked(nodes, counts))
        up = stored(climb(rounds[-1]), "nodes")
        ended.append(up.where("_n = 1").select("_k", "leaf"))
        if most <= BLOCK:
            return rounds, reduce(DataFrame.unionByName, ended)
        most = -(-most // BLOCK)
        nodes = up.where("_n > 1")
        counts = nodes.where("_rank = 0").select("_k", "_n")


def build(leaves: DataFrame) -> Trie:
    """The trie of leaves (group string, id long, leaf binary, seen binary or null: a leaf to be checked instead).

    Groups in order, null first, by UTF-8 bytes; leaves of a group by id, null as the smallest long, rows of one id by leaf.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("group")), F.lit(""))
    rows = stored(leaves.select(key.alias("_k"), F.coalesce("id", F.lit(LEAST)).alias("_o"), "id", "leaf", "seen"), "leaves")
    counts = stored(rows.groupBy("_k").agg(F.count("*").alias("_n")), "groups")
    groups, most = counts.agg(F.count("*"), F.max("_n")).first()
    if not groups:
        return Trie([], [], counts, None)
    blocks, subroots = built(ranked(rows), counts, most)
    placed = stored(numbered(subroots.withColumnRenamed("leaf", "subroot"), ["_k"], "place"), "subroots")
    top = placed.select(F.lit("").alias("_k"), F.col("place").alias("_rank"), F.lit(None).cast("long").alias("id"), F.col("subroot").alias("leaf"), F.lit(None).cast("binary").alias("seen"))
    tops, root = built(top, placed.groupBy(F.lit("").alias("_k")).agg(F.count("*").alias("_n")), groups)
    return Trie(blocks, tops, placed, root.first()["leaf"].hex())


def descend(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """For each node of the blocks the steps from it to the root: _k, _block, above, subroot, where _block is the node's rank.

    above: the same of the blocks' own nodes. A block's steps are made once and shared by all below it.
    """

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("_k", "_n", "above", "subroot")]
            for key, n, up, subroot, items in zip(*columns, batch.column("items"), strict=True):
                ranks = items.values.field("_rank")
                levels = climbed([x.hex() for x in items.values.field("leaf").to_pylist()], n <= BLOCK)
                paths = [[{"l": bytes.fromhex(a), "r": bytes.fromhex(b)} for a, b in steps(levels, i)] + up for i in range(len(ranks))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(ranks), pa.string()), ranks.cast(pa.int64()), pa.array(paths, kind), pa.array([subroot] * len(ranks), pa.binary())], ["_k", "_block", "above", "subroot"]
                )

    kind = pa.list_(pa.struct([("l", pa.binary()), ("r", pa.binary())]))
    return blocks.join(above, ["_k", "_block"]).select("_k", "_n", "above", "subroot", "items").mapInArrow(run, f"_k string, _block long, above {STEP}, subroot binary")


def proofs(trie: Trie) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified, siblings of each leaf.

    siblings: the other nodes of each run on the way to the root, left to right, level by level. folded_root is made from ``seen``
    where it is given, else from the leaf, and the siblings; verified: it equals the root.
    """
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "siblings"]
    if trie.root is None:
        return trie.groups.sparkSession.createDataFrame([], "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, siblings array<string>")
    start = trie.tops[-1].select("_k", "_block", F.expr(f"CAST(array() AS {STEP})").alias("above"), F.lit(None).cast("binary").alias("subroot"))
    for tops in reversed(trie.tops):
        start = descend(tops, start)
    starts = trie.groups.join(stored(start.select(F.col("_block").alias("place"), "above"), "tops"), "place")
    above = None
    for k in range(len(trie.blocks) - 1, -1, -1):
        # a group's highest block is the only one of its round
        first = trie.blocks[k].where(f"_n <= {BLOCK}").select("_k", "_block").join(starts.select("_k", "above", "subroot"), "_k")
        above = first if above is None else first.unionByName(above)
        if k:
            above = stored(descend(trie.blocks[k], above), "above")
    root = trie.root

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("_n", "above", "subroot")]
            for n, up, subroot, items in zip(*columns, batch.column("items"), strict=True):
                fields = items.values
                leaves = [x.hex() for x in fields.field("leaf").to_pylist()]
                seen = fields.field("seen").to_pylist()
                levels = climbed(leaves, n <= BLOCK)
                up = [(x["l"].hex(), x["r"].hex()) for x in up]
                shared = "".join(a + b for a, b in up)
                out = []
                for i, leaf in enumerate(leaves):
                    path = steps(levels, i)
                    said = "".join(a + b for a, b in path) + shared
                    folded = seen[i].hex() if seen[i] is not None else leaf
                    for a, b in [*path, *up]:
                        folded = digest([a, folded, b])
                    out.append((digest([said]), folded, folded == root, [said[j : j + 64] for j in range(0, len(said), 64)]))
                made = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string())), strict=True)]
                same = [pa.array([x] * len(leaves), pa.string()) for x in (subroot.hex(), root)]
                yield pa.RecordBatch.from_arrays([fields.field("id"), pa.array(leaves, pa.string()), *same, *made], names)

    met = trie.blocks[0].join(above, ["_k", "_block"]).select("_n", "above", "subroot", "items")
    return met.mapInArrow(run, "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, siblings array<string>")


def manifest_leaves(docs: DataFrame, fields=FIELDS, id_col: str = "doc_id", group_col: str = "lang", seen: Column | None = None) -> DataFrame:
    """group, id, leaf, seen of each row for build. seen: a leaf to be checked in place of the row's own, null where there is none.

    Nulls are ``-`` in a leaf, empty texts ``0:``; rows that share an id, or all columns, are leaves of their own; an empty table has
    no leaves and no root; extra columns play no part.
    """
    return docs.select(F.col(group_col).cast("string").alias("group"), F.col(id_col).cast("long").alias("id"), leaf_of(*[F.col(f) for f in fields]).alias("leaf"), (F.lit(None).cast("binary") if seen is None else seen).alias("seen"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and its proofs held against texts that were tampered with where 3 divides the crc32 of the id."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = [ascii_lower(F.col(f)) if f == "text" else F.col(f) for f in FIELDS]
    trie = build(manifest_leaves(docs, seen=F.when(tampered, leaf_of(*changed))))
    return proofs(trie).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _sql_field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || {x} END"


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: crc32 bit by bit, as DuckDB has none.
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: unicode(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda h, z: xor(h >> 1, 3988292384 * (h & 1)))), 4294967295)"
_STEP = """SELECT f.r, f.tree, f.lvl + 1, f.idx // 8, sha256(string_agg(CASE WHEN n.idx = f.idx THEN f.h ELSE n.h END, '' ORDER BY n.idx)),
    f.sib || coalesce(string_agg(CASE WHEN n.idx <> f.idx THEN n.h END, '' ORDER BY n.idx), '')
  FROM {f} f JOIN n ON n.tree = f.tree AND n.lvl = f.lvl AND n.idx // 8 = f.idx // 8 JOIN tops ON tops.tree = f.tree AND f.lvl < tops.lvl
  GROUP BY f.r, f.tree, f.lvl, f.idx, f.h, f.sib"""
OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS tree, sha256({" || ".join(map(_sql_field, FIELDS))}) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_CRC} % 3 = 0 THEN sha256({" || ".join(_sql_field(_LOWERED if f == "text" else f) for f in FIELDS)}) END AS seen
  FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
t(tree, lvl, idx, h) AS (
  SELECT tree, 0, idx, leaf FROM p
  UNION ALL
  SELECT tree, lvl + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM t) WHERE c > 1 GROUP BY tree, lvl, idx // 8),
s AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM (SELECT * FROM t QUALIFY lvl = max(lvl) OVER (PARTITION BY tree))),
u(tree, lvl, idx, h) AS (
  SELECT 'top', 0, place, subroot FROM s
  UNION ALL
  SELECT tree, lvl + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER () AS c FROM u) WHERE c > 1 GROUP BY tree, lvl, idx // 8),
n AS (SELECT * FROM t UNION ALL SELECT * FROM u),
tops AS (SELECT tree, max(lvl) AS lvl FROM n GROUP BY tree),
a(r, tree, lvl, idx, h, sib) AS (SELECT r, tree, 0, idx, coalesce(seen, leaf), '' FROM p UNION ALL {_STEP.format(f="a")}),
b(r, tree, lvl, idx, h, sib) AS (
  SELECT a.r, 'top', 0, s.place, a.h, a.sib FROM a JOIN tops USING (tree, lvl) JOIN s USING (tree)
  UNION ALL {_STEP.format(f="b")}),
e AS (SELECT b.* FROM b JOIN tops USING (tree, lvl))
SELECT p.doc_id, p.leaf, s.subroot, u.h AS root, sha256(e.sib) AS proof_sha256, e.h AS folded_root, e.h = u.h AS verified
FROM p JOIN e USING (r) JOIN s ON s.tree = p.tree JOIN u ON u.lvl = (SELECT max(lvl) FROM u)
"""
