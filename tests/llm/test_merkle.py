"""The manifest against one that is built row by row."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quillstone.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(r, text):
    return h(*[field(x) for x in (*r[:4], text)])


def small(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, i):
    for here in levels[:-1]:
        at = i // 8 * 8
        yield here[at:i], here[i + 1 : at + 8]
        i //= 8


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of each row."""
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees, own = {}, {}
    for name in names:
        own[name] = sorted(langs[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[name] = tree([leaf(r, r[4]) for r in own[name]])
    top = tree([trees[n][-1][0] for n in names])
    out = []
    for k, name in enumerate(names):
        for i, r in enumerate(own[name]):
            steps = [*path(trees[name], i), *path(top, k)]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            folded = leaf(r, small(r[4]) if tampered and r[4] is not None else r[4])
            for a, b in steps:
                folded = h(*a, folded, *b)
            root = top[-1][0]
            out.append((r[0], leaf(r, r[4]), trees[name][-1][0], root, h(*[x for a, b in steps for x in (*a, *b)]), folded, folded == root))
    return out


def corpus(seed, n, ids):
    r = random.Random(seed)
    lang = lambda: "en" if r.random() < 0.5 else r.choice(["fr", None, "de", "é", "\U0001f600", "～", "", "z"])
    rows = [(ids(r, i), r.choice([None, "", "s1", "ß"]), lang(), r.choice([None, 3, -4, 10**12]), r.choice([None, "", f"Text {i} É A", f"low {i}", "x" * 3000])) for i in range(n)]
    return rows + [("only", 1)[1:] + ("s", "lone", 1, "Only")] + [rows[2]] * 3


KINDS = {
    "dense": lambda r, i: i,
    "sparse": lambda r, i: r.randrange(-(2**63), 2**63),
    "shared": lambda r, i: None if r.random() < 0.3 else (7 if r.random() < 0.5 else i),
}


@pytest.mark.parametrize("kind,n,copies", [("dense", 1400, 8192), ("sparse", 300, 8192), ("shared", 500, 2)])
def test_manifest_equals_brute_force(spark, kind, n, copies, monkeypatch):
    monkeypatch.setattr(merkle, "COPIES", copies)
    rows = corpus(3, n, KINDS[kind])
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("_k", F.lit(1)).withColumn("leaf", F.lit("x")).withColumn("group", F.lit(2))
    seen = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.leaf_of(*[merkle.ascii_lower(F.col(f)) if f == "text" else F.col(f) for f in merkle.FIELDS]))
    out = merkle.proofs(merkle.build(merkle.manifest_leaves(docs, seen=seen)))
    got = [tuple(x) for x in out.drop("siblings").collect()]
    key = lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert {x[-1] for x in got} == {True, False}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    theirs = con.execute(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({merkle.OP12_SQL})").fetchall()
    assert sorted(got, key=key) == sorted(theirs, key=key)
    assert all(h(*x["siblings"]) == x["proof_sha256"] for x in out.collect())


@pytest.mark.parametrize("n", [1, 8, 9, 512, 513])
def test_one_group_of_each_height(spark, n):
    rows = [(i, "s", "en", 1, f"T{i}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = [tuple(x)[:5] for x in merkle.proofs(merkle.build(merkle.manifest_leaves(docs))).drop("siblings").collect()]
    assert sorted(got) == sorted(x[:5] for x in brute(rows))
    if n == 1:
        assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == h()


def test_many_groups_and_an_empty_table(spark):
    rows = [(i, None, f"l{i:04d}", i, f"T{i}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = [tuple(x)[:5] for x in merkle.proofs(merkle.build(merkle.manifest_leaves(docs))).drop("siblings").collect()]
    assert sorted(got) == sorted(x[:5] for x in brute(rows))
    assert merkle.proofs(merkle.build(merkle.manifest_leaves(docs.where("false")))).count() == 0
