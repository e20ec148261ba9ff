import os

import pytest

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    import corpus_pipeline as p

    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = docs.count()
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, DATA).cache()
        assert out.columns == docs.columns and 0 < out.count() <= seen, name
        docs, seen = out, out.count()
    packed = p.STAGES[-1][1](spark, docs, DATA)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}
    assert p.run(spark, DATA).count() == packed.count()


def test_rows_of_one_id_with_unlinked_texts_are_documents_of_their_own(spark):
    from quillstone.llm import jaccard

    near, other, third = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    docs = [(3, near), (5, near + " z"), (5, other), (5, other.upper()), (5, ""), (6, other + " z"), (7, third), (7, third)]
    got = jaccard.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r[0], r[1].lower()) for r in got) == sorted([(3, near), (5, other), (5, ""), (7, third)])


def test_entry_lists_all_operators_and_the_pipeline():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names}


def test_queries_of_this_package_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from quillstone.llm import catalogue

    con = duckdb.connect()
    for t in "documents pages conversations benchmark labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in catalogue.oracle_sql().items():
        got = catalogue.queries()[name](spark, DATA)
        columns = sorted(got.columns)
        mine = sorted(tuple(map(str, (r[c] for c in columns))) for r in got.collect())
        assert mine == sorted(tuple(map(str, r)) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()), name
