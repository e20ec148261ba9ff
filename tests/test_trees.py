"""Trees listed and read by the executors, against Spark's own reader."""

from pyspark.sql import functions as F

from quillstone.sources import documents, importer, trees


def test_a_tree_is_what_sparks_reader_finds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trees, "FILES", 3)
    root = tmp_path / "a tree+%41é"
    put = {"a.md": "one", "b.MD": "no", "sub/c d+e%20.md": "---\nid: x\n---\ntwo\r\n", "sub/deep/er/é.md": "é\n", "sub/empty.md": "", ".h.md": "no", "_h.md": "no", "_k=1.md": "yes", ".d/x.md": "no", "_d/y.md": "no", "k=2/z.md": "z", "n.txt": "no"}
    for name, text in put.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text.encode())
    (root / "sub/bytes.md").write_bytes(b"\xff\xfe broken \x80")
    rows = lambda df: sorted((r["file"], bytes(r["v"])) for r in df.select("file", F.col("value").cast("binary").alias("v")).collect())
    plain = spark.read.text(str(root), wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True).select("value", documents._file_in(str(root)).alias("file"))
    assert trees.is_tree(str(root), "*.md")
    assert rows(trees.tree_texts(spark, str(root), "*.md")) == rows(plain) and plain.count() == 6
    assert not trees.is_tree(str(root / "a.md"), "*.md") and not trees.is_tree(f"{root}/*", "*.md") and not trees.is_tree("viewfs://store/in", "*.md") and not trees.is_tree(str(root), "*.md.gz")
    (root / "none").mkdir()
    assert documents.load_corpus(spark, str(root / "none")).count() == 0


def test_the_driver_lists_no_files_of_an_import(spark, tmp_path):
    """Spark's file index would hold each of them on the driver."""
    body = "word " * 100
    docs = spark.range(300).select(F.concat(F.lit("g/D"), F.col("id").cast("string"), F.lit(".md")).alias("path"), F.lit(body).alias("text"))
    importer.save_documents(documents.import_tree(docs), str(tmp_path / "t"))
    read = documents.load_corpus(spark, str(tmp_path / "t"))
    assert len(read.inputFiles()) < 50 and read.select("doc_id").distinct().count() == 300
