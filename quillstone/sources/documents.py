"""Documents from files, uploads, PDF items and external trees."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE, col, slug, strip_templates, trimmed, upload_locale, word_count
from .trees import is_tree, tree_texts

DOCUMENT = ["doc_id", "title", "category", "collection", "tags", "locale", "updated", "owner", "audience", "source", "body"]
FENCE = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?"
#: A body below this length is a stub.
STUB = 400


def parse_frontmatter(raw: Column | str) -> Column:
    """struct<meta map<string, struct<s string, a array<string>>>, body string>.

    A fence of --- lines at the start holds `key: value` lines; others are passed over. Values in brackets are arrays without
    their empty parts; matching quotes go. Of a repeated key the last counts. Without a fence: no keys, the trimmed text.
    """
    raw = col(raw)
    inner = F.regexp_extract(raw, FENCE, 1)
    pair = r"\A([A-Za-z_][A-Za-z0-9_-]*):" + SPACE + r"*(.*)\z"
    lines = F.filter(F.split(inner, r"\r?\n"), lambda x: x.rlike(pair))

    def unquoted(v: Column) -> Column:
        both = ((v.startswith('"') & v.endswith('"')) | (v.startswith("'") & v.endswith("'"))) & (F.length(v) > 1)
        return F.when(both, F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)

    def entry(line: Column) -> Column:
        v = trimmed(F.regexp_extract(line, pair, 2))
        listed = v.startswith("[") & v.endswith("]")
        parts = F.filter(F.transform(F.split(F.substring(v, F.lit(2), F.length(v) - 2), ","), lambda x: unquoted(trimmed(x))), lambda x: x != "")
        return F.struct(F.regexp_extract(line, pair, 1).alias("k"), F.struct(F.when(~listed, unquoted(v)).alias("s"), F.when(listed, parts).alias("a")).alias("v"))

    found = F.transform(lines, entry)
    last = F.filter(found, lambda e, i: ~F.exists(F.slice(found, i + 2, F.size(found)), lambda later: later["k"] == e["k"]))
    has = raw.rlike(FENCE)
    empty = F.expr("cast(map() as map<string, struct<s:string, a:array<string>>>)")
    return F.struct(
        F.when(has, F.map_from_entries(last)).otherwise(empty).alias("meta"), trimmed(F.when(has, F.regexp_replace(raw, FENCE, "")).otherwise(raw)).alias("body")
    )


def _meta(key: str, default: Column) -> Column:
    return F.coalesce(F.try_element_at("_f.meta", F.lit(key))["s"], default)


def _documents(parsed: DataFrame, stem: Column, **defaults: Column) -> DataFrame:
    fixed = {
        "category": F.lit("general"), "collection": F.lit("default"), "locale": F.lit("en"), "updated": F.lit(None).cast("string"),
        "owner": F.lit("unknown"), "audience": F.lit("internal"), "source": F.lit("bundled"),
    } | defaults
    rows = parsed.select(
        _meta("id", stem).alias("doc_id"), _meta("title", stem).alias("title"), F.coalesce(F.try_element_at("_f.meta", F.lit("tags"))["a"], F.expr("cast(array() as array<string>)")).alias("tags"),
        F.col("_f.body").alias("body"), *[_meta(k, v).alias(k) for k, v in fixed.items()],
    )
    return rows.select(*DOCUMENT)


def _file_in(root: str) -> Column:
    """The path of the file read, below ``root``; names are decoded. The whole path where it does not hold the root (a glob)."""
    bare = posixpath.normpath(re.sub(r"\A[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root)).strip("/") + "/"
    whole = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))
    at = F.locate(bare, whole)
    return F.when(at > 0, F.substring(whole, at + len(bare), F.length(whole))).otherwise(whole)


def load_corpus(spark: SparkSession, *paths: str, suffix: str = "*.md") -> DataFrame:
    """Documents of markdown trees: frontmatter, then defaults; id and title fall back to the file's stem. Of files at
    equal paths below their trees that of the later tree counts; equal names in different folders are different files. Folders are
    listed and read by the executors (see trees); globs, single files, other suffixes and stores that Arrow doesn't reach by Spark's reader."""
    raw = None
    for k, path in enumerate(paths):
        if is_tree(path, suffix):
            own = tree_texts(spark, path, suffix)
        else:  # Spark's driver holds the names of all files
            own = spark.read.text(path, wholetext=True, pathGlobFilter=suffix, recursiveFileLookup=True).select("value", _file_in(path).alias("file"))
        own = own.withColumn("_k", F.lit(k))
        raw = own if raw is None else raw.unionByName(own)
    # the files of one tree have a path each: nothing to choose, no text is shuffled
    chosen = raw.groupBy("file").agg(F.max_by("value", "_k").alias("value")) if len(paths) > 1 else raw
    return _documents(chosen.withColumn("_f", parse_frontmatter("value")), F.regexp_replace(F.regexp_extract("file", r"([^/]+)\z", 1), r"(?i)\.(md|txt|markdown)\z", ""))


def docs_from_files(files: DataFrame, name_col="name", text_col="text") -> DataFrame:
    """Uploaded files as documents: extension .md, .txt or .markdown in any case; the title is the frontmatter's, the first heading of
    up to three hashes, or the stem; the id is a slug of the stem and a hash of the content, so a repeated upload replaces its document.
    """
    stem = F.regexp_replace(F.col(name_col), r"(?i)\.(md|txt|markdown)\z", "")
    parsed = files.where(F.lower(name_col).rlike(r"\.(md|txt|markdown)\z")).withColumn("_f", parse_frontmatter(text_col)).withColumn("_stem", stem)
    heading = F.nullif(F.regexp_extract("_f.body", r"(?m)^#{1,3}[ \t]+(.+)$", 1), F.lit(""))
    tags = F.coalesce(F.try_element_at("_f.meta", F.lit("tags"))["a"], F.expr("cast(array() as array<string>)"))
    return parsed.select(
        F.concat(F.lit("user-"), slug("_stem"), F.lit("-"), F.substring(F.sha2(F.col(text_col), 256), 1, 8)).alias("doc_id"),
        _meta("title", F.coalesce(heading, F.col("_stem"))).alias("title"), _meta("category", F.lit("uploads")).alias("category"), F.lit("your-documents").alias("collection"),
        tags.alias("tags"), upload_locale("_f.body").alias("locale"), F.date_format(F.current_date(), "yyyy-MM-dd").alias("updated"),
        F.lit("you").alias("owner"), F.lit("private").alias("audience"), F.lit("upload").alias("source"), F.col("_f.body").alias("body"),
    )


def import_tree(files: DataFrame, most: int | None = None, path_col="path", text_col="text") -> DataFrame:
    """External markdown files (relative path, text) as documents: cleaned of templates and HTML, stubs dropped, category is the first
    folder, the id a slug of at most 80 characters; at most ``most`` of them, in path order."""
    parsed = files.where(F.col(path_col).endswith(".md")).withColumn("_f", parse_frontmatter(text_col)).withColumn("_b", strip_templates("_f.body"))
    kept = parsed.where(F.length("_b") >= STUB)
    kept = kept.orderBy(path_col).limit(most) if most else kept
    return kept.select(
        slug(F.concat(F.lit("ext-"), F.regexp_replace(path_col, r"\.md\z", "")), 80).alias("doc_id"), _meta("title", F.col(path_col)).alias("title"),
        F.split(path_col, "/")[0].alias("category"), F.lit("imported").alias("collection"), F.expr("cast(array() as array<string>)").alias("tags"), F.lit("en").alias("locale"),
        _meta("date", F.lit("2026-01-01")).alias("updated"), F.lit("imported").alias("owner"), F.lit("external").alias("audience"), F.lit("import").alias("source"), F.col("_b").alias("body"),
    )


def with_order(bundled: DataFrame, uploaded: DataFrame | None = None) -> DataFrame:
    """All documents with the columns that order them: bundled by `updated`, newest first, without a date last; then uploads."""
    out = bundled.withColumn("_part", F.lit(0))
    if uploaded is not None:
        out = out.unionByName(uploaded.withColumn("_part", F.lit(1)))
    return out.withColumn("_updated", F.when(F.col("_part") == 0, F.coalesce("updated", F.lit(""))).otherwise(""))


def lines_from_items(items: Column | str) -> Column:
    """The text of a PDF page from array<struct<str, x, y, width>>: an item more than 2 off in y begins a line; a gap over 14 is a cell mark."""
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("end"), F.lit(True).alias("fresh"))

    def step(acc: Column, i: Column) -> Column:
        y = F.floor(i["y"].cast("double") + 0.5).cast("double")
        broken = acc["y"].isNotNull() & (F.abs(y - acc["y"]) > 2)
        fresh, end = acc["fresh"] | broken, F.when(~broken, acc["end"])
        word = trimmed(i["str"])
        gap = F.when((i["x"] - end) > 14, " | ").otherwise(" ")
        text = F.when(word == "", acc["text"]).when(fresh, F.concat(acc["text"], F.when(acc["text"] == "", "").otherwise("\n"), word)).otherwise(F.concat(acc["text"], gap, word))
        return F.struct(text.alias("text"), y.alias("y"), (i["x"] + F.coalesce(i["width"], F.lit(0.0))).cast("double").alias("end"), (fresh & (word == "")).alias("fresh"))

    return F.aggregate(col(items), start, step, lambda acc: acc["text"])


def pdf_documents(pages: DataFrame, name_col="name", page_col="page", items_col="items") -> DataFrame:
    """name, text, pages of PDF files from their pages' items: lines_from_items of each page in order, joined by a blank line, at most
    two newlines in a row, trimmed. A page without items is an empty one; a file's pages are gathered, not files."""
    lines = pages.select(F.col(name_col).alias("name"), F.col(page_col).alias("_p"), F.coalesce(lines_from_items(items_col), F.lit("")).alias("_t"))
    whole = lines.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("_p", "_t"))).alias("_all"), F.count("*").alias("pages"))
    text = F.array_join(F.transform("_all", lambda x: x["_t"]), "\n\n")
    return whole.select("name", trimmed(F.regexp_replace(text, r"\n{3,}", "\n\n")).alias("text"), "pages")


def read_pdf_items(spark: SparkSession, path: str) -> DataFrame:
    """Pages of PDF files as an extractor leaves them: JSON lines of name, page and items (str, x, y, width)."""
    return spark.read.schema("name string, page int, items array<struct<str:string, x:double, y:double, width:double>>").json(path)


def corpus_stats(docs: DataFrame, by: str, text_col="body") -> DataFrame:
    """by, docs, words."""
    return docs.groupBy(by).agg(F.count("*").alias("docs"), F.sum(word_count(F.coalesce(F.col(text_col), F.lit("")))).alias("words"))
