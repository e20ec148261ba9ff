"""Trees of text files, listed and read by the executors: the driver holds neither their names nor their sizes."""

from __future__ import annotations

import fnmatch
import math
import posixpath
import re
from functools import reduce

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.slices import BYTES, ROWS
from .scratch import stored

#: Names in a part of the table that they are dealt into, and tasks that a round lists folders in, at most.
FILES, FOLDERS = 4096, 256
#: File name patterns read here; others may name compressed files, which Spark's reader unpacks.
PLAIN = r"\*\.(md|markdown|txt)"


def opened(path: str):
    """The file system of a path or URI, and the path in it. As in Spark, signs of a local path stand for themselves."""
    local = re.sub(r"\Afile:(//(?=/))?", "", path)
    fs, found = arrow_fs.FileSystem.from_uri(path) if "://" in local else (arrow_fs.LocalFileSystem(), local)
    return fs, found.rstrip("/")


def hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def is_tree(path: str, pattern: str) -> bool:
    """Whether ``path`` is a folder that tree_files can list: not a glob, and in a store that Arrow reaches."""
    if re.search(r"[*?\[{\\]", path) or not re.fullmatch(PLAIN, pattern):
        return False
    try:
        fs, root = opened(path)
        return fs.get_file_info(root).type == arrow_fs.FileType.Directory
    except (pa.ArrowException, OSError, ValueError):
        return False


def tree_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """file (below ``path``) of the files that fit the pattern and aren't empty. Each round lists the folders that the last one
    has found into a table of the shared folder."""

    def entries(batches):
        fs, root = opened(path)
        for batch in batches:
            for folder in batch.column("file").to_pylist():
                found = [x for x in fs.get_file_info(arrow_fs.FileSelector(posixpath.join(root, folder))) if not hidden(x.base_name)]
                kept = [x for x in found if x.type == arrow_fs.FileType.Directory or x.size and fnmatch.fnmatchcase(x.base_name, pattern)]
                for at in range(0, len(kept), 10_000):
                    own = kept[at : at + 10_000]
                    yield pa.RecordBatch.from_pydict({"file": [posixpath.join(folder, x.base_name) for x in own], "folder": [x.type == arrow_fs.FileType.Directory for x in own]})

    folders, n, found = spark.createDataFrame([("",)], "file string"), 1, []
    while n:
        found.append(stored(folders.repartition(min(n, FOLDERS)).mapInArrow(entries, "file string, folder boolean"), "listing"))
        folders = found[-1].where("folder").select("file")
        n = folders.count()
    return reduce(DataFrame.unionByName, found).where("NOT folder").select("file")


def tree_texts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """file, value (the whole text) of each of tree_files."""

    def read(batches):
        fs, root = opened(path)
        names, texts, size = [], [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], names=["file", "value"])
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with fs.open_input_stream(posixpath.join(root, name), compression=None) as data:
                    names.append(name)
                    texts.append(data.read())
                size += len(texts[-1])
                if len(names) == ROWS or size >= BYTES:
                    yield made()
                    names, texts, size = [], [], 0
        if names:
            yield made()

    files = tree_files(spark, path, pattern)
    n = files.count()
    parts = max(1, min(n, max(spark.sparkContext.defaultParallelism, math.ceil(n / FILES))))
    # names are dealt out once, into a table; no text is shuffled
    return stored(files.repartition(parts), "files").mapInArrow(read, "file string, value binary").select(F.col("value").cast("string").alias("value"), "file")
