"""A sink of markdown files with frontmatter: all files of a write become visible at once, or none."""

from __future__ import annotations

import posixpath
import re
import uuid
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .manifest import Manifest
from .trees import opened

NAME = "markdown_documents"
FIELDS = ["doc_id", "title", "category", "collection", "tags", "locale", "updated", "owner", "audience"]


def markdown(row) -> str:
    """The file of a document: a fence with its fields, then the body. Values stay on their line, quotes in the title become single."""
    line = lambda x: re.sub(r"[\r\n]+", " ", str(x))
    out = ["---", f"id: {line(row['doc_id'])}", 'title: "' + line(row["title"] or row["doc_id"]).replace('"', "'") + '"']
    for name in FIELDS[2:]:
        value = row[name]
        if name == "tags":
            out.append(f"tags: [{', '.join(line(t) for t in value or [])}]")
        elif value is not None:
            out.append(f"{name}: {line(value)}")
    return "\n".join([*out, "---", "", row["body"] or ""])


def file_name(doc_id: str) -> str:
    """A name that no two ids share and that every store takes."""
    return re.sub(r"[^A-Za-z0-9._-]", lambda m: "%" + m[0].encode("utf-8", "surrogatepass").hex(), doc_id) + ".md"


@dataclass
class Written(WriterCommitMessage):
    files: int


class MarkdownWriter(DataSourceWriter):
    """Tasks write into a hidden folder; the commit renames it, which is what makes it visible; an abort removes it."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.stamp = path, overwrite, uuid.uuid4().hex

    def _open(self):
        return opened(self.path)

    def write(self, iterator) -> WriterCommitMessage:
        fs, base = self._open()
        # a task that runs twice writes the same files to a folder of its own try
        folder = posixpath.join(base, f".staged-{self.stamp}", uuid.uuid4().hex)
        fs.create_dir(folder, recursive=True)
        names = set()
        for row in iterator:
            name = file_name(row["doc_id"])
            if name in names:
                raise ValueError(f"two documents of the id {row['doc_id']}")
            names.add(name)
            with fs.open_output_stream(posixpath.join(folder, name)) as out:
                out.write(markdown(row).encode())
        message = Written(len(names))
        message.folder = folder
        return message

    def commit(self, messages) -> None:
        fs, base = self._open()
        staged = posixpath.join(base, f".staged-{self.stamp}")
        good = {m.folder for m in messages if m is not None}
        for x in fs.get_file_info(arrow_fs.FileSelector(staged, allow_not_found=True)):
            if posixpath.join(staged, x.base_name) not in good:  # what a failed try left
                fs.delete_dir(x.path)
        old = [x.path for x in fs.get_file_info(arrow_fs.FileSelector(base)) if x.base_name.startswith("import-")]
        fs.create_dir(staged, recursive=True)
        fs.move(staged, posixpath.join(base, f"import-{self.stamp}"))
        for x in old if self.overwrite else ():
            fs.delete_dir(x)

    def abort(self, messages) -> None:
        fs, base = self._open()
        staged = posixpath.join(base, f".staged-{self.stamp}")
        if fs.get_file_info(staged).type != arrow_fs.FileType.NotFound:
            fs.delete_dir(staged)


class MarkdownDocuments(DataSource):
    """df.write.format("markdown_documents").mode("append" or "overwrite").save(path) of document columns; read with load_corpus."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        missing = {*FIELDS, "body"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"documents lack {sorted(missing)}")
        return MarkdownWriter(self.options["path"], overwrite)


def save_documents(docs: DataFrame, path: str, mode: str = "append") -> None:
    """Writes documents as files below ``path``, a folder that all executors share. A file system without a rename of folders has no sink here."""
    docs.sparkSession.dataSource.register(MarkdownDocuments)
    docs.select(*FIELDS, "body").write.format(NAME).mode(mode).save(path)


def clear_index(spark: SparkSession, path: str, sign: str | None = None) -> list[str]:
    """Deletes what save_index has stored under the signature, or under all; the folders that went."""
    files = Manifest(spark, path)
    gone = [x for x in files.folders(path) if x.startswith("sig=") and sign in (None, x[4:])]
    for x in gone:
        files.delete(f"{path.rstrip('/')}/{x}")
    return gone
