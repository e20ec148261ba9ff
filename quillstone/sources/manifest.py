"""A log of small JSON states on shared storage: a state is there whole or not at all, the last one counts."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Manifest:
    """``path``/00000001.json, 00000002.json, ... One writer at a time; readers see the last state that was committed."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.folder = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _child(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.folder, name)

    def last(self) -> tuple[int, dict]:
        """The number of the last state and the state; (0, {}) if there is none."""
        if not self.fs.exists(self.folder):
            return 0, {}
        names = [str(x.getPath().getName()) for x in self.fs.listStatus(self.folder)]
        number = max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)
        if not number:
            return 0, {}
        stream = self.fs.open(self._child(f"{number:08d}.json"))
        try:
            return number, json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, after: int, state: dict) -> int:
        """Writes the state beside the log and renames it to the next number. If another writer has taken that number this raises."""
        self.fs.mkdirs(self.folder)
        name = self._child(f"{after + 1:08d}.json")
        draft = self._child(f".{after + 1:08d}-{self.jvm.java.util.UUID.randomUUID().toString()}")
        stream = self.fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        finally:
            stream.close()
        if self.fs.exists(name) or not self.fs.rename(draft, name):
            self.fs.delete(draft, False)
            raise RuntimeError(f"another writer has committed {name}")
        return after + 1

    def delete(self, path: str) -> None:
        self.fs.delete(self.jvm.org.apache.hadoop.fs.Path(path), True)

    def folders(self, path: str) -> list[str]:
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return [str(x.getPath().getName()) for x in self.fs.listStatus(at) if x.isDirectory()] if self.fs.exists(at) else []
