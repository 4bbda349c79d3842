"""Small files of a table that are no rows: created whole, replaced by switching, through Spark's file systems."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Folder:
    """One folder on whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._files = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._files.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        """The entries of a folder, hidden ones left out; none if there is no such folder."""
        if not self.exists(name):
            return []
        found = (s.getPath().getName() for s in self._files.listStatus(self._at(name)))
        return sorted(n for n in found if not n.startswith((".", "_")))

    def create(self, name: str, value: dict) -> bool:
        """Write a JSON file that appears whole under its name; False if that is taken."""
        if self.exists(name):
            return False
        above, _, last = name.rpartition("/")
        aside = f"{above}/_{last}-{uuid.uuid4().hex}" if above else f"_{last}-{uuid.uuid4().hex}"
        self._files.mkdirs(self._at(name).getParent())
        out = self._files.create(self._at(aside), True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if not self.exists(name) and self._files.rename(self._at(aside), self._at(name)):
            return True
        self._files.delete(self._at(aside), False)
        return False

    def load(self, name: str) -> dict:
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        stream = self._files.open(self._at(name))
        try:
            return json.loads(text.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def make(self, name: str) -> None:
        self._files.mkdirs(self._at(name))

    def rename(self, name: str, to: str) -> None:
        if not self._files.rename(self._at(name), self._at(to)):
            raise OSError(f"cannot rename {self.path}/{name} to {to}")

    def remove(self, name: str) -> None:
        self._files.delete(self._at(name), True)
