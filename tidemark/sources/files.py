"""Small files beside tables, through Hadoop's FileSystem, in any store that Spark writes."""

from __future__ import annotations

import contextlib
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """Files under a root, by their path within it."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._gateway, self._conf, self.root = spark.sparkContext._jvm, spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration(), root
        self._fs = self.path("").getFileSystem(self._conf)

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def _listed(self, name: str) -> list:
        return list(self._fs.listStatus(self.path(name))) if self.exists(name) else []

    def names(self, name: str = "") -> list[str]:
        """Names of the files in a folder; none if there is no such folder."""
        return [x.getPath().getName() for x in self._listed(name) if not x.isDirectory()]

    def folders(self, name: str = "") -> list[str]:
        return [x.getPath().getName() for x in self._listed(name) if x.isDirectory()]

    def read(self, name: str) -> str:
        with contextlib.closing(self._fs.open(self.path(name))) as stream:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")

    def put(self, name: str, text: str) -> None:
        """Writes a file, over one that is there."""
        with contextlib.closing(self._fs.create(self.path(name), True)) as stream:
            stream.write(bytearray(text.encode()))

    def put_new(self, name: str, text: str) -> bool:
        """Makes a file in one step with its text; False, and nothing changes, if it is there."""
        folder, _, last = name.rpartition("/")
        new = f"{folder}/.{last}.{uuid.uuid4().hex}" if folder else f".{last}.{uuid.uuid4().hex}"
        self.put(new, text)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(name).toUri(), self._conf)
        options = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)  # not over another
        try:
            context.rename(self.path(new), self.path(name), options)
        except Py4JJavaError as e:
            self.delete(new)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)
