"""Small files that appear whole or not at all, on any file system that Spark reaches."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """Paths below one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self._conf)
        self.fs.mkdirs(self.path(""))

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str, overwrite: bool = False) -> bool:
        """Write a file beside its place and rename it there in one step; False if ``name`` is taken."""
        staged = f".staged-{uuid.uuid4().hex}"
        out = self.fs.create(self.path(staged), True)
        out.write(bytearray(text.encode()))
        out.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE if overwrite else rename.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self._conf)
        target = self.path(name)
        self.fs.mkdirs(target.getParent())
        try:
            context.rename(self.fs.makeQualified(self.path(staged)), self.fs.makeQualified(target), options)
        except Exception as e:
            self.delete(staged)
            if not overwrite and "FileAlreadyExists" in str(e):
                return False
            raise
        return True
