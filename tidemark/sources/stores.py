"""The few steps on files that Spark has no writer for, through the file system that Spark itself uses for a path."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """The file system of a path: any that the cluster is configured for."""

    def __init__(self, spark: SparkSession, path: str):
        self._gateway, self._jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._path(path).getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def get(self, path: str) -> bytes:
        """A small file, whatever its name is: Spark's readers pass over names that begin with an underscore."""
        held = self._fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(held))
        finally:
            held.close()

    def put(self, path: str, content: bytes) -> None:
        """A new file; one that exists is an error."""
        out = self._fs.create(self._path(path), False)
        try:
            out.write(bytearray(content))
        finally:
            out.close()

    def rename(self, source: str, target: str) -> None:
        """In one step; a target that exists is an error, where a plain rename would move into it."""
        none = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        self._context.rename(self._fs.makeQualified(self._path(source)), self._fs.makeQualified(self._path(target)), none)

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
