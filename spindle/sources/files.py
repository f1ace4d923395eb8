"""Small files on whatever file system Spark's paths name."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """Read, write and list through Hadoop, so that the data folder may be local or shared."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark._jvm
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()

    def path(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf).makeQualified(p)

    def _fs(self, path: str):
        return self.path(path).getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self.path(path))

    def make(self, path: str) -> None:
        self._fs(path).mkdirs(self.path(path))

    def delete(self, path: str) -> None:
        self._fs(path).delete(self.path(path), True)

    def listed(self, path: str) -> list[tuple[str, bool]]:
        """(name, whether it is a folder), by name."""
        if not self.exists(path):
            return []
        return sorted((s.getPath().getName(), s.isDirectory()) for s in self._fs(path).listStatus(self.path(path)))

    def read(self, path: str) -> str:
        stream = self._fs(path).open(self.path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """The whole text or nothing: a temporary file takes the name's place at once."""
        self._put(path, text, "OVERWRITE")

    def claim(self, path: str, text: str) -> bool:
        """Write the whole text where nothing is; False, and nothing done, where something is."""
        try:
            self._put(path, text, "NONE")
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _put(self, path: str, text: str, mode: str) -> None:
        temporary = f"{path}.{uuid.uuid4().hex}.tmp"
        stream = self._fs(path).create(self.path(temporary), True)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()
        fs = self.jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(self.path(path).toUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(getattr(fs, "Options$Rename"), mode)
        try:
            context.rename(self.path(temporary), self.path(path), options)
        except Py4JJavaError:
            self.delete(temporary)
            raise
