"""Small files in any store that Spark reaches, through Hadoop's file API."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def names(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs(path).listStatus(self._path(path)))

    def size(self, path: str) -> int:
        """Bytes of a folder's files, those of its folders included."""
        return self._fs(path).getContentSummary(self._path(path)).getLength()

    def read(self, path: str) -> str:
        stream = self._fs(path).open(self._path(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)

    def publish(self, path: str, content: str) -> bool:
        """Write a file whole, unless it is there: False then. A reader sees all of it or nothing."""
        temporary = f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}"
        stream = self._fs(temporary).create(self._path(temporary), True)
        try:
            stream.write(bytearray(content.encode("utf-8")))
        finally:
            stream.close()
        none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
        self.jvm.java.lang.reflect.Array.set(options, 0, none)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(temporary).toUri(), self.conf) if "://" in path else self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.conf)
        try:
            context.rename(self._path(temporary), self._path(path), options)
            return True
        except Exception as e:
            self.delete(temporary)
            if "FileAlreadyExists" in str(e):
                return False
            raise
