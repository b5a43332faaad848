"""Small files on any file system that Spark reads: text, listings, atomic renames."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def make(self, p: str) -> None:
        self.fs.mkdirs(self.path(p))

    def write(self, p: str, data: bytes, overwrite: bool = False) -> None:
        """A whole file, visible under its name once it is complete. Without overwrite, an existing one is an error."""
        if not overwrite and self.exists(p):
            raise FileExistsError(p)
        temp = f"{p}.{uuid.uuid4().hex}.tmp"  # a name of the writer's own, which no other one overwrites before the rename
        out = self.fs.create(self.path(temp), True)
        out.write(data)
        out.close()
        if overwrite and self.exists(p):
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
            options = self.jvm.org.apache.hadoop.fs.Options.Rename
            one = self.jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
            one[0] = options.OVERWRITE
            context.rename(self.path(temp), self.path(p), one)
        elif not self.fs.rename(self.path(temp), self.path(p)):
            self.remove(temp)
            raise FileExistsError(p)

    def read(self, p: str) -> bytes:
        stream = self.fs.open(self.path(p))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def list(self, p: str) -> list[tuple[str, int, str]]:
        """(name, size, path) of what is in a folder, by name."""
        if not self.exists(p):
            return []
        return sorted((s.getPath().getName(), s.getLen(), s.getPath().toString()) for s in self.fs.listStatus(self.path(p)))

    def remove(self, p: str) -> None:
        self.fs.delete(self.path(p), True)
