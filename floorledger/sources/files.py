"""Small files on the session's file systems: names, texts, and files that only one writer can make."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder of any file system that Spark itself can reach; only names and short texts pass through the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._gateway, self.path = spark._jvm, spark.sparkContext._gateway, path.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self._files = self._at(self.path).getFileSystem(self._conf)

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, below: str = "") -> list[str]:
        """Names in the folder, or in one below it; none if it is not there."""
        path = self._at(f"{self.path}/{below}".rstrip("/"))
        return [f.getPath().getName() for f in self._files.listStatus(path)] if self._files.exists(path) else []

    def changed(self, name: str) -> float:
        """When a name was last changed, in seconds."""
        return self._files.getFileStatus(self._at(f"{self.path}/{name}")).getModificationTime() / 1000

    def read(self, name: str) -> str:
        stream = self._files.open(self._at(f"{self.path}/{name}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def make(self, name: str, text: str) -> bool:
        """Make a file with all of ``text``, or nothing and ``False`` if the name is taken: readers never see a part of it."""
        draft = self._at(f"{self.path}/.{name}.{uuid.uuid4().hex}")
        stream = self._files.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return self._rename_new(draft, self._at(f"{self.path}/{name}"))

    def _rename_new(self, draft, final) -> bool:
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        kind = getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename")
        none = self._gateway.new_array(kind, 1)
        none[0] = kind.NONE  # fails if the name is taken
        try:
            context.rename(self._files.makeQualified(draft), self._files.makeQualified(final), none)
            return True
        except Exception:
            self._files.delete(draft, False)
            if self._files.exists(final):
                return False
            raise

    def delete(self, name: str) -> None:
        self._files.delete(self._at(f"{self.path}/{name}"), True)
