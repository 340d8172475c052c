"""Small files in a file system that Spark reads: written under a new name and moved into place, never over another.

That a file is never moved over another holds for local folders and for file systems whose rename is atomic and fails where there is
a target, as HDFS's does. Object stores have no such rename; they are refused where commits depend on it (`needs_exclusive`).
"""

from __future__ import annotations

import os
import time
import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession


#: Schemes of stores that copy where they should rename.
OBJECT_STORES = frozenset("s3 s3a s3n gs oss cos cosn swift wasb wasbs obs".split())


class Storage:
    """Files below one folder, by paths relative to it."""

    def __init__(self, spark: SparkSession, home: str):
        self.jvm, self.home = spark._jvm, home.rstrip("/")
        self.hadoop = self.jvm.org.apache.hadoop.fs
        self.root = self.hadoop.Path(self.home)
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self.root.getFileSystem(self.conf)

    def needs_exclusive(self) -> None:
        """Raises where create() can't keep two writers apart."""
        if (scheme := self.fs.getUri().getScheme()) in OBJECT_STORES:
            raise ValueError(f"{scheme}: commits need a file system with an atomic rename, such as HDFS")

    def path(self, name: str) -> str:
        return f"{self.home}/{name}"

    def _at(self, name: str):
        return self.hadoop.Path(self.path(name))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def names(self, folder: str) -> list[str]:
        """The names in a folder, sorted; none where it does not exist."""
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at(folder)))

    def age(self, name: str) -> float:
        """Seconds since a file, or any entry right below a folder, was last changed; 0 for what is not there."""
        if not self.exists(name):
            return 0.0
        own = self.fs.getFileStatus(self._at(name))
        times = [own.getModificationTime(), *([x.getModificationTime() for x in self.fs.listStatus(self._at(name))] if own.isDirectory() else [])]
        return time.time() - max(times) / 1000

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> bool:
        """Makes the file with all its bytes; False, and nothing changed, if there is one."""
        if self.fs.getUri().getScheme() == "file":  # there Hadoop's rename would not notice a writer that comes in between
            return self._create_local(self._at(name).toUri().getPath(), data)
        folder = name.rpartition("/")[0]
        hidden = f"{folder}/.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self._at(hidden), True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        if self.exists(name):
            self.delete(hidden)
            return False
        context = self.hadoop.FileContext.getFileContext(self.root.toUri(), self.conf) if self.root.toUri().getScheme() else self.hadoop.FileContext.getFileContext(self.conf)
        try:
            context.rename(self._at(hidden), self._at(name), SparkContext._gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0))
            return True
        except Exception as e:  # noqa: BLE001  Hadoop's own exception, by its text
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                self.delete(hidden)
                return False
            raise

    @staticmethod
    def _create_local(path: str, data: bytes) -> bool:
        folder, name = os.path.split(path)
        os.makedirs(folder, exist_ok=True)
        hidden = os.path.join(folder, f".{uuid.uuid4().hex}.tmp")
        with open(hidden, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(hidden, path)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(hidden)

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)
