"""Files as such: existence, listing, deletion, and creation that fails if the file is there.

Spark writes tables; a commit is one small file that must appear whole and only once, which needs the
file system itself, reached through Hadoop's client.  The rename must fail if the name is taken, as it does on
HDFS and local disks; where a store only checks before it renames, two writers at the same moment could both win.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Storage:
    def __init__(self, spark: SparkSession, root: str):
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._hadoop.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str, starting: str = "") -> list[str]:
        """Names in a folder, sorted; none if it is not there."""
        if not self.exists(path):
            return []
        return sorted(n for s in self._fs.listStatus(self._path(path)) if (n := s.getPath().getName()).startswith(starting))

    def modified(self, path: str) -> int:
        return self._fs.getFileStatus(self._path(path)).getModificationTime()

    def size(self, path: str) -> int:
        """Bytes of all files below a folder."""
        return self._fs.getContentSummary(self._path(path)).getLength()

    def read(self, path: str) -> str:
        """The text of a small file."""
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def create(self, path: str, text: str) -> bool:
        """Write a small file that must not exist yet; False if it does.

        The text is written under a hidden name and renamed, so readers see all of it or nothing, and
        of two writers the second finds the name taken.
        """
        folder, _, name = path.rpartition("/")
        hidden = f"{folder}/_{name}-{uuid.uuid4().hex[:12]}"
        out = self._fs.create(self._path(hidden), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf)
        options = self._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(self._path(hidden)), self._fs.makeQualified(self._path(path)), options)
        except Py4JJavaError as error:
            self._fs.delete(self._path(hidden), False)
            if "FileAlreadyExists" in str(error.java_exception):
                return False
            raise
        return True
