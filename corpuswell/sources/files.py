"""Files of any store that Spark reaches: listing, publishing and removing, through Hadoop's file systems."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """The store that holds a path."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._no_options = spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._fs = self._path(path).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        """Names of what stands in a folder, sorted; none if there is no such folder."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path))) if self.exists(path) else []

    def folders(self, path: str, depth: int) -> list[str]:
        """Paths, relative to path, of the folders that stand `depth` below it and hold files; hidden ones are left out."""
        found = [""]
        for _ in range(depth):
            found = [f"{f}/{n}".lstrip("/") for f in found for n in self.names(f"{path}/{f}") if n[0] not in "._"]
        return found

    def remove(self, path: str) -> int:
        """Removes a folder and gives the number of data files that were in it."""
        if not self.exists(path):
            return 0
        listed, n = self._fs.listFiles(self._path(path), True), 0
        while listed.hasNext():
            n += listed.next().getPath().getName()[0] not in "._"
        self._fs.delete(self._path(path), True)
        return n

    def publish(self, text: str, path: str) -> bool:
        """Writes a small file whole, or not at all; False if one of that name is there. The rename is what makes it visible."""
        draft = f"{path.rpartition('/')[0]}/.{path.rpartition('/')[2]}-{self._jvm.java.util.UUID.randomUUID()}"
        out = self._fs.create(self._path(draft), False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(self._path(draft), self._path(path), self._no_options)
            return True
        except Py4JJavaError as error:
            self._fs.delete(self._path(draft), False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
