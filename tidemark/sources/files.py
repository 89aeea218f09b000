"""Folders on Hadoop file systems: listing, and a rename that takes a name exclusively."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """What a store needs of the file system under its root, which must rename atomically."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root, self._gateway = root, spark.sparkContext._gateway
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self._fs.Path(name)

    @property
    def system(self):
        return self.path(self.root).getFileSystem(self._conf)

    def listed(self, folder: str) -> list[tuple[str, int]]:
        """(name, time of modification in milliseconds) of what a folder holds; nothing if it isn't there."""
        if not self.system.exists(self.path(folder)):
            return []
        return [(x.getPath().getName(), x.getModificationTime()) for x in self.system.listStatus(self.path(folder))]

    def size(self, folder: str) -> int:
        return self.system.getContentSummary(self.path(folder)).getLength()

    def exists(self, name: str) -> bool:
        return self.system.exists(self.path(name))

    def delete(self, name: str) -> bool:
        return self.system.delete(self.path(name), True)

    def take(self, staged: str, name: str) -> bool:
        """Renames staged to name; False, and nothing is moved, if name is there already."""
        context = self._fs.FileContext.getFileContext(self.path(self.root).toUri(), self._conf)
        rename = getattr(self._fs, "Options$Rename")
        try:
            context.rename(self.path(staged), self.path(name), self._gateway.new_array(rename, 0))
        except Exception as error:
            if "FileAlreadyExists" not in str(error):
                raise
            return False
        return True
