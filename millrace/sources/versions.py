"""Folders whose content changes as a whole: versions are written beside each other, one small file names the one in force."""

from __future__ import annotations

from pyspark.sql import SparkSession


class VersionedFolder:
    """`<root>/CURRENT` names the version in force, by one atomic rename. Names of files are relative to root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def read(self, name: str) -> str | None:
        """The text of a small file, None if there is none."""
        at = self._path(f"{self.root}/{name}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(f"{self.root}/{name}"), True)
        out.writeUTF(text)
        out.close()

    def version(self) -> int:
        """0 before anything is published."""
        return int(self.read("CURRENT") or 0)

    def publish(self, version: int) -> None:
        tmp = f"_CURRENT.{version}"
        self.write(tmp, str(version))
        jvm = self.spark.sparkContext._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(self._path(f"{self.root}/{tmp}"), self._path(f"{self.root}/CURRENT"), options)
