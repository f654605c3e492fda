"""Small files beside tables: manifests that say which folders a table is made of."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """The few file operations a manifest needs, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.make, self.path = jvm.org.apache.hadoop.fs.Path, path.rstrip("/")
        self.system = self.make(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        at = self.make(self.path)
        return [s.getPath().getName() for s in self.system.listStatus(at)] if self.system.exists(at) else []

    def delete(self, name: str) -> None:
        self.system.delete(self.make(f"{self.path}/{name}"), True)

    def read(self, name: str) -> str:
        stream = self.system.open(self.make(f"{self.path}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Appears whole or not at all."""
        beside = self.make(f"{self.path}/_{name}")
        stream = self.system.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.system.rename(beside, self.make(f"{self.path}/{name}")):
            raise RuntimeError(f"{self.path}/{name} exists already: two streams write to one table")
