"""Where a stream's micro-batches go: one folder each, merged as they grow old.

A micro-batch writes its rows to a folder of its own, named by its number, and
overwrites it if Spark repeats the batch; a batch without rows writes nothing.
Every ``every`` batches the folders of finished batches are merged into one
folder of few files by a Spark job, and as many merged folders of one size class
into one of the next, so that a row is written again a logarithmic number of
times and the number of folders grows with the logarithm of the batches.

What is part of the table is said by the manifest: the merged folders and the
last batch in them, a small file that is written beside and renamed, one
version after the other. A reader takes the merged folders of the newest
version and the folders of later batches; a batch that the manifest covers is not
written again, so a repeated one is never counted twice, whenever a job stops.
Folders that were merged are deleted after the next version stands.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from fleetpulse.sources.folder import Folder

BATCH, MERGED, MANIFEST = "batch_id=", "merged-", "manifest-"


@dataclass
class Manifest:
    """``merged`` holds (folder, level) in order of their batches; ``upto`` is the last batch in them."""

    version: int = 0
    upto: int = -1
    merged: list[list] = field(default_factory=list)


class BatchLog:
    """One table of one run of a stream."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | None = None, every: int = 16, file_rows: int = 1_000_000):
        if every < 2:
            raise ValueError("merge at least two folders at a time")
        self.spark, self.schema, self.every, self.file_rows = spark, schema, every, file_rows
        self.folder = Folder(spark, path)

    def manifest(self) -> Manifest:
        versions = [int(n.removeprefix(MANIFEST)) for n in self.folder.names() if n.startswith(MANIFEST)]
        return Manifest(**json.loads(self.folder.read(f"{MANIFEST}{max(versions)}"))) if versions else Manifest()

    def batches(self, after: int) -> list[int]:
        """Numbers of the written batches above one."""
        found = (int(n.removeprefix(BATCH)) for n in self.folder.names() if n.startswith(BATCH))
        return sorted(b for b in found if b > after)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """The rows of a micro-batch; the same batch again replaces them."""
        held = self.manifest()
        if batch_id <= held.upto:
            return
        if rows.isEmpty():
            # A repeated batch has the same rows; this clears what a half-done one left.
            self.folder.delete(f"{BATCH}{batch_id}")
        else:
            rows.write.mode("overwrite").parquet(f"{self.folder.path}/{BATCH}{batch_id}")
        self.merge(batch_id - 1)

    def merge(self, upto: int) -> Manifest:
        """Merge folders of batches up to a finished one, once there are enough of them."""
        held = self.manifest()
        ready = [b for b in self.batches(held.upto) if b <= upto]
        if len(ready) < self.every:
            return held
        merged, old = list(held.merged), [f"{BATCH}{b}" for b in ready]
        merged.append([self._rewrite(old, f"{MERGED}{held.version + 1}-0"), 0])
        level = 0
        while len(last := [m for m in merged if m[1] == level]) >= self.every:
            names = [name for name, _ in last]
            merged = [m for m in merged if m[1] != level]
            merged.append([self._rewrite(names, f"{MERGED}{held.version + 1}-{level + 1}"), level + 1])
            old += names
            level += 1
        after = Manifest(held.version + 1, upto, sorted(merged, key=lambda m: -m[1]))
        self.folder.write(f"{MANIFEST}{after.version}", json.dumps(vars(after)))
        for name in [*old, f"{MANIFEST}{held.version}"]:
            self.folder.delete(name)
        return after

    def _rewrite(self, names: list[str], into: str) -> str:
        rows = self._read(names)
        files = -(-rows.count() // self.file_rows)
        rows.coalesce(max(files, 1)).write.mode("overwrite").parquet(f"{self.folder.path}/{into}")
        return into

    def _read(self, names: list[str]) -> DataFrame:
        reader = self.spark.read if self.schema is None else self.spark.read.schema(self.schema)
        return reader.parquet(*[f"{self.folder.path}/{n}" for n in names])

    def read(self) -> DataFrame:
        """All rows of the table, every batch once."""
        held = self.manifest()
        names = [name for name, _ in held.merged] + [f"{BATCH}{b}" for b in self.batches(held.upto)]
        if not names:
            if self.schema is None:
                raise ValueError(f"no batch with rows in {self.folder.path}")
            return self.spark.createDataFrame([], self.schema)
        return self._read(names)
