"""Session helpers: SQL settings the plans rely on, and shared scratch tables."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Set runtime SQL options the plans count on.

    * time zone UTC: naive timestamps in files mean the same everywhere;
    * methods above 8000 bytecodes are never JIT-compiled, so let Spark fall
      back to split projections there instead of one huge generated method.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    fall back to a folder of its own, since all tasks then share this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        current = spark.sparkContext.getCheckpointDir()
        root = current
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and lets later stages prune
    columns of an expensive intermediate result.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch_path = path
    _WRITTEN.append(path)
    return written


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote, once nothing reads it any more."""
    _delete(df.sparkSession, df.scratch_path)


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own in the shared folder; ``discard_all`` deletes it."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def discard_all(spark: SparkSession) -> None:
    """Delete everything written so far, once no result is read any more."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())


def _delete(spark: SparkSession, name: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into exactly ``spark.sql.shuffle.partitions``.

    The windows that follow reuse this partitioning.  A named count keeps
    adaptive execution from coalescing it: the stages behind it are bound by
    CPU, not by bytes.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, as ``--py-files`` would.

    Spark's file server hands the archive to every executor, late ones too.
    """
    sc = spark.sparkContext
    if _SHIPPED.get("app") != sc.applicationId:
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="spark-")) / package.name
        archive = shutil.make_archive(str(target), "zip", root_dir=package.parent, base_dir=package.name)
        sc.addPyFile(archive)
        # The helper that plans stateful streaming runs beside the driver and
        # does not unpack added files; it reads this path instead.
        paths = [str(package.parent), sc.environment.get("PYTHONPATH", "")]
        sc.environment["PYTHONPATH"] = ":".join(p for p in paths if p)
        _SHIPPED["app"] = sc.applicationId
    return spark


_SHIPPED: dict[str, str] = {}
_WRITTEN: list[str] = []
