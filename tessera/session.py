"""Session construction and the shared scratch area that every job uses to cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process on one machine."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset, a fresh one in local mode only (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_shipped: set[str] = set()


def ship_package(spark: SparkSession | None = None) -> None:
    """Send this package to the Python workers of ``spark`` (or the active session), once an application.

    Only in local mode are workers known to have the driver's path; that holds the package if it is a folder on it.
    """
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    package = Path(__file__).resolve().parent
    root, app = str(package.parent), spark.sparkContext.applicationId
    on_path = root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == root
    if app in _shipped or is_local(spark) and on_path:
        return
    archive = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


class Scratch:
    """Tables written to the shared folder so that later steps read rows instead of recomputing them.

    Written tables survive lost executors, unlike cached or locally checkpointed ones.
    """

    def __init__(self, spark: SparkSession, label: str):
        ship_package(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n, self._names = 0, []

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        """Write ``df`` as Parquet; return the reread table and its path."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def table(self, df: DataFrame) -> DataFrame:
        return self.write(df)[0]

    def bucketed(self, df: DataFrame, key: str) -> DataFrame:
        """Write ``df`` in buckets of ``key``, as many as a shuffle has partitions; later joins on ``key`` don't shuffle it again."""
        self._n += 1
        name, n = f"tessera_{uuid.uuid4().hex}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = df.repartition(n, key).write.format("parquet").option("compression", "zstd").option("path", f"{self.root}/{self._n}")
        rows.bucketBy(n, key).sortBy(key).saveAsTable(name)
        self._names.append(name)
        return self.spark.table(name)

    def drop(self, path: str) -> None:
        """Delete a table that no later step reads."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)

    def drop_all(self) -> None:
        """Delete all tables written here; call it when no later step reads any."""
        while self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._names.pop()}")
        self.drop(self.root)
