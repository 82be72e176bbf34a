"""The folder that all executors share, and tables in it."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pfs
from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession


def hadoop(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """Spark's own file system of a path, and the path as it knows it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme; one without is on the session's own file system."""
    fs, at = hadoop(spark, path)
    return fs.makeQualified(at).toUri().toString().rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or, only where that is
    unset (as in tests), a temporary one that is then set."""
    sc = spark.sparkContext
    have = spark.conf.get("spark.checkpoint.dir", None)
    if have is None:
        found = sc._jsc.sc().getCheckpointDir()
        have = found.get() if found.isDefined() else None
    if have is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        have = "file://" + tempfile.mkdtemp(prefix="threadmill-")
        sc.setCheckpointDir(have)
    return qualified(spark, have)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes the rows as a Parquet table in the shared folder and reads them again: cuts the lineage
    and survives the loss of an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/threadmill-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one job in a folder of their own below the shared one, which clear() removes."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/threadmill-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        fs, at = hadoop(self.spark, self.root)
        fs.delete(at, True)


def file_system(path: str) -> tuple[pfs.FileSystem, str]:
    """The file system of a folder that all executors share, and the path in it."""
    return pfs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)
