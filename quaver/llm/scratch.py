"""Lineage cuts that survive the loss of an executor.

A cut is a Parquet table in the shared folder named by ``spark.checkpoint.dir``.  Where the session
leaves that setting empty (tests, notebooks) a temporary folder is used on a single machine; on a
cluster that raises, as no two machines would see the same tables.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for written cuts: ``spark.checkpoint.dir``, or a temporary one if it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="quaver-")
    return _own[app]


class Cut:
    """One written table; ``drop()`` removes it once nothing reads it any more."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/quaver/{name}-{uuid.uuid4().hex[:12]}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    return Cut(df, name).df


def swept(spark: SparkSession) -> None:
    """Lets the shuffle files of finished jobs go, which else stay until the driver happens to collect its garbage."""
    spark.sparkContext._jvm.System.gc()
