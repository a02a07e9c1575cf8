"""A folder that the driver and all executors share, for tables that a plan needs in between."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it is unset, local mode gets a folder of its own; a cluster must name one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if not found and current.isDefined():
        found = current.get()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tracklight-")
    if not current.isDefined():
        sc.setCheckpointDir(found)
    return found


def folder(spark: SparkSession) -> str:
    """A new folder of its own in the shared one."""
    return f"{shared_folder(spark)}/tracklight-{uuid.uuid4().hex}"


class Scope:
    """Tables in the shared folder that one computation needs in between, each computed once however often it is read; drop() removes them all."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.n = spark, folder(spark), 0

    def written(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, in a scope of its own."""
    return Scope(df.sparkSession).written(df)
