"""Tables and folders that the library stores for itself, in the folder all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where that is unset and Spark is local."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"factorweave-{os.getuid()}")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind; else they lie on the executors' disks until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old)


@dataclass
class Store:
    """Folders and bucketed tables that are dropped together by close(), or at the end of a with block."""

    spark: SparkSession
    paths: list[str] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)

    def folder(self, name: str) -> str:
        self.paths.append(f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}")
        return self.paths[-1]

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        """df as Parquet: its lineage ends there."""
        path = self.folder(name)
        with shuffles_dropped(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, key: str, order: str, buckets: int, name: str) -> DataFrame:
        """df dealt into buckets of a key and sorted in them, so that windows by that key need no exchange.

        One file a bucket: the order within a bucket holds for a whole read.
        """
        table, path = f"{name}_{uuid.uuid4().hex}", self.folder(name)
        self.tables.append(table)
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key, order).option("path", path).format("parquet").saveAsTable(table)
        return self.spark.table(table)

    def close(self) -> None:
        while self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop()}")
        while self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()
