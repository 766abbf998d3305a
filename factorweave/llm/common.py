"""Session helpers of the text operators: shared folders, checkpoints, input columns."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only where that is unset on one machine, as in tests, a local folder is made.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), f"factorweave-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


_made: list[str] = []


def scratch(spark: SparkSession, name: str, paths: list[str] | None = None) -> str:
    """A fresh folder for one table under the shared folder.

    It is added to `paths`, for a caller that deletes it, or else to those that
    clear_scratch() deletes.
    """
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (_made if paths is None else paths).append(path)
    return path


def saved(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Writes df once as Parquet into a scratch folder and reads it back: its lineage ends there."""
    path = scratch(df.sparkSession, name, paths)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders of the shared folder; paths is empty then."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keep(paths: list[str]) -> None:
    """Leaves folders to clear_scratch()."""
    _made.extend(paths)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all tables and files that operators have stored, once their results are written or no longer needed."""
    delete(spark, _made)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path in the shared folder and the path there, for readers and writers in tasks."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Lets Arrow batches have at most so many rows: by default they may hold 10,000 long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (doc_id long, text string): other columns, whatever their names, don't matter."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def fresh(name: str, columns: list[str]) -> str:
    """A column name that none of the columns has, whatever their case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """128 bits of id and text in which nulls count: only repeated rows are alike in it."""
    id_, text = F.col(f"`{id_col}`").cast("long").cast("string"), F.col(f"`{text_col}`").cast("string")
    return F.unhex(F.md5(F.concat(F.coalesce(id_, F.lit("none")), F.lit(":"), F.coalesce(F.concat(F.lit("="), text), F.lit("none")))))


def short_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """64 bits of row_key as a number, for operators whose ids are numbers."""
    return F.xxhash64(row_key(id_col, text_col))


_LOCAL = (1 << 33) - 1  # monotonically_increasing_id() counts the rows of a partition in these bits


def ordered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df sorted over all partitions and stored, with `part` and the row's place `at` in it."""
    out = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    return saved(out.select("*", F.shiftright("place", 33).cast("int").alias("part"), F.col("place").bitwiseAND(F.lit(_LOCAL)).alias("at")).drop("place"), name)


def sums_before(df: DataFrame, sums: dict[str, str]) -> DataFrame:
    """One row for each partition: what all partitions before it sum up to; as many rows as partitions."""
    parts = df.groupBy("part").agg(*[F.expr(e).alias(c) for c, e in sums.items()])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in sums])
