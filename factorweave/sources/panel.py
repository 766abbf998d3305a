"""Panels: long tables keyed by (SecuCode, TradingDay), and readers and writers around them."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorweave.functions.stats import DAY, INDUSTRY, SECU, ratio


def weekly_panel(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    """A price panel of suppliers by week of shipping; a price is extendedprice / quantity.

    Lines are dealt by supplier as they are, once: weeks, windows over a supplier's weeks and its
    name need no other exchange.  Open and close are the first and last price of the week in a full
    order of the lines, so there is no tie to break; as a week's lines lie together in that order, a line
    is its first or last where its neighbour is of another week.
    """
    dealt = lineitem.select(F.col("l_suppkey").alias(SECU), "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").repartition(SECU)
    lines = dealt.select(
        SECU, F.date_trunc("week", "l_shipdate").cast("date").alias(DAY), ratio(F.col("l_extendedprice"), F.col("l_quantity")).alias("p"), F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("v"),
        "l_shipdate", "l_orderkey", "l_linenumber",
    ).where("p is not null and TradingDay is not null")
    near = Window.partitionBy(SECU).orderBy("l_shipdate", "l_orderkey", "l_linenumber", "p", "q")
    ends = {c: F.when(~F.col(DAY).eqNullSafe(f(DAY).over(near)), F.col("p")) for c, f in (("open", F.lag), ("close", F.lead))}
    bars = lines.withColumns(ends).groupBy(SECU, DAY).agg(
        F.max("open").alias("open"), F.max("close").alias("close"), F.max("p").alias("high"), F.min("p").alias("low"), F.sum("q").alias("TurnoverVolume"), F.sum("v").alias("TurnoverValue")
    )
    close, own = F.col("close"), Window.partitionBy(SECU).orderBy(DAY)
    bars = bars.withColumn("vwap", ratio(F.col("TurnoverValue"), F.col("TurnoverVolume"))).withColumns(
        {"raw_close_close": ratio(close, F.lag("close").over(own)) - 1, **{f"raw_close_{x}": ratio(close, F.col(x)) - 1 for x in ("open", "high", "low", "vwap")}}
    )
    bars = bars.withColumn("excess_return", F.col("raw_close_close") - F.avg("raw_close_close").over(Window.partitionBy(DAY)))
    names = supplier.select(F.col("s_suppkey").alias(SECU), F.col("s_nationkey").cast("string").alias(INDUSTRY), (F.col("s_acctbal") > 0).alias("is_member"))
    return bars.join(names, SECU, "left")


def read_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly_panel(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/supplier.parquet"))


def event_cells(events: DataFrame) -> DataFrame:
    """(SecuCode, TradingDay, ret, event): users by day; ret is the mean value, event marks a purchase."""
    purchase = F.max(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).cast("int")
    return events.groupBy(F.col("user_id").alias(SECU), F.col("ts").cast("date").alias(DAY)).agg(F.avg("value").alias("ret"), purchase.alias("event"))


def members(panel: DataFrame, flag: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of a universe (a null flag is false) within [start, end]."""
    if flag:
        panel = panel.where(F.coalesce(F.col(f"`{flag}`"), F.lit(False)))
    day = F.col(DAY)
    return panel.where((day >= F.lit(start).cast("date") if start else F.lit(True)) & (day <= F.lit(end).cast("date") if end else F.lit(True)))


def read_factor_dir(spark: SparkSession, path: str) -> DataFrame:
    """(file, SecuCode, TradingDay, factor) from all long CSV files of a folder; the last column is the factor."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    keep = [F.col(SECU).cast("string"), F.to_date(F.col(DAY).cast("string")).alias(DAY), F.col(f"`{df.columns[-1]}`").cast("double").alias("factor")]
    return df.select(F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1).alias("file"), *keep)


def read_fitness(spark: SparkSession, path: str) -> DataFrame:
    """Fitness CSV files of a search, with repeated header lines and the warm start's files left out."""
    df = spark.read.option("recursiveFileLookup", True).csv(path, header=True).withColumn("file", F.col("_metadata.file_name"))
    df = df.where(~F.col("file").contains("warm_start_up") & (F.col("factor_name") != "factor_name"))
    numbers = {c: F.col(c).try_cast("double") for c in ("ic", "tvalue", "fitness_score", "selection_probability") if c in df.columns}
    return df.withColumns(numbers | ({"valid_factor_size": F.col("valid_factor_size").try_cast("int")} if "valid_factor_size" in df.columns else {}))


def read_warm_start(spark: SparkSession, path: str, size: int) -> list[str]:
    """The best `size` distinct expressions of a fitness CSV, by fitness_score if it has one; repeated header lines are left out."""
    df = spark.read.csv(path, header=True).where("factor_name is not null and factor_name <> 'factor_name'")
    score = F.col("fitness_score").try_cast("double") if "fitness_score" in df.columns else F.lit(0.0)
    best = df.groupBy("factor_name").agg(F.max(score).alias("score")).orderBy(F.desc_nulls_last("score"), "factor_name").limit(size)
    return [r[0] for r in best.collect()]  # the population's size


def read_library(spark: SparkSession, paths: list[str], panel: DataFrame) -> DataFrame:
    """panel's keys with one column for each Parquet factor table (SecuCode, TradingDay, factor), left-joined."""
    tables = [spark.read.parquet(p) for p in paths]
    return reduce(lambda a, b: a.join(b, [SECU, DAY], "left"), tables, panel.select(SECU, DAY))


def write_report(report: DataFrame, path: str, format: str = "csv") -> None:
    """A report of a few rows, as one file."""
    writer = report.coalesce(1).write.mode("overwrite").format(format)
    (writer.option("header", True) if format == "csv" else writer).save(path)


def write_values(df: DataFrame, path: str, epoch: int | None = None) -> None:
    """Factor values as Parquet, appended as a partition of their epoch."""
    df = df if epoch is None else df.withColumn("epoch", F.lit(epoch))
    writer = df.write.mode("append")
    (writer.partitionBy("epoch") if epoch is not None else writer).parquet(path)


def write_fitness(fitness: DataFrame, path: str, epoch: int) -> None:
    fitness.withColumn("epoch", F.lit(epoch)).coalesce(1).write.mode("append").partitionBy("epoch").csv(path, header=True)


def params_json(**params) -> str:
    """The sidecar of a run's parameters."""
    return json.dumps(params, ensure_ascii=False, sort_keys=True, default=str)


def rounded(x: Column, digits: int = 6) -> Column:
    """For results that are compared: NaN and -0.0 are brought to null and 0.0."""
    return F.when(~F.isnan(x), F.round(x, digits) + F.lit(0.0))


#: The panel of weekly_panel in DuckDB SQL, as common table expressions ending in `panel`.
PANEL_SQL = """
lines AS (SELECT l_suppkey AS SecuCode, CAST(date_trunc('week', l_shipdate) AS DATE) AS TradingDay, l_extendedprice / l_quantity AS p, l_quantity AS q, l_extendedprice AS v,
          l_shipdate, l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <> 0),
bars0 AS (SELECT SecuCode, TradingDay, first(p ORDER BY l_shipdate, l_orderkey, l_linenumber, p, q) AS "open",
          first(p ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, p DESC, q DESC) AS "close",
          max(p) AS high, min(p) AS low, sum(q) AS TurnoverVolume, sum(v) AS TurnoverValue FROM lines GROUP BY ALL),
bars AS (SELECT *, TurnoverValue / TurnoverVolume AS vwap, "close" / lag("close") OVER (PARTITION BY SecuCode ORDER BY TradingDay) - 1 AS raw_close_close,
         "close" / "open" - 1 AS raw_close_open, "close" / high - 1 AS raw_close_high, "close" / low - 1 AS raw_close_low, "close" / (TurnoverValue / TurnoverVolume) - 1 AS raw_close_vwap FROM bars0),
panel AS (SELECT bars.*, raw_close_close - avg(raw_close_close) OVER (PARTITION BY TradingDay) AS excess_return, CAST(s_nationkey AS VARCHAR) AS SWF, s_acctbal > 0 AS is_member
          FROM bars LEFT JOIN supplier ON SecuCode = s_suppkey)"""
