"""Daily bars from an event stream; an extension, as the batch operators need no stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factorweave.functions.stats import DAY, SECU


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def daily_bars(events: DataFrame, late: str = "1 day", secu: str = "user_id", time: str = "ts", value: str = "value") -> DataFrame:
    """(SecuCode, TradingDay, open, high, low, close, n) once a day can get no more rows.

    Rows later than `late` behind the newest are left out.  Ties of time are broken by value.
    """
    order = F.struct(time, value)
    bars = events.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), F.col(secu).alias(SECU)).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count("*").alias("n")
    )
    return bars.select(SECU, F.col("w.start").cast("date").alias(DAY), "open", "high", "low", "close", "n")


def start(bars: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Hands finished bars to sink(batch, id), in which all batch operators may be used."""
    writer = bars.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
