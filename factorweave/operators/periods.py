"""Calendar periods of any frequency, empty ones included."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorweave.functions.stats import DAY, ratio

_UNITS = {"D": ("day", 0), "W": ("week", 0), "M": ("month", 1), "Q": ("quarter", 3), "Y": ("year", 12), "A": ("year", 12)}
_FREQ = re.compile(r"(\d*)(B?)([DWMQYA])(S?)E?")


def spine(days: DataFrame, freq: str) -> DataFrame:
    """(TradingDay, period) for every calendar day from the first period's to the last's.

    freq: D, W (Monday to Sunday), M, Q or Y, with a number of them before it, S behind it for
    the first day of a period as its name in place of the last, or B before it for the last
    weekday: a weekend at a period's end then belongs to the next one.  So 2W, BM, QS, 3M.  Several
    periods are counted from that of the first day.  As many rows as calendar days.
    """
    m = _FREQ.fullmatch(freq.upper())
    if not m or (m[2] and (m[4] or m[3] in "DW")):
        raise ValueError(f"no frequency {freq!r}")
    n, (unit, months) = int(m[1] or 1), _UNITS[m[3]]
    if n < 1:
        raise ValueError(f"no frequency {freq!r}")
    ends = days.agg(F.min(DAY).alias("lo"), F.max(DAY).alias("hi")).where("lo is not null")
    begin = lambda c: F.col(c) if unit == "day" else F.trunc(c, unit)
    every = f"interval {n * months} month" if months else f"interval {n * (7 if unit == 'week' else 1)} day"
    more = 7 if m[2] else 0  # a weekend may reach into the period after the last
    starts = ends.select(F.explode(F.sequence(begin("lo"), F.date_add("hi", more), F.expr(every))).alias("start"))
    after = F.add_months("start", n * months) if months else F.date_add("start", n * (7 if unit == "week" else 1))
    last = F.date_sub(after, 1)
    weekend = lambda d: F.greatest(F.weekday(d) - 4, F.lit(0))
    if m[2]:
        before = F.date_sub("start", 1)
        rows = starts.select(F.date_sub(last, weekend(last)).alias("period"), F.explode(F.sequence(F.date_sub("start", weekend(before)), F.date_sub(last, weekend(last)))).alias(DAY))
        hi = ends.select(F.col("hi"))
        reach = rows.join(F.broadcast(hi), F.col(DAY) == F.col("hi")).agg(F.max("period").alias("to"))  # one row
        return rows.join(F.broadcast(reach), F.col("period") <= F.col("to")).select(DAY, "period")
    name = F.col("start") if m[4] else last
    return starts.select(name.alias("period"), F.explode(F.sequence("start", last)).alias(DAY)).select(DAY, "period")


def resample(daily: DataFrame, freq: str, metrics: dict[str, Column], empty: bool = True) -> DataFrame:
    """(TradingDay, metrics...): aggregates of the rows of each period, under its name; empty periods are there, too."""
    joined = spine(daily, freq).join(daily.withColumn("row_is_there", F.lit(1)), DAY, "left")
    out = joined.groupBy("period").agg(F.count("row_is_there").alias("rows_there"), *[c.alias(k) for k, c in metrics.items()])
    return (out if empty else out.where("rows_there > 0")).select(F.col("period").alias(DAY), *metrics)


def resample_ic(daily: DataFrame, freq: str, empty: bool = True) -> DataFrame:
    """ic and rank_ic of periods, sum / sqrt(count), with the sums of the daily table's other columns; null where there is no day."""
    scaled = {c: ratio(F.sum(c), F.sqrt(F.count(c))) for c in ("ic", "rank_ic")}
    return resample(daily, freq, scaled | {c: F.sum(c) for c in ("pos", "neg", "n") if c in daily.columns}, empty)
