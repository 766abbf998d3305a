"""Event studies: returns around events, by calendar day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorweave.functions.stats import DAY, SECU, bucket, exact_quantiles, f_p, finite, proportion_p, ratio, tvalue


def day_numbers(df: DataFrame) -> DataFrame:
    """(TradingDay, t): the place of each day among all days that occur; one row a calendar day."""
    return df.select(DAY).distinct().withColumn("t", F.row_number().over(Window.orderBy(DAY)))


def lagged(df: DataFrame, value: str, lags: range, at: DataFrame | None = None) -> DataFrame:
    """(keys of at, lag, value): the value so many calendar days later in the same security.

    at: the rows to look from, by default all of df.  Days are those that occur for any
    security; a security that has no row on the day asked for has a null value.  Rows to
    look from are repeated for each lag and met by an equi-join, so no grid is built.
    """
    days = F.broadcast(day_numbers(df))  # one row a calendar day
    values = df.join(days, DAY).select(SECU, "t", finite(F.col(f"`{value}`")).alias("value"))
    start = (df if at is None else at).join(days, DAY).withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags])))
    return start.withColumn("t", F.col("t") + F.col("lag")).join(values, [SECU, "t"], "left").drop("t")


def lag_name(value: str, k: int) -> str:
    return f"{value}(t{k:+d})"


def create_lag(df: DataFrame, value: str, lags: range) -> DataFrame:
    """(SecuCode, TradingDay, one column a lag, named like `ret(t+3)`)."""
    long = lagged(df.select(SECU, DAY, value), value, lags, df.select(SECU, DAY))
    return long.groupBy(SECU, DAY).agg(*[F.max(F.when(F.col("lag") == k, F.col("value"))).alias(lag_name(value, k)) for k in lags])


def dense_lags(df: DataFrame, value: str, lags: range) -> DataFrame:
    """create_lag() for all days on which a lag reaches a row of the security, also those without a row of its own.

    Each row is sent to the days that look at it, so missing days are made only within
    reach, and no grid of days and securities.  Days on which all lags are null have no row,
    unless the security has one.
    """
    days = F.broadcast(day_numbers(df))  # one row a calendar day
    rows = df.select(SECU, DAY, finite(F.col(f"`{value}`")).alias("value")).join(days, DAY)
    seen = rows.withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags]))).select(SECU, (F.col("t") - F.col("lag")).alias("t"), "lag", "value").where("value is not null")
    own = rows.select(SECU, "t", F.lit(None).cast("int").alias("lag"), F.lit(None).cast("double").alias("value"))
    wide = seen.unionByName(own).groupBy(SECU, "t").agg(*[F.max(F.when(F.col("lag") == k, F.col("value"))).alias(lag_name(value, k)) for k in lags])
    return wide.join(days, "t").select(SECU, DAY, *[F.col(f"`{lag_name(value, k)}`") for k in lags])


def event_returns(df: DataFrame, ret_col: str, event_col: str, window: tuple[int, int] = (-20, 20), keep: list[str] | None = None, intervals: list[tuple[int, int]] | None = None) -> DataFrame:
    """(SecuCode, TradingDay, keep..., lag, value) around each row whose event is 1.

    With intervals [s, e) the value is the mean over the lags times their number, where at
    least two thirds of them have a value, and lag is the text `s,e`.
    """
    rows = df.where(F.col(event_col) == 1).select(SECU, DAY, *(keep or []))
    with_event = df.join(rows.select(SECU).distinct(), SECU, "left_semi")
    # the calendar is that of all securities with an event
    around = lagged(with_event.select(SECU, DAY, ret_col), ret_col, range(window[0], window[1] + 1), rows)
    if not intervals:
        return around.withColumn("lag", F.col("lag").cast("string"))
    parts = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in intervals])
    cut = around.withColumn("i", F.explode(F.filter(parts, lambda p: (F.col("lag") >= p["s"]) & (F.col("lag") < p["e"]))))
    width = F.first(F.col("i.e") - F.col("i.s"))
    total = F.when(F.count("value") >= width * 2 / 3, F.avg("value") * width)
    return cut.groupBy(SECU, DAY, *(keep or []), F.concat_ws(",", "i.s", "i.e").alias("lag")).agg(total.alias("value"))


def grouped(rows: DataFrame, group_col: str, n_group: int = 4, numeric: bool | None = None) -> DataFrame:
    """rows with `grp`: quantile buckets G1.. of a number with more than 4 * n_group values, else the value."""
    own = rows.select(SECU, DAY, group_col).distinct()
    numeric = dict(rows.dtypes)[group_col] in ("int", "bigint", "double", "float", "smallint", "tinyint") if numeric is None else numeric
    if numeric and own.agg(F.count_distinct(group_col)).first()[0] > 4 * n_group:
        edges = F.broadcast(exact_quantiles(own, group_col, [i / n_group for i in range(1, n_group)], []))  # one row
        return rows.join(edges).withColumn("grp", F.concat(F.lit("G"), bucket(F.col(group_col), F.col("edges")) + 1)).drop("edges")
    return rows.withColumn("grp", F.col(group_col).cast("string"))


_SHARES = [0.05, 0.25, 0.5, 0.75, 0.95]


def _winsorised(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with `q`, the quantiles of `by` at _SHARES, and `held`: values beyond the first and last count as these.

    Rows of a null group go.
    """
    ends = exact_quantiles(rows, "value", _SHARES, by).withColumnRenamed("edges", "q")  # a row for each lag and group
    value, low, high = F.col("value"), F.col("q")[0], F.col("q")[len(_SHARES) - 1]
    known = rows.where(" and ".join(f"`{c}` is not null" for c in by))
    return known.join(ends, by, "left").withColumn("held", F.when(value.isNotNull(), F.greatest(F.least(value, high), low)))


def event_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For each lag (and group): mean, winsorised mean, deviation, t values, win rate, quantiles, count; in %."""
    by = ["lag", *(by or [])]
    x, held = F.col("value"), F.col("held")
    q = lambda i: (F.first("q")[i] * 100).alias(f"q{int(_SHARES[i] * 100)}")
    return _winsorised(rows, by).groupBy(*by).agg(
        (F.avg(x) * 100).alias("mean"), (F.avg(held) * 100).alias("clip_mean"), (F.stddev_samp(x) * 100).alias("std"), tvalue(x).alias("t_value"), tvalue(held).alias("t_clip"),
        (ratio(F.count(F.when(x > 0, 1)), F.count(x)) * 100).alias("win_rate"), (F.min(x) * 100).alias("min"), q(1), q(2), q(3), (F.max(x) * 100).alias("max"),
        F.count(x).alias("n"), F.count(F.when(x > 0, 1)).alias("wins"),
    )


def with_win_p(summary: DataFrame, expected: float = 0.445) -> DataFrame:
    """The summary with p_win: the two-sided test of the win rate against an expected one."""

    def rows(batches):
        for pdf in batches:
            pdf["p_win"] = [proportion_p(int(w), int(n), expected) for w, n in zip(pdf["wins"], pdf["n"], strict=True)]
            yield pdf

    return summary.mapInPandas(rows, T.StructType([*summary.schema.fields, T.StructField("p_win", T.DoubleType())]))


_TESTED = ("mean", "clip", "win")


def group_f(rows: DataFrame) -> DataFrame:
    """(lag, d1, d2, f_mean, f_clip, f_win): one-way layouts of value, winsorised value and win rate by group.

    d1 and d2 are the degrees of freedom of all three.  F is null without two groups, without
    a row beyond the groups' means, or where nothing varies within the groups.
    """
    win = F.when(F.col("value").isNotNull(), (F.col("value") > 0).cast("double"))
    held = _winsorised(rows, ["lag"]).withColumn("win", win).where("grp is not null and value is not null")
    of = dict(zip(_TESTED, ("value", "held", "win"), strict=True))
    sums = held.groupBy("lag", "grp").agg(F.count("value").alias("n"), *[f(F.col(c)).alias(f"{k}_{name}") for name, c in of.items() for k, f in (("s", F.sum), ("q", lambda x: F.sum(x * x)))])
    d1, d2 = F.count("*") - 1, F.sum("n") - F.count("*")

    def statistic(name: str) -> Column:
        s, parts = F.col(f"s_{name}"), F.sum(F.col(f"s_{name}") * F.col(f"s_{name}") / F.col("n"))
        between, within = parts - F.sum(s) * F.sum(s) / F.sum("n"), F.sum(f"q_{name}") - parts
        return F.when((d1 >= 1) & (d2 >= 1) & (within > 0), ratio(ratio(between, d1), ratio(within, d2)))

    return sums.groupBy("lag").agg(d1.alias("d1"), d2.alias("d2"), *[statistic(c).alias(f"f_{c}") for c in _TESTED])


def group_tests(rows: DataFrame) -> DataFrame:
    """(lag, p_mean, p_clip, p_win): do groups differ in value, winsorised value and win rate?"""

    def p_values(batches):
        for pdf in batches:  # of a row for each lag
            for c in _TESTED:
                pdf[f"p_{c}"] = [f_p(None if f != f else f, int(a), int(b)) for f, a, b in zip(pdf[f"f_{c}"].astype(float), pdf["d1"], pdf["d2"], strict=True)]
            yield pdf[["lag", *[f"p_{c}" for c in _TESTED]]]

    return group_f(rows).mapInPandas(p_values, "lag string, p_mean double, p_clip double, p_win double")


def event_path(summary: DataFrame) -> DataFrame:
    """(step, path, low, high): the running mean around the event, 0 at it, with the quartile band.

    Lags from 0 become the steps from 1; steps before the event run backwards from it.
    """
    s = summary.select(F.col("lag").cast("int").alias("k"), *[(F.col(c) / 100).alias(c) for c in ("mean", "q25", "q75")])
    s = s.withColumn("step", F.when(F.col("k") >= 0, F.col("k") + 1).otherwise(F.col("k")))
    after = Window.partitionBy(F.col("k") >= 0).orderBy(F.abs("step")).rowsBetween(Window.unboundedPreceding, 0)
    path = F.sum(F.when(F.col("k") >= 0, F.col("mean")).otherwise(-F.col("mean"))).over(after)
    s = s.withColumn("path", path).select("step", "path", (F.col("path") - F.col("mean") + F.col("q25")).alias("low"), (F.col("path") - F.col("mean") + F.col("q75")).alias("high"))
    zero = s.sparkSession.createDataFrame([(0, 0.0, 0.0, 0.0)], s.schema)
    return s.unionByName(zero)


def forward_sums(df: DataFrame, ret_col: str, lengths: list[int], mode: str = "forward") -> DataFrame:
    """df with cum1, cum5, ...: the sum of so many returns from the row on; null unless all are there.

    mode="trailing" sums as many rows that end `length - 1` rows before.
    """
    own = Window.partitionBy(SECU).orderBy(DAY)
    x = finite(F.col(ret_col))

    def total(n: int) -> Column:
        w = own.rowsBetween(0, n - 1) if mode == "forward" else own.rowsBetween(-(2 * n - 2), -(n - 1))
        return F.when(F.count(x).over(w) == n, F.sum(x).over(w))

    return df.withColumns({f"cum{n}": total(n) for n in lengths})


def signal_study(df: DataFrame, signal_col: str, ret_col: str, lengths: list[int], mode: str = "forward") -> DataFrame:
    """(period, length, long_short, long, short, t_value): mean returns in % after a signal, total and by year.

    long leaves out signals below 0, short those above; t_value is for the total only.
    """
    x = forward_sums(df, ret_col, lengths, mode).where(F.col(signal_col).isNotNull())
    long = x.select(DAY, F.col(signal_col).alias("s"), F.explode(F.array(*[F.struct(F.lit(n).alias("length"), F.col(f"cum{n}").alias("v")) for n in lengths])).alias("x")).select(DAY, "s", "x.*")
    got = long.withColumn("y", F.year(DAY)).groupingSets([[F.col("length")], [F.col("length"), F.col("y")]], F.col("length"), F.col("y")).agg(
        F.grouping("y").alias("all"), (F.avg("v") * 100).alias("long_short"), (F.avg(F.when(~(F.col("s") < 0), F.col("v"))) * 100).alias("long"), (F.avg(F.when(~(F.col("s") > 0), F.col("v"))) * 100).alias("short"), tvalue(F.col("v")).alias("t")
    )
    return got.select(F.when(F.col("all") == 1, "total").otherwise(F.col("y").cast("string")).alias("period"), "length", "long_short", "long", "short", F.when(F.col("all") == 1, F.col("t")).alias("t_value"))
