"""Long-short portfolios and layered returns of a factor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorweave.functions.stats import DAY, SECU, clip, finite, over_day, pct_rank, ratio, win_rate, zscore
from factorweave.operators.ic import report_by_year

#: Trading days of a year (fixed value).
YEAR = 242


def capped(df: DataFrame, weight: str, cap: float) -> DataFrame:
    """Weights of each day held at cap, the excess going to the others in proportion.

    In falling order, names are capped until one fits when what is left is spread over it and
    all after it; so one sort a day finds what repeated capping would end in.  With fewer
    than 1 / cap names each gets cap.
    """
    w, order = F.col(weight), Window.partitionBy(DAY).orderBy(F.desc(weight), SECU)
    before = F.coalesce(F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    names = F.sum((w > 0).cast("int")).over(over_day())
    df = df.withColumns({"__before": before, "__k": F.row_number().over(order) - 1, "__names": names, "__all": F.sum(weight).over(over_day())})
    scale = ratio(F.lit(1.0) - F.col("__k") * cap, F.col("__all") - F.col("__before"))
    df = df.withColumn("__scale", scale)
    fits = (w * F.col("__scale") <= cap) & (F.col("__all") - F.col("__before") > 1e-12)
    df = df.withColumn("__first", F.min(F.when(fits, F.col("__k"))).over(over_day()))
    df = df.withColumn("__share", F.max(F.when(F.col("__k") == F.col("__first"), F.col("__scale"))).over(over_day()))
    new = F.when(w <= 0, 0.0).when(F.col("__names") * cap < 1, cap).when(F.col("__k") < F.coalesce("__first", "__names"), cap).otherwise(w * F.col("__share"))
    return df.withColumn(weight, new).drop("__before", "__k", "__names", "__all", "__scale", "__first", "__share")


def positions(df: DataFrame, factor_col: str, normalize: bool = True, rank: bool = False, inverse: bool = False, topn: int | None = None, cap: float | None = 0.05) -> DataFrame:
    """Rows with a return, with long_position >= 0 and short_position <= 0; each leg sums to 1 a day.

    Rows without a factor have position 0; they stay, as a position that ends is turnover.
    """
    df = df.select(SECU, DAY, "ret", (finite(F.col(f"`{factor_col}`")) * (-1 if inverse else 1)).alias("f"))  # no more is carried through the sorts
    order = F.col("f")
    if rank:
        df = df.withColumn("x", F.col("f")).withColumn("f", pct_rank(F.col("x"), [DAY]) - 0.5)
        order = F.col("x")  # ranks ascend as the factor does, so the factor's sort is theirs
    elif normalize:
        df = df.withColumn("f", clip(zscore(F.col("f"), over_day()), -3.0, 3.0))
    df = df.where("ret is not null")
    df = df.withColumns({"short": F.when(F.col("f") <= 0, -F.col("f")), "long": F.when(F.col("f") >= 0, F.col("f"))})
    if topn is not None:
        # the largest of `short` come first in order, those of `long` last; rows alike count as the mean of their places
        day = Window.partitionBy(DAY).orderBy(order)
        until, alike = day.rangeBetween(Window.unboundedPreceding, Window.currentRow), day.rangeBetween(Window.currentRow, Window.currentRow)
        df = df.withColumns({"__short": F.count("short").over(until) - (F.count("short").over(alike) - 1) / 2, "__long": F.count("long").over(over_day()) - F.count("long").over(until) + (F.count("long").over(alike) + 1) / 2})
        df = df.withColumns({c: F.when(F.col(f"__{c}") <= topn, F.col(c)) for c in ("short", "long")})
    df = df.withColumns({f"{c}_position": F.coalesce(ratio(F.col(c), F.sum(c).over(over_day())), F.lit(0.0)) for c in ("short", "long")})
    if cap is not None:
        df = capped(capped(df, "short_position", cap), "long_position", cap)
    return df.select(SECU, DAY, "ret", "long_position", (-F.col("short_position")).alias("short_position"))


def daily_returns(held: DataFrame, fee: float = 0.0005) -> DataFrame:
    """One row a day: returns of both legs and together, turnover, and the return after the fee."""
    total = F.col("short_position") + F.col("long_position")
    moved = held.withColumn("moved", F.abs(total - F.lag(total).over(Window.partitionBy(SECU).orderBy(DAY))))
    day = moved.groupBy(DAY).agg(F.sum(F.col("long_position") * F.col("ret")).alias("long_ret"), F.sum(F.col("short_position") * F.col("ret")).alias("short_ret"), F.coalesce(F.sum("moved"), F.lit(0.0)).alias("turnover"))
    day = day.withColumn("long_short_ret", F.col("long_ret") + F.col("short_ret"))
    return day.withColumn("long_short_ret_fee", F.col("long_short_ret") - F.col("turnover") * fee)


def return_report(daily: DataFrame) -> DataFrame:
    """Annualised returns in %, winning rate, turnover, Sharpe and IR; total and by year.

    The IR of the total is scaled by the root of its days, that of a year by that of 242.
    The three total returns are for the total only.  A leg that loses all or more than all it
    has (its compounded product is not above 0) has no annual rate: null.
    """
    ls, n = F.col("long_short_ret"), F.count("*")
    product = lambda c: F.product(1 + F.col(c))
    annual = lambda c: (F.when(product(c) > 0, F.pow(product(c), F.lit(float(YEAR)) / n)) - 1) * 100
    whole = lambda c: (F.product(1 + F.col(c)) - 1) * 100
    scale = F.when(F.grouping("y") == 1, F.sqrt(n)).otherwise(F.sqrt(F.lit(float(YEAR))))
    total_only = lambda c: F.when(F.grouping("y") == 1, whole(c))
    return report_by_year(
        daily,
        {
            **{c: annual(c) for c in ("long_short_ret", "long_ret", "short_ret", "long_short_ret_fee")}, "winning_rate": win_rate(ls) * 100, "turnover": F.avg("turnover") * 50,
            "sharpe": ratio(F.avg(ls), F.stddev_samp(ls)) * YEAR**0.5, "ir": ratio(annual("long_short_ret"), F.stddev_samp(ls) * scale * 100),
            **{f"tot_{c}": total_only(c) for c in ("long_short_ret", "long_ret", "short_ret")},
        },
    )


def cumulative_returns(daily: DataFrame) -> DataFrame:
    """(TradingDay, cum_ret, cum_ret_fee, month_ret): running sums, and the sum of the day's month."""
    until = Window.orderBy(DAY).rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    return daily.select(DAY, F.sum("long_short_ret").over(until).alias("cum_ret"), F.sum("long_short_ret_fee").over(until).alias("cum_ret_fee"), F.sum("long_short_ret").over(Window.partitionBy(F.trunc(DAY, "month"))).alias("month_ret"))


def layer_returns(df: DataFrame, factor_col: str, groups: int = 30) -> DataFrame:
    """(TradingDay, layer, ret): mean return of equal-count layers by factor, less the market's.

    Ties are broken by security; the first layers get the rows that are left over.  Layer 0
    is the market itself.  With fewer securities than layers the last ones have no row.
    """
    x = df.select(SECU, DAY, finite(F.col(f"`{factor_col}`")).alias("f"), "ret").where("f is not null and ret is not null")
    x = x.withColumns({"layer": F.ntile(groups).over(Window.partitionBy(DAY).orderBy("f", SECU)), "market": F.avg("ret").over(over_day())})
    each = x.groupBy(DAY, "layer").agg((F.avg("ret") - F.first("market")).alias("ret"))
    return each.unionByName(x.groupBy(DAY).agg(F.lit(0).alias("layer"), F.avg("ret").alias("ret")))


def layer_cumulative(layers: DataFrame) -> DataFrame:
    """(TradingDay, layer, cum_ret) of all layers but the market, from 0 on the day before the first."""
    own = layers.where("layer > 0")
    run = Window.partitionBy("layer").orderBy(DAY).rowsBetween(Window.unboundedPreceding, 0)
    zero = own.groupBy("layer").agg(F.date_sub(F.min(F.min(DAY)).over(Window.partitionBy()), 1).alias(DAY), F.lit(0.0).alias("cum_ret"))
    return own.select(DAY, "layer", F.sum("ret").over(run).alias("cum_ret")).unionByName(zero.select(DAY, "layer", "cum_ret"))


def notable_factors(df: DataFrame, groups: int, threshold: dict[str, float]) -> DataFrame:
    """(file, universe, first, last, notable) of a folder of factors, in one plan.

    df has file, universe, SecuCode, TradingDay, factor and ret.  first and last are the
    cumulative returns, over the market's, of the lowest and highest of `groups` equal-count
    layers by day; notable: the larger is above the universe's threshold.
    """
    keys = ["file", "universe"]
    x = df.select(*keys, SECU, DAY, finite(F.col("factor")).alias("f"), "ret").where("f is not null and ret is not null")
    day = Window.partitionBy(*keys, DAY)
    x = x.withColumns({"layer": F.ntile(groups).over(day.orderBy("f", SECU)), "over": F.col("ret") - F.avg("ret").over(day)})
    return notable_ends(x.where(F.col("layer").isin(1, groups)).groupBy(*keys, DAY, "layer").agg(F.avg("over").alias("over")), groups, threshold)


def notable_ends(daily: DataFrame, groups: int, threshold: dict[str, float]) -> DataFrame:
    """notable_factors from (file, universe, TradingDay, layer, over): the first and last layer's return of each day, over the market's."""
    keys = ["file", "universe"]
    ends = daily.groupBy(*keys).agg(*[F.sum(F.when(F.col("layer") == k, F.col("over"))).alias(c) for k, c in ((1, "first"), (groups, "last"))])
    least = F.element_at(F.create_map(*[F.lit(v) for kv in threshold.items() for v in kv]), F.col("universe"))
    return ends.withColumn("notable", F.coalesce(F.greatest("first", "last") > least, F.lit(False)))


def notable_layers(cumulative: dict[str, DataFrame], groups: int, threshold: dict[str, float] | float) -> dict[str, bool]:
    """For each universe whether its first or last layer ends above the threshold."""
    out = {}
    for name, df in cumulative.items():
        least = threshold[name] if isinstance(threshold, dict) else threshold
        last = df.where(F.col("layer").isin(1, groups)).groupBy("layer").agg(F.max_by("cum_ret", DAY).alias("end")).agg(F.max("end")).first()[0]
        out[name] = last is not None and last > least
    return out


def wide_layers(layers: DataFrame, value: str = "ret") -> DataFrame:
    """One column a layer, `market` for layer 0."""
    name = F.when(F.col("layer") == 0, "market").otherwise(F.concat(F.lit("layer"), F.col("layer")))
    return layers.withColumn("name", name).groupBy(DAY).pivot("name").agg(F.first(value))
