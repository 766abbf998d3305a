"""Information coefficients of factors, by day, period and factor, and the data behind their charts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorweave.functions.stats import DAY, SECU, bucket, clip, corr, exact_quantiles, finite, over_day, pct_rank, ratio, tvalue, win_rate, zscore
from factorweave.operators.correlation import correlation_matrix
from factorweave.sources.shared import Store


def with_return(df: DataFrame, ret_col: str, shift: int | None = 2) -> DataFrame:
    """df with `ret`: the return `shift` rows later in the same security."""
    ret = finite(F.col(f"`{ret_col}`"))
    return df.withColumn("ret", F.lead(ret, shift).over(Window.partitionBy(SECU).orderBy(DAY)) if shift else ret)


def join_return(factor: DataFrame, returns: DataFrame, ret_col: str, shift: int | None = 2) -> DataFrame:
    """Factor rows with the led return of their key; rows of a missing value on either side go."""
    led = with_return(returns.select(SECU, DAY, ret_col), ret_col, shift).where("ret is not null").select(SECU, DAY, "ret")
    return factor.join(led, [SECU, DAY])


def ic_rows(df: DataFrame, factor_col: str) -> DataFrame:
    """Rows with both values: zf and zr, z-scored by day and held within 3, and pct ranks rf and rr."""
    rows = df.select(SECU, DAY, finite(F.col(f"`{factor_col}`")).alias("f"), F.col("ret").alias("r")).where("f is not null and r is not null")
    z = {f"z{c}": clip(zscore(F.col(c), over_day()), -3.0, 3.0) for c in ("f", "r")}
    return rows.withColumns(z | {f"r{c}": pct_rank(F.col(c), [DAY]) for c in ("f", "r")})


def daily_ic(rows: DataFrame) -> DataFrame:
    """One row a day: ic, rank_ic, and the row-level sums that the signed shares need.

    rows are those of ic_rows, of which only f and r are read: pairs of a day are grouped as they
    are, two numbers a row, which takes a fraction of the memory of the windows behind the other columns.
    """
    return rows.select(DAY, F.col("f").cast("double"), F.col("r").cast("double")).groupBy(DAY).applyInArrow(_one_day, f"{DAY} date, ic double, rank_ic double, pos double, neg double, n long")


def by_period(daily: DataFrame, freq: str = "D") -> DataFrame:
    """ic and rank_ic of longer periods (W, M, Q, Y): sum / sqrt(count).  Periods without a day have no row."""
    if freq == "D":
        return daily
    unit = {"W": "week", "M": "month", "Q": "quarter", "Y": "year"}[freq]
    scaled = lambda c: ratio(F.sum(c), F.sqrt(F.count(c))).alias(c)
    return daily.groupBy(F.trunc(DAY, unit).alias(DAY)).agg(scaled("ic"), scaled("rank_ic"), *[F.sum(c).alias(c) for c in ("pos", "neg", "n")])


def report_by_year(daily: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Metrics over all days (period `total`) and over each year, from one aggregation."""
    out = daily.withColumn("y", F.year(DAY)).rollup("y").agg(F.grouping("y").alias("all"), *[c.alias(k) for k, c in metrics.items()])
    return out.select(F.when(F.col("all") == 1, "total").otherwise(F.col("y").cast("string")).alias("period"), *metrics)


def ic_report(daily: DataFrame) -> DataFrame:
    """IC, t, signed shares, RankIC, ICIR, winning rate and extremes; total and by year.  Shares in %."""
    ic = F.col("ic")
    return report_by_year(
        daily,
        {
            "ic": F.avg(ic) * 100, "t_value": tvalue(ic), "ic_pos": ratio(F.sum("pos"), F.sum("n")) * 100, "ic_neg": ratio(F.sum("neg"), F.sum("n")) * 100,
            "rank_ic": F.avg("rank_ic") * 100, "icir": ratio(F.avg(ic), F.stddev_samp(ic)), "winning_rate": win_rate(ic) * 100, "ic_min": F.min(ic) * 100, "ic_max": F.max(ic) * 100,
        },
    )


def ic_analysis(df: DataFrame, factor_col: str, ret_col: str, freq: str = "D", shift: int | None = 2) -> DataFrame:
    """The IC report of a factor column against the led return column of the same table."""
    return ic_report(by_period(daily_ic(ic_rows(with_return(df, ret_col, shift), factor_col)), freq))


def ic_cumulative(daily: DataFrame) -> DataFrame:
    """(TradingDay, ic, cum_ic, month_ic): running sum, and the mean of the day's month."""
    month = Window.partitionBy(F.trunc(DAY, "month"))
    return daily.select(DAY, "ic", F.sum("ic").over(Window.orderBy(DAY).rowsBetween(Window.unboundedPreceding, 0)).alias("cum_ic"), F.avg("ic").over(month).alias("month_ic"))


def ic_decay(rows: DataFrame, lags: range = range(-5, 12)) -> DataFrame:
    """(lag, ic): mean daily IC of the factor against the normalised return `lag` rows later."""
    own = Window.partitionBy(SECU).orderBy(DAY)
    led = rows.select(DAY, *[(F.col("zf") * (F.lead("zr", k) if k >= 0 else F.lag("zr", -k)).over(own)).alias(f"l{k}".replace("-", "m")) for k in lags])
    names = [c for c in led.columns if c != DAY]
    mean = led.groupBy(DAY).agg(*[F.avg(c).alias(c) for c in names]).agg(*[F.avg(c).alias(c) for c in names])
    return mean.select(F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(c).alias("ic")) for k, c in zip(lags, names, strict=True)])).alias("x")).select("x.*")


def factor_histogram(df: DataFrame, factor_col: str, bins: int = 20) -> DataFrame:
    """(bin, n) over equal widths between the extremes; the largest value is in the last bin."""
    x = df.select(finite(F.col(f"`{factor_col}`")).alias("x")).where("x is not null")
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1, F.lit(bins))).otherwise(1)
    return x.join(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def factor_quantiles(df: DataFrame, factor_col: str) -> DataFrame:
    """(TradingDay, q20, q40, q50, q60, q80, mean)."""
    x = df.select(DAY, finite(F.col(f"`{factor_col}`")).alias("x"))
    return x.groupBy(DAY).agg(*[F.percentile("x", F.lit(q / 100)).alias(f"q{q}") for q in (20, 40, 50, 60, 80)], F.avg("x").alias("mean"))


def factor_stock_count(df: DataFrame, factor_col: str) -> DataFrame:
    """(TradingDay, n, n_nonzero) of rows with a value."""
    x = df.select(DAY, finite(F.col(f"`{factor_col}`")).alias("x"))
    return x.groupBy(DAY).agg(F.count("x").alias("n"), F.count(F.when(F.col("x") != 0, 1)).alias("n_nonzero"))


def factor_autocorr(df: DataFrame, factor_col: str, lags: range = range(1, 11)) -> DataFrame:
    """(lag, autocorr): mean over securities of their autocorrelation at a lag of rows."""
    own = Window.partitionBy(SECU)
    x = df.select(SECU, DAY, finite(F.col(f"`{factor_col}`")).alias("x")).where("x is not null")
    x = x.withColumn("d", F.col("x") - F.avg("x").over(own))
    x = x.withColumns({f"l{k}": F.col("d") * F.lead("d", k).over(own.orderBy(DAY)) for k in lags})
    each = x.groupBy(SECU).agg(*[ratio(F.avg(f"l{k}"), F.var_pop("x")).alias(f"l{k}") for k in lags])
    mean = each.agg(*[F.avg(f"l{k}").alias(f"l{k}") for k in lags])
    return mean.select(F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"l{k}").alias("autocorr")) for k in lags])).alias("x")).select("x.*")


def group_box(rows: DataFrame, groups: int = 10) -> DataFrame:
    """(bin, n, mean_ret): quantile bins of zf up to 0 (1 to 10) and above (11 to 20), pooled over days.

    Returns beyond the 1% and 99% quantiles of their bin count as these.  Z-scores are computed once
    and stored: sums over a day in another order differ in the last bit, and where many values are
    alike an edge is one of them, so all of them would change their bin.
    """
    sided = rows.select("zf", F.col("zr").alias("r"), (F.col("zf") > 0).cast("int").alias("side")).where("zf is not null and r is not null")
    sided = Store(rows.sparkSession).saved(sided, "group-box")
    edges = exact_quantiles(sided, "zf", [i / groups for i in range(1, groups)], ["side"])  # two rows
    binned = sided.join(F.broadcast(edges), "side").select((bucket(F.col("zf"), F.col("edges")) + 1 + groups * F.col("side")).alias("bin"), "r")
    ends = exact_quantiles(binned, "r", [0.01, 0.99], ["bin"])  # as many rows as bins
    held = F.greatest(F.least(F.col("r"), F.col("edges")[1]), F.col("edges")[0])
    return binned.join(F.broadcast(ends), "bin").groupBy("bin").agg(F.count("*").alias("n"), F.avg(held).alias("mean_ret"))


def _ranks(x: np.ndarray) -> np.ndarray:
    """Ascending ranks, ties averaged, over the number of values."""
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at] / max(len(x), 1)


def _zscores(x: np.ndarray) -> np.ndarray | None:
    """Z-scores, or None where all values are alike."""
    if not len(x) or x.max() == x.min():
        return None
    off = x - x.mean()
    dev = np.sqrt((off * off).mean())
    return off / dev if dev > 0 else None


def _one_day(key, table):
    """The IC of one day; its rows are pairs of factor and return."""
    f, r = (np.asarray(table[c].to_numpy(zero_copy_only=False), float) for c in ("f", "r"))
    order = np.lexsort((r, f))  # sums in one order, so that runs agree to the last bit
    f, r = f[order], r[order]
    row = {DAY: key[0].as_py(), "n": 0}
    zf, zr, rf, rr = _zscores(f), _zscores(r), _ranks(f), _ranks(r)
    if zf is not None and zr is not None:
        ic = np.clip(zf, -3.0, 3.0) * np.clip(zr, -3.0, 3.0)
        row |= {"ic": ic.mean(), "pos": ic[zf >= 0].sum() if (zf >= 0).any() else None, "neg": ic[zf <= 0].sum() if (zf <= 0).any() else None, "n": len(ic)}
    if len(f) > 1 and rf[0] < rf[-1] and rr.max() > rr.min():
        row["rank_ic"] = ((rf - rf.mean()) * (rr - rr.mean())).mean() / (rf.std(ddof=1) * rr.std(ddof=1))
    return pa.Table.from_pylist([row], schema=pa.schema([(DAY, pa.date32()), ("ic", pa.float64()), ("rank_ic", pa.float64()), ("pos", pa.float64()), ("neg", pa.float64()), ("n", pa.int64())]))


_DAILY_BATCH = "k int, ic double, rank_ic double, n long, pos double, neg double, valid long"


def _daily_batch(key, table):
    """The IC of each factor on one day, over the securities that have it and the return."""
    table = table.sort_by(SECU)
    ret = np.asarray(table["r"].to_numpy(zero_copy_only=False), float)
    column, out = table["f"].combine_chunks(), []
    every = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(ret), -1)
    whole = None
    for k in range(every.shape[1]):
        there = ~np.isnan(every[:, k])
        n = int(there.sum())
        if not n:
            continue
        if n == len(ret):  # the return's part is the same for all factors without a gap
            whole = whole or (_zscores(ret), _ranks(ret))
        zr, rr = whole if n == len(ret) else (_zscores(ret[there]), _ranks(ret[there]))
        f = every[there, k]
        zf, rf = _zscores(f), _ranks(f)
        row = {"k": k, "n": n, "valid": 0}
        if zf is not None and zr is not None:
            ic = zf * np.clip(zr, -3.0, 3.0)
            row |= {"ic": ic.mean(), "pos": ic[zf >= 0].sum() if (zf >= 0).any() else None, "neg": ic[zf <= 0].sum() if (zf <= 0).any() else None, "valid": n}
        if rf.max() > rf.min() and rr.max() > rr.min():
            df, dr = rf - rf.mean(), rr - rr.mean()
            row["rank_ic"] = (df @ dr) / np.sqrt((df @ df) * (dr @ dr))
        out.append(row)
    return pa.Table.from_pylist(out, schema=pa.schema([(n, {"int": pa.int32(), "double": pa.float64(), "long": pa.int64()}[t]) for n, t in (c.split() for c in _DAILY_BATCH.split(", "))]))


def batch_ic(df: DataFrame, factor_cols: list[str], threshold: float = 0.0) -> DataFrame:
    """One row a factor of |ic| % above threshold: ic, t_value, ic_pos, ic_neg, rank_ic, icir,
    winning_rate, ic_min, ic_max, n_days and mean_count.

    Rows are dealt by day once, with all factors side by side; a group is one day's securities,
    and the ranks of its returns are taken once.  Factors are z-scored without a clip.
    A factor without a valid day has ic null and is kept, as an error.
    """
    factors = F.array(*[finite(F.col(f"`{c}`")) for c in factor_cols])
    rows = df.select(SECU, DAY, F.col("ret").cast("double").alias("r"), factors.alias("f")).where("r is not null and not isnan(r)")
    names_of = F.array(*[F.lit(c) for c in factor_cols])
    daily = rows.groupBy(DAY).applyInArrow(_daily_batch, _DAILY_BATCH).withColumn("factor", F.get(names_of, F.col("k")))
    got = daily.groupBy("factor").agg(
        (F.avg("ic") * 100).alias("ic"), tvalue(F.col("ic")).alias("t_value"), (ratio(F.sum("pos"), F.sum("valid")) * 100).alias("ic_pos"), (ratio(F.sum("neg"), F.sum("valid")) * 100).alias("ic_neg"),
        (F.avg("rank_ic") * 100).alias("rank_ic"), ratio(F.avg("ic"), F.stddev_samp("ic")).alias("icir"), (win_rate(F.col("ic")) * 100).alias("winning_rate"),
        (F.min("ic") * 100).alias("ic_min"), (F.max("ic") * 100).alias("ic_max"), F.count("ic").alias("n_days"), F.avg("n").alias("mean_count"),
    )
    names = df.sparkSession.createDataFrame([(c,) for c in factor_cols], "factor string")
    return names.join(got, "factor", "left").where(F.col("ic").isNull() | (F.abs("ic") > threshold))


@dataclass
class BatchReport:
    """rows: batch_ic of the factors that have an IC, largest |ic| first; corr: their correlations, if wanted; failed: the others."""

    rows: DataFrame
    corr: DataFrame | None
    failed: list[str]


def batch_report(df: DataFrame, factor_cols: list[str], threshold: float = 0.0, most_corr: int = 30, force_corr: bool = False) -> BatchReport:
    """batch_ic with the list of factors that have no valid day, and the correlations of the others.

    Correlations are left out for more than `most_corr` factors unless they are forced.
    """
    table = batch_ic(df, factor_cols, threshold).persist()  # a row a factor
    try:
        found = [(r["factor"], r["ic"]) for r in table.select("factor", "ic").collect()]
        rows = df.sparkSession.createDataFrame(table.where("ic is not null").orderBy(F.desc(F.abs("ic")), "factor").collect(), table.schema)
    finally:
        table.unpersist()
    known = sorted(f for f, ic in found if ic is not None)
    wanted = len(known) > 1 and (force_corr or len(known) <= most_corr)
    return BatchReport(rows, factor_corr(df, known) if wanted else None, sorted(f for f, ic in found if ic is None))


def factor_corr(df: DataFrame, factor_cols: list[str]) -> DataFrame:
    """(a, b, corr) of each pair of factors, over the rows that have both."""
    return correlation_matrix(df, factor_cols)
