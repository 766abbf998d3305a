"""Statistics as Columns.  NaN and infinity count as missing; no division raises under ANSI."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SECU, DAY, INDUSTRY = "SecuCode", "TradingDay", "SWF"


def finite(x: Column) -> Column:
    """x, with NaN and both infinities as null."""
    x = x.cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def ratio(a: Column, b: Column, inf: bool = False) -> Column:
    """a / b; null where either is missing or b is 0, with inf signed infinity for a value over 0."""
    out = F.when(b != 0, a.cast("double") / b)
    return out.when((b == 0) & (a != 0), F.signum(a.cast("double")) * float("inf")) if inf else out


def clip(x: Column, low: float, high: float) -> Column:
    """x held within [low, high]; null stays null, infinity becomes a bound, NaN null."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def over_day(*more: str) -> WindowSpec:
    return Window.partitionBy(DAY, *more)


def zscore(x: Column, w: WindowSpec, sample: bool = False) -> Column:
    """(x - mean) / deviation over w; null where the deviation is 0."""
    return ratio(x - F.avg(x).over(w), (F.stddev_samp if sample else F.stddev_pop)(x).over(w))


def pct_rank(x: Column, w_keys: list[str]) -> Column:
    """Ascending rank by value, ties averaged, over the number of values; nulls have no rank.

    All of its windows have one order, so that one sort serves them.
    """
    w = Window.partitionBy(*w_keys).orderBy(x)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.count(x).over(whole)
    below = F.rank().over(w) - (F.count("*").over(whole) - n)
    ties = F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), (below + (ties - 1) / 2) / n)


def tvalue(x: Column) -> Column:
    """mean / (sample deviation / sqrt(n)) as an aggregate; null where the deviation is 0."""
    return ratio(F.avg(x) * F.sqrt(F.count(x)), F.stddev_samp(x))


def corr(a: Column, b: Column) -> Column:
    """Pearson correlation over rows with both, as an aggregate; null if either is constant."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def win_rate(x: Column) -> Column:
    """Share of rows above 0; a null row counts as one that isn't."""
    return F.avg(F.coalesce((x > 0).cast("double"), F.lit(0.0)))


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def proportion_p(wins: int, n: int, expected: float) -> float | None:
    """Two-sided p-value of a share against an expected one, with the sample's own variance."""
    if not n:
        return None
    p = wins / n
    if p in (0.0, 1.0):
        return 0.0
    return 2 * norm_cdf(-abs(p - expected) / math.sqrt(p * (1 - p) / n))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def f_p(f: float | None, d1: int, d2: int) -> float | None:
    """P(F > f) with d1 and d2 degrees of freedom."""
    return None if f is None or d1 < 1 or d2 < 1 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def exact_quantiles(df: DataFrame, col: str, shares: list[float], by: list[str], accuracy: int = 10_000) -> DataFrame:
    """(by..., edges): the quantiles of each group, linearly interpolated, for groups of any size; without `by` one row of all.

    A mergeable sketch first brackets each quantile between two values, of which it is known
    that the ranks looked for lie between them.  Then only the values inside brackets, some
    4 in `accuracy` of a group for each share, are counted one by one, and all others by the
    gap they fall into; running sums over these few rows give the ranks.  Groups of up to
    10 * accuracy values have one bracket of all.  Groups without a value, or with a null key, have
    no row.  A quantile that its bracket missed would be an error.
    """
    if not by:
        return exact_quantiles(df.select(F.lit(0).alias("all_rows"), F.col(col).alias("x")), "x", shares, ["all_rows"], accuracy).drop("all_rows")
    eps = 2 / accuracy
    x = df.select(*by, finite(F.col(col)).alias("x")).where("x is not null")
    asked = [min(1.0, max(0.0, s + d)) for s in shares for d in (-eps, eps)]
    near = x.groupBy(*by).agg(F.count("x").alias("n"), F.percentile_approx("x", F.array(*[F.lit(s) for s in asked]), F.lit(accuracy)).alias("a"), F.min("x").alias("least"), F.max("x").alias("most"))
    small = F.col("n") <= 10 * accuracy
    ends = [[F.when(small, F.col(whole)).otherwise(F.get("a", F.lit(2 * i + k))) for i in range(len(shares))] for k, whole in ((0, "least"), (1, "most"))]
    near = near.select(*by, "n", F.array(*[F.struct(lo.alias("lo"), hi.alias("hi")) for lo, hi in zip(*ends, strict=True)]).alias("brackets"))
    value = F.col("x")
    inside = F.exists("brackets", lambda b: (b["lo"] <= value) & (value <= b["hi"]))
    gap = F.coalesce(F.array_max(F.transform(F.filter("brackets", lambda b: b["hi"] < value), lambda b: b["hi"])), F.lit(float("-inf")))
    counted = x.join(near, by).select(*by, "n", F.when(inside, value).otherwise(gap).alias("x"), (~inside).alias("gap")).groupBy(*by, "x", "gap").agg(F.first("n").alias("n"), F.count("*").alias("rows"))
    until = Window.partitionBy(*by).orderBy("x", "gap").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("stop", F.sum("rows").over(until))

    def at(rank: Column) -> Column:
        value = F.when(F.col("gap"), F.raise_error(F.lit("a quantile lies outside its bracket; take a larger accuracy")).cast("double")).otherwise(F.col("x"))
        return F.max(F.when((F.col("stop") - F.col("rows") <= rank) & (rank < F.col("stop")), value))

    place = {s: (F.col("n") - 1) * s for s in shares}
    low = {s: at(F.floor(p)) for s, p in place.items()}
    high = {s: at(F.least(F.floor(p) + 1, F.col("n") - 1)) for s, p in place.items()}
    part = {s: F.first(p - F.floor(p)) for s, p in place.items()}
    return ranked.groupBy(*by).agg(F.array(*[low[s] + (high[s] - low[s]) * part[s] for s in shares]).alias("edges"))


def bucket(x: Column, edges: Column) -> Column:
    """0-based bucket of x among inner edges; a bucket is (low, high], so ties stay together."""
    return F.when(x.isNotNull(), F.size(F.filter(edges, lambda e: e < x)))
