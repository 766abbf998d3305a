"""The 35 operators of the expression language as Column builders.

A builder gets its input columns and window length and returns (helpers, result): helpers
are columns that have to exist before the result, as window functions can't be nested.
Time-series windows are the last n rows of a security by day and need n values; every
result has missing for NaN and infinity.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from factorweave.functions.kernels import KERNELS
from factorweave.functions.stats import DAY, INDUSTRY, SECU, clip, over_day, ratio

Built = tuple[dict[str, Column], Callable[..., Column]]


@dataclass(frozen=True)
class Operator:
    """kind: ts, cs or pair; keys: what its windows are partitioned by; value: its value type.

    group: a kernel over whole groups of its keys, of whose outputs the operator is one; if the
    key is the security, over its rows in order of day, missing values among them.
    """

    name: str
    kind: str
    build: Callable[..., Built]
    weight: float
    value: str
    takes_n: bool = False
    arity: int = 1
    rewrite: Callable[[int], int] = staticmethod(lambda n: n)
    keys: tuple[str, ...] = ()
    group: Callable[..., object] | None = None
    output: int = 0


OPERATORS: dict[str, Operator] = {}


def register_operator(name: str, kind: str, build: Callable[..., Built], weight: float = 1.0, value: str = "same", **more) -> None:
    """Adds an operator, which expressions can then use; a name can be taken only once."""
    if name in OPERATORS:
        raise ValueError(f"{name} is taken")
    OPERATORS[name] = Operator(name, kind, build, weight, value, takes_n=kind == "ts", arity=2 if kind == "pair" else 1, **more)


def history(n: int) -> WindowSpec:
    """The last n rows of a security."""
    return Window.partitionBy(SECU).orderBy(DAY).rowsBetween(-(n - 1), 0)


def _full(x: Column, n: int, out: Column) -> Column:
    return F.when(F.count(x).over(history(n)) == n, out)


def _window(f: Callable[[Column, WindowSpec, int], Column]) -> Callable[..., Built]:
    """An operator of window aggregates alone."""
    return lambda x, n: ({}, lambda: _full(x, n, f(x, history(n), n)))


def _array(f: Callable[[Column, Column, int], Column]) -> Callable[..., Built]:
    """An operator over the array of a full window and its mean; equal helpers are shared by the compiler."""

    def build(x: Column, n: int) -> Built:
        w = history(n)
        helpers = {"values": _full(x, n, F.collect_list(x).over(w)), "mean": F.avg(x).over(w)}
        return helpers, lambda values, mean: F.when(values.isNotNull(), f(values, mean, n))

    return build


def register_kernel(name: str, kernel: Callable[[np.ndarray], np.ndarray], weight: float = 1.0, value: str = "same", **more) -> None:
    """Adds a time-series operator from a NumPy function, for what Column builders can't express.

    The kernel gets full windows as the rows of a (k, n) array and returns k values.  It runs
    as a pandas UDF over Arrow batches; rows without a full window are null and not passed on.
    """

    @F.pandas_udf("double")
    def apply(values: pd.Series) -> pd.Series:
        out, full = pd.Series(np.nan, values.index), values.notna()
        if full.any():
            out[full] = np.asarray(kernel(np.stack(values[full].to_list())), float)
        return out

    register_operator(name, "ts", lambda x, n: ({"values": _full(x, n, F.collect_list(x).over(history(n)))}, lambda values: apply(values)), weight, value, keys=(SECU,), **more)


def register_group_kernel(names: str | list[str], kernel: Callable[..., np.ndarray | tuple[np.ndarray, ...]], arity: int = 1, by: tuple[str, ...] = (DAY,), weight: float = 0.0, value: str = "float") -> None:
    """Adds operators from a NumPy function over whole groups, such as the securities of a day (and an industry).

    The kernel gets its input columns as arrays of a group's rows that have all of them, in order of security,
    and returns an array of as many values, or a tuple of them, one for each name; what isn't
    finite is missing.  A scalar counts for all rows.  Outputs of the same inputs are computed
    together.  Groups come through Arrow one by one, so a group has to fit into a task.  Rows
    whose industry is null get no value.  A weight above 0 lets searches draw the operators.
    """
    if not 1 <= arity <= 2:
        raise ValueError("a group kernel takes one or two columns")
    if by[:1] != (DAY,):
        raise ValueError(f"groups are those of a {DAY}, or parts of them")
    for i, name in enumerate([names] if isinstance(names, str) else names):
        register_operator(name, "pair" if arity == 2 else "cs", lambda *_: ({}, None), weight, value, keys=by, group=kernel, output=i)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once a row even where f uses it inside another lambda."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _moments(a: Column, m: Column, k: int) -> Column:
    """(second, k-th): sums of the powers of a window's deviations from its mean."""
    start = F.struct(F.lit(0.0).alias("second"), F.lit(0.0).alias("more"))

    def step(s: Column, v: Column) -> Column:
        d = v - m
        return F.struct((s["second"] + d * d).alias("second"), (s["more"] + d * d * d * (d if k == 4 else F.lit(1.0))).alias("more"))

    return F.aggregate(a, start, step)


def _rms(x: Column, w: WindowSpec) -> Column:
    return F.sqrt(F.avg(x * x).over(w))


def _skew(a: Column, m: Column, n: int) -> Column:
    if n < 3:
        return F.lit(None).cast("double")
    skew = _let(_moments(a, m, 3), lambda s: ratio(s["more"] / n, F.pow(s["second"] / n, F.lit(1.5))))
    return F.when(F.array_max(a) == F.array_min(a), 0.0).otherwise(skew * ((n * (n - 1)) ** 0.5 / (n - 2)))


def _kurt(a: Column, m: Column, n: int) -> Column:
    if n < 4:
        return F.lit(None).cast("double")
    kurt = _let(_moments(a, m, 4), lambda s: ratio(s["more"] * n, s["second"] * s["second"]) - 3)
    return F.when(F.array_max(a) == F.array_min(a), -3.0).otherwise(((n + 1) * kurt + 6) * ((n - 1) / ((n - 2) * (n - 3))))


def _ts_norm(x: Column, w: WindowSpec, n: int) -> Column:
    """A current value off a constant window would be infinite and so is held at 3."""
    off, dev = x - F.avg(x).over(w), F.stddev_samp(x).over(w)
    return F.when(dev != 0, clip(off / dev, -3.0, 3.0)).when(off > 0, 3.0).when(off < 0, -3.0)


def _autocorr(a: Column, m: Column, n: int) -> Column:
    near = _total(F.zip_with(F.slice(a, 1, n - 1), F.slice(a, 2, n - 1), lambda p, q: (p - m) * (q - m)))
    return ratio(near / (n - 1), _total(F.transform(a, lambda v: (v - m) * (v - m))) / n)


def _middle(a: Column, n: int) -> Column:
    """The median of n values; sort_array, as array_sort calls a lambda for each comparison."""
    return _let(F.sort_array(a), lambda s: (F.get(s, F.lit((n - 1) // 2)) + F.get(s, F.lit(n // 2))) / 2)


def _mean_deviation_median(a: Column, m: Column, n: int) -> Column:
    return _middle(F.transform(a, lambda v: F.abs(v - m)), n)


def _beyond(k: float) -> Callable[[Column, Column, int], Column]:
    def f(a: Column, m: Column, n: int) -> Column:
        var = _total(F.transform(a, lambda v: (v - m) * (v - m))) / n
        return _let(var * (k * k), lambda most: F.size(F.filter(a, lambda v: (v - m) * (v - m) > most)) / n)

    return f


def _mass_median(a: Column, m: Column, n: int) -> Column:
    """Where the running sum of |x| reaches half, as a share of the window."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("steps"))

    def steps(total: Column) -> Column:
        walk = F.aggregate(a, start, lambda s, v: F.struct((s["sum"] + F.abs(v)).alias("sum"), (s["steps"] + F.when((s["sum"] + F.abs(v)) / total < 0.5, 1).otherwise(0)).alias("steps")), lambda s: s["steps"])
        return F.when(total > 0, (walk + 1) / n)

    return _let(_total(F.transform(a, F.abs)), steps)


def _crossings(a: Column, m: Column, n: int) -> Column:
    flips = F.zip_with(F.slice(a, 1, max(n - 1, 0)), F.slice(a, 2, max(n - 1, 0)), lambda p, q: ((p > m) != (q > m)).cast("double")) if n > 1 else F.array(F.lit(0.0))
    return _total(flips)


def _asymmetry(a: Column, m: Column, n: int) -> Column:
    """Mean of x[i+2]**2 * x[i+1] - x[i+1] * x[i]**2."""
    first, second, third = (F.slice(a, i, n - 2) for i in (1, 2, 3))
    later = F.zip_with(second, third, lambda q, r: q * r * r)
    return _total(F.zip_with(later, F.zip_with(first, second, lambda p, q: q * p * p), lambda u, v: u - v)) / (n - 2)


def _strike(above: bool) -> Callable[[Column, Column, int], Column]:
    def f(a: Column, m: Column, n: int) -> Column:
        start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

        def step(s: Column, v: Column) -> Column:
            run = F.when((v > m) if above else (v < m), s["run"] + 1).otherwise(0)
            return F.struct(run.alias("run"), F.greatest(s["best"], run).alias("best"))

        return F.aggregate(a, start, step, lambda s: s["best"]).cast("double")

    return f


def _at_least(least: int, more: int) -> Callable[[int], int]:
    return lambda n: n + more if n < least else n


def _lag_length(n: int) -> int:
    return n % 7 or 1


_ts = lambda name, build, weight=1.0, value="same", **more: register_operator(name, "ts", build, weight, value, keys=(SECU,), **more)

_ts("ts_mean", _window(lambda x, w, n: F.avg(x).over(w)), 5)
_ts("ts_std", _window(lambda x, w, n: F.stddev_samp(x).over(w)), 5)
_ts("ts_max", _window(lambda x, w, n: F.max(x).over(w)))
_ts("ts_min", _window(lambda x, w, n: F.min(x).over(w)))
_ts("ts_median", _array(lambda a, m, n: _middle(a, n)))
_ts("ts_skew", _array(_skew), value="float")
_ts("ts_kurt", _array(_kurt), value="float")
_ts("ts_autocorr", _array(_autocorr), value="uniform", rewrite=_at_least(10, 10))
_ts("ts_shift", lambda x, n: ({}, lambda: F.lag(x, n).over(Window.partitionBy(SECU).orderBy(DAY))), 10, rewrite=_lag_length)
_ts("ts_diff", lambda x, n: ({}, lambda: x - F.lag(x, n).over(Window.partitionBy(SECU).orderBy(DAY))), 10, rewrite=_lag_length)
_ts("ts_median_abs_deviation", _array(_mean_deviation_median), rewrite=_at_least(5, 5))
_ts("ts_rms", _window(lambda x, w, n: _rms(x, w)), rewrite=_at_least(5, 5))
_ts("ts_norm_mean", _window(lambda x, w, n: ratio(F.avg(x).over(w), _rms(x, w))), value="norm", rewrite=_at_least(5, 5))
_ts("ts_norm_max", _window(lambda x, w, n: ratio(F.max(x).over(w), _rms(x, w))), value="norm", rewrite=_at_least(5, 5))
_ts("ts_norm_min", _window(lambda x, w, n: ratio(F.min(x).over(w), _rms(x, w))), value="norm", rewrite=_at_least(5, 5))
_ts("ts_norm_min_max", _window(lambda x, w, n: ratio(F.max(x).over(w) - F.min(x).over(w), _rms(x, w))), value="norm", rewrite=_at_least(5, 5))
_ts("ts_ratio_beyond_3sigma", _array(_beyond(3.0)), 0.5, "uniform", rewrite=_at_least(10, 10))
_ts("ts_ratio_beyond_2sigma", _array(_beyond(2.0)), 0.5, "uniform", rewrite=_at_least(10, 10))
_ts("ts_index_mass_median", _array(_mass_median), value="uniform", rewrite=_at_least(10, 10))
_ts("ts_number_cross_mean", _array(_crossings), value="float")
_ts("ts_time_asymmetry_stats", _array(_asymmetry), value="float", rewrite=_at_least(10, 10))
_ts("ts_longest_strike_above_mean", _array(_strike(True)), value="float", rewrite=_at_least(10, 10))
_ts("ts_longest_strike_below_mean", _array(_strike(False)), value="float", rewrite=_at_least(10, 10))
_ts("ts_mean_over_1norm", _window(lambda x, w, n: ratio(F.avg(x).over(w), F.avg(F.abs(x)).over(w))), value="norm")
_ts("ts_norm", _window(_ts_norm), 3, "norm")


def _cs_rank(x: Column) -> Built:
    """pct_rank(), whose windows are helpers: each is computed once, however often the result uses it."""
    w = Window.partitionBy(DAY).orderBy(x)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    helpers = {"n": F.count(x).over(whole), "rows": F.count("*").over(whole), "rank": F.rank().over(w), "ties": F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow))}
    return helpers, lambda n, rows, rank, ties: F.when(x.isNotNull(), (rank - (rows - n) + (ties - 1) / 2) / n)


def _standard(deviation: Callable[[Column], Column], result: Callable[[Column], Column], *more: str) -> Callable[..., Built]:
    """An operator on z-scores of a day, whose mean and deviation are helpers."""
    return lambda x: ({"mean": F.avg(x).over(over_day(*more)), "dev": deviation(x).over(over_day(*more))}, lambda mean, dev: result(ratio(x - mean, dev)))


register_operator("cs_rank", "cs", _cs_rank, 2, "uniform", keys=(DAY,))
register_operator("cs_norm", "cs", _standard(F.stddev_pop, lambda z: clip(z, -3.0, 3.0)), 2, "norm", keys=(DAY,))
register_operator("ind_neu", "cs", _standard(F.stddev_samp, lambda z: F.when(F.col(INDUSTRY).isNotNull(), z), INDUSTRY), 0.5, "same", keys=(DAY, INDUSTRY))


def correlation(n: int, within_day: bool = False) -> Callable[..., Built]:
    """Minus the correlation over the last n rows of a security, or of a day in order of security."""

    def build(a: Column, b: Column) -> Built:
        w = Window.partitionBy(DAY).orderBy(SECU).rowsBetween(-(n - 1), 0) if within_day else history(n)
        both = F.count(F.when(a.isNotNull() & b.isNotNull(), 1)).over(w) == n
        flat = (F.max(a).over(w) == F.min(a).over(w)) | (F.max(b).over(w) == F.min(b).over(w))
        return {}, lambda: F.when(both & ~flat, -ratio(F.covar_pop(a, b).over(w), F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w)))

    return build


_pair = lambda name, f, weight, value: register_operator(name, "pair", lambda a, b: ({}, lambda: f(a, b)), weight, value)
_pair("comb_add", lambda a, b: a + b, 10, "sum")
_pair("comb_sub", lambda a, b: a - b, 10, "sum")
_pair("comb_mul", lambda a, b: a * b, 10, "ticker_float")
_pair("comb_div", ratio, 10, "ticker_float")
for _n in (10, 20, 40):
    register_operator(f"ts_corr_{_n}D", "pair", lambda *_: ({}, None), 0.33, "uniform", keys=(SECU,), group=KERNELS[f"ts_corr_{_n}D"])
