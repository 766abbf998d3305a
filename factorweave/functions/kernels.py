"""The time-series and pair operators over arrays of one security's values, in order of day.

For batches of many expressions: a window of n values is a row of a strided view, so all
rows are computed at once.  Missing values are NaN; a window needs n values.  Means are summed in
order, as Spark sums a window, so that comparisons with them come out alike.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_ROWS = 1 << 15  # windows at once


def finite(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), x, np.nan)


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b != 0, a / np.where(b != 0, b, 1.0), np.nan)


def total(w: np.ndarray) -> np.ndarray:
    """Sums of rows, from left to right."""
    return np.cumsum(w, 1)[:, -1] if w.shape[1] else np.zeros(len(w))


def rolled(f: Callable[..., np.ndarray], n: int, *columns: np.ndarray) -> np.ndarray:
    """f over the full windows of the columns; NaN elsewhere."""
    out = np.full(len(columns[0]), np.nan)
    if len(out) < n:
        return out
    views = [np.lib.stride_tricks.sliding_window_view(x, n) for x in columns]
    missing = [np.concatenate([[0], np.cumsum(np.isnan(x))]) for x in columns]
    full = np.flatnonzero(sum(m[n:] - m[:-n] for m in missing) == 0)
    for a in range(0, len(full), _ROWS):
        at = full[a : a + _ROWS]
        out[at + n - 1] = f(*[np.ascontiguousarray(v[at]) for v in views])
    return out


def _deviation(w: np.ndarray) -> np.ndarray:
    """Sample deviations; 0 for rows of one value, NaN for one column."""
    if w.shape[1] < 2:
        return np.full(len(w), np.nan)
    return np.where(w.max(1) == w.min(1), 0.0, w.std(1, ddof=1))


def _mean(w: np.ndarray) -> np.ndarray:
    return total(w) / w.shape[1]


def _off(w: np.ndarray) -> np.ndarray:
    return w - _mean(w)[:, None]


def _rms(w: np.ndarray) -> np.ndarray:
    return np.sqrt(_mean(w * w))


def _skew(w: np.ndarray) -> np.ndarray:
    n, d = w.shape[1], _off(w)
    if n < 3:
        return np.full(len(w), np.nan)
    skew = ratio(total(d * d * d) / n, (total(d * d) / n) ** 1.5) * ((n * (n - 1)) ** 0.5 / (n - 2))
    return np.where(w.max(1) == w.min(1), 0.0, skew)


def _kurt(w: np.ndarray) -> np.ndarray:
    n, d = w.shape[1], _off(w)
    if n < 4:
        return np.full(len(w), np.nan)
    second = total(d * d)
    kurt = ratio(total(d * d * d * d) * n, second * second) - 3
    return np.where(w.max(1) == w.min(1), -3.0, ((n + 1) * kurt + 6) * ((n - 1) / ((n - 2) * (n - 3))))


def _autocorr(w: np.ndarray) -> np.ndarray:
    n, d = w.shape[1], _off(w)
    return ratio(total(d[:, :-1] * d[:, 1:]) / (n - 1), total(d * d) / n)


def _beyond(k: float) -> Callable[[np.ndarray], np.ndarray]:
    def f(w: np.ndarray) -> np.ndarray:
        square = _off(w) ** 2
        return (square > (total(square) / w.shape[1] * (k * k))[:, None]).mean(1)

    return f


def _mass_median(w: np.ndarray) -> np.ndarray:
    run = np.cumsum(np.abs(w), 1)
    whole = run[:, -1]
    return np.where(whole > 0, ((run / np.where(whole > 0, whole, 1.0)[:, None] < 0.5).sum(1) + 1) / w.shape[1], np.nan)


def _crossings(w: np.ndarray) -> np.ndarray:
    above = w > _mean(w)[:, None]
    return (above[:, 1:] != above[:, :-1]).sum(1).astype(float)


def _asymmetry(w: np.ndarray) -> np.ndarray:
    first, second, third = w[:, :-2], w[:, 1:-1], w[:, 2:]
    return total(second * third * third - second * first * first) / (w.shape[1] - 2)


def _strike(above: bool) -> Callable[[np.ndarray], np.ndarray]:
    def f(w: np.ndarray) -> np.ndarray:
        m = _mean(w)[:, None]
        on = w > m if above else w < m
        run = best = np.zeros(len(w))
        for j in range(w.shape[1]):
            run = (run + 1) * on[:, j]
            best = np.maximum(best, run)
        return best

    return f


def _norm(w: np.ndarray) -> np.ndarray:
    off, dev = w[:, -1] - _mean(w), _deviation(w)
    return np.where(dev > 0, np.clip(ratio(off, dev), -3.0, 3.0), np.where(off > 0, 3.0, np.where(off < 0, -3.0, np.nan)))


def _correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minus the correlation; NaN where either is constant."""
    p, q = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    flat = (a.max(1) == a.min(1)) | (b.max(1) == b.min(1))
    return np.where(flat, np.nan, -ratio((p * q).mean(1), np.sqrt((p * p).mean(1)) * np.sqrt((q * q).mean(1))))


def _lag(x: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([np.full(min(n, len(x)), np.nan), x[: max(len(x) - n, 0)]])


_WINDOWS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "ts_mean": _mean,
    "ts_std": _deviation,
    "ts_max": lambda w: w.max(1),
    "ts_min": lambda w: w.min(1),
    "ts_median": lambda w: np.median(w, 1),
    "ts_skew": _skew,
    "ts_kurt": _kurt,
    "ts_autocorr": _autocorr,
    "ts_median_abs_deviation": lambda w: np.median(np.abs(_off(w)), 1),
    "ts_rms": _rms,
    "ts_norm_mean": lambda w: ratio(_mean(w), _rms(w)),
    "ts_norm_max": lambda w: ratio(w.max(1), _rms(w)),
    "ts_norm_min": lambda w: ratio(w.min(1), _rms(w)),
    "ts_norm_min_max": lambda w: ratio(w.max(1) - w.min(1), _rms(w)),
    "ts_ratio_beyond_3sigma": _beyond(3.0),
    "ts_ratio_beyond_2sigma": _beyond(2.0),
    "ts_index_mass_median": _mass_median,
    "ts_number_cross_mean": _crossings,
    "ts_time_asymmetry_stats": _asymmetry,
    "ts_longest_strike_above_mean": _strike(True),
    "ts_longest_strike_below_mean": _strike(False),
    "ts_mean_over_1norm": lambda w: ratio(_mean(w), _mean(np.abs(w))),
    "ts_norm": _norm,
}

#: name: function of the input columns and, for time-series operators, the window length.
KERNELS: dict[str, Callable[..., np.ndarray]] = {
    **{name: (lambda f: lambda x, n: rolled(f, n, x))(f) for name, f in _WINDOWS.items()},
    **{f"ts_corr_{n}D": (lambda n: lambda a, b: rolled(_correlation, n, a, b))(n) for n in (10, 20, 40)},
    "ts_shift": _lag,
    "ts_diff": lambda x, n: x - _lag(x, n),
    "comb_add": lambda a, b: a + b,
    "comb_sub": lambda a, b: a - b,
    "comb_mul": lambda a, b: a * b,
    "comb_div": ratio,
}

#: Operators that read one row so far back, whatever lies between; all others need every row of their window.
JUMPS = {"ts_shift", "ts_diff"}


def regression(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(residuals, slope, intercept) of the least squares line of y on x; NaN where x is constant."""
    if x.max() == x.min():
        return np.full(len(y), np.nan), np.nan, np.nan
    dx, dy = x - x.mean(), y - y.mean()
    slope = (dx @ dy) / (dx @ dx)
    return dy - slope * dx, slope, y.mean() - slope * x.mean()
