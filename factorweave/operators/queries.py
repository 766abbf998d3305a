"""One registered query for each operator of the expression language, with its SQL twin."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorweave.functions.stats import DAY, SECU
from factorweave.operators.registry import OPERATORS
from factorweave.plans.compiler import evaluate
from factorweave.sources.panel import PANEL_SQL, read_panel, rounded

_X, _N = "raw_close_close", 12
#: The SQL of time-series operators over column x: {w} is the window, l the list of its values, m its mean.
_W = f"PARTITION BY SecuCode ORDER BY TradingDay ROWS BETWEEN {_N - 1} PRECEDING AND CURRENT ROW"
_WIN = f"OVER ({_W})"
_RMS = f"sqrt(avg(x * x) {_WIN})"
_TS = {
    "ts_mean": f"avg(x) {_WIN}",
    "ts_std": f"stddev_samp(x) {_WIN}",
    "ts_max": f"max(x) {_WIN}",
    "ts_min": f"min(x) {_WIN}",
    "ts_median": f"median(x) {_WIN}",
    "ts_skew": f"CASE WHEN max(x) {_WIN} = min(x) {_WIN} THEN 0.0 ELSE skewness(x) {_WIN} END",
    "ts_kurt": f"CASE WHEN max(x) {_WIN} = min(x) {_WIN} THEN -3.0 ELSE kurtosis(x) {_WIN} END",
    "ts_rms": _RMS,
    "ts_norm_mean": f"avg(x) {_WIN} / nullif({_RMS}, 0)",
    "ts_norm_max": f"max(x) {_WIN} / nullif({_RMS}, 0)",
    "ts_norm_min": f"min(x) {_WIN} / nullif({_RMS}, 0)",
    "ts_norm_min_max": f"(max(x) {_WIN} - min(x) {_WIN}) / nullif({_RMS}, 0)",
    "ts_mean_over_1norm": f"avg(x) {_WIN} / nullif(avg(abs(x)) {_WIN}, 0)",
    "ts_norm": f"CASE WHEN stddev_samp(x) {_WIN} <> 0 THEN greatest(least((x - avg(x) {_WIN}) / nullif(stddev_samp(x) {_WIN}, 0), 3.0), -3.0) END",
}
_SQUARES = "list_sum([(v - m) * (v - m) for v in l])"
_FLAGS = lambda sign: f"'0' || array_to_string([CASE WHEN v {sign} m THEN '1' ELSE '0' END for v in l], '')"
_LIST = {
    "ts_autocorr": f"(list_sum([(l[i] - m) * (l[i + 1] - m) for i in range(1, {_N})]) / {_N - 1}) / nullif({_SQUARES} / {_N}, 0)",
    "ts_median_abs_deviation": "list_aggregate([abs(v - m) for v in l], 'median')",
    "ts_ratio_beyond_3sigma": f"len([v for v in l if (v - m) * (v - m) > 9 * {_SQUARES} / {_N}]) / {_N}",
    "ts_ratio_beyond_2sigma": f"len([v for v in l if (v - m) * (v - m) > 4 * {_SQUARES} / {_N}]) / {_N}",
    "ts_index_mass_median": f"(1 + len([i for i in range(1, {_N + 1}) if list_sum([abs(v) for v in l[1:i]]) / list_sum([abs(v) for v in l]) < 0.5])) / {_N}",
    "ts_number_cross_mean": f"len([i for i in range(1, {_N}) if (l[i] > m) <> (l[i + 1] > m)])::DOUBLE",
    "ts_time_asymmetry_stats": f"list_sum([l[i + 2] * l[i + 2] * l[i + 1] - l[i + 1] * l[i] * l[i] for i in range(1, {_N - 1})]) / {_N - 2}",
    "ts_longest_strike_above_mean": f"list_max([len(r) for r in string_split({_FLAGS('>')}, '0')])::DOUBLE",
    "ts_longest_strike_below_mean": f"list_max([len(r) for r in string_split({_FLAGS('<')}, '0')])::DOUBLE",
}
_DAY_KEYS = "OVER (PARTITION BY TradingDay)"
_PAIR = {
    "comb_add": "raw_close_open + raw_close_vwap",
    "comb_sub": "raw_close_high - raw_close_low",
    "comb_mul": "raw_close_close * raw_close_open",
    "comb_div": '"close" / nullif("open", 0)',
}


def _result(panel_sql: str, value: str, source: str = "panel") -> str:
    return f"WITH {panel_sql} SELECT SecuCode, TradingDay, round({value}, 6) + 0.0 AS value FROM {source}"


def _sql(name: str) -> str:
    if name in _TS:
        return f"WITH {PANEL_SQL}, s AS (SELECT *, {_X} AS x FROM panel) SELECT SecuCode, TradingDay, CASE WHEN count(x) {_WIN} = {_N} THEN round({_TS[name]}, 6) + 0.0 END AS value FROM s"
    if name in _LIST:
        lists = f"s AS (SELECT SecuCode, TradingDay, list({_X}) {_WIN} AS l, avg({_X}) {_WIN} AS m, count({_X}) {_WIN} AS n FROM panel)"
        return f"WITH {PANEL_SQL}, {lists} SELECT SecuCode, TradingDay, CASE WHEN n = {_N} THEN round({_LIST[name]}, 6) + 0.0 END AS value FROM s"
    if name in ("ts_shift", "ts_diff"):
        lag = f"lag({_X}, {_N % 7}) OVER (PARTITION BY SecuCode ORDER BY TradingDay)"
        return _result(PANEL_SQL, lag if name == "ts_shift" else f"{_X} - {lag}")
    if name in _PAIR:
        return _result(PANEL_SQL, _PAIR[name])
    if name == "cs_rank":
        ties = f"count(*) OVER (PARTITION BY TradingDay, {_X})"
        rank = f"rank() OVER (PARTITION BY TradingDay ORDER BY {_X} NULLS LAST)"
        return _result(PANEL_SQL, f"CASE WHEN {_X} IS NOT NULL THEN ({rank} + ({ties} - 1) / 2.0) / count({_X}) {_DAY_KEYS} END")
    if name == "cs_norm":
        return _result(PANEL_SQL, f"CASE WHEN {_X} IS NOT NULL AND stddev_pop({_X}) {_DAY_KEYS} <> 0 THEN greatest(least(({_X} - avg({_X}) {_DAY_KEYS}) / nullif(stddev_pop({_X}) {_DAY_KEYS}, 0), 3.0), -3.0) END")
    if name == "ind_neu":
        keys = "OVER (PARTITION BY TradingDay, SWF)"
        return _result(PANEL_SQL, f"CASE WHEN SWF IS NOT NULL THEN ({_X} - avg({_X}) {keys}) / nullif(stddev_samp({_X}) {keys}, 0) END")
    n = int(name[8:-1])
    w = f"OVER (PARTITION BY SecuCode ORDER BY TradingDay ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    own = f"s AS (SELECT *, raw_close_open AS a, raw_close_close AS b FROM panel), t AS (SELECT *, count(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 END) {w} AS n, max(a) {w} = min(a) {w} OR max(b) {w} = min(b) {w} AS flat, covar_pop(a, b) {w} AS c, stddev_pop(a) {w} * stddev_pop(b) {w} AS d FROM s)"
    return _result(f"{PANEL_SQL}, {own}", f"CASE WHEN n = {n} AND NOT flat THEN -c / nullif(d, 0) END", "t")


def expression_of(name: str) -> str:
    """The expression that an operator's query evaluates."""
    spec = OPERATORS[name]
    if spec.kind == "pair":
        inputs = {"comb_add": "raw_close_open,raw_close_vwap", "comb_sub": "raw_close_high,raw_close_low", "comb_mul": f"{_X},raw_close_open", "comb_div": "close,open"}.get(name, f"raw_close_open,{_X}")
        return f"{name}({inputs})"
    return f"{name}({_X},{_N})" if spec.takes_n else f"{name}({_X})"


def _query(expression: str, spark, sf_dir: str) -> DataFrame:
    return evaluate(read_panel(spark, sf_dir), {"value": expression}).select(SECU, DAY, rounded(F.col("value")).alias("value"))


_BUILT_IN = list(OPERATORS)
QUERIES = {name: partial(_query, expression_of(name)) for name in _BUILT_IN}
ORACLE_SQL = {name: _sql(name) for name in _BUILT_IN}

_C20 = "OVER (PARTITION BY SecuCode ORDER BY TradingDay ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
QUERIES["expr_rank_of_corr"] = partial(_query, "cs_rank(ts_corr_20D(raw_close_open, raw_close_close))")
ORACLE_SQL["expr_rank_of_corr"] = f"""WITH {PANEL_SQL},
s AS (SELECT *, raw_close_open AS a, raw_close_close AS b FROM panel),
t AS (SELECT *, CASE WHEN count(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 END) {_C20} = 20 THEN -covar_pop(a, b) {_C20} / nullif(stddev_pop(a) {_C20} * stddev_pop(b) {_C20}, 0) END AS c FROM s)
SELECT SecuCode, TradingDay, round(CASE WHEN c IS NOT NULL THEN (rank() OVER (PARTITION BY TradingDay ORDER BY c NULLS LAST) + (count(*) OVER (PARTITION BY TradingDay, c) - 1) / 2.0) / count(c) {_DAY_KEYS} END, 6) + 0.0 AS value FROM t"""
QUERIES["expr_norm_of_neutral"] = partial(_query, "ts_norm(ind_neu(comb_sub(raw_close_low, raw_close_high)), 10)")
_C10 = "OVER (PARTITION BY SecuCode ORDER BY TradingDay ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
ORACLE_SQL["expr_norm_of_neutral"] = f"""WITH {PANEL_SQL},
s AS (SELECT *, raw_close_low - raw_close_high AS d FROM panel),
t AS (SELECT *, CASE WHEN SWF IS NOT NULL THEN (d - avg(d) OVER (PARTITION BY TradingDay, SWF)) / nullif(stddev_samp(d) OVER (PARTITION BY TradingDay, SWF), 0) END AS z FROM s)
SELECT SecuCode, TradingDay, CASE WHEN count(z) {_C10} = 10 AND stddev_samp(z) {_C10} <> 0 THEN round(greatest(least((z - avg(z) {_C10}) / nullif(stddev_samp(z) {_C10}, 0), 3.0), -3.0), 6) + 0.0 END AS value FROM t"""
