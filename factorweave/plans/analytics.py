"""Registered analytics queries over the weekly panel and the event cells, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorweave.functions.kernels import regression
from factorweave.functions.narrow import plan_narrowing
from factorweave.functions.stats import DAY, INDUSTRY, SECU
from factorweave.operators import events as ev
from factorweave.operators import ic, periods, portfolio, search
from factorweave.operators.registry import register_group_kernel
from factorweave.plans.ast import COLUMNS, parse
from factorweave.plans.compiler import evaluate
from factorweave.sources.panel import PANEL_SQL, event_cells, members, read_panel, rounded
from factorweave.sources.shared import Store
from factorweave.sources.wide import folder_layers, read_wide, write_wide

FACTOR = "ts_mean(raw_close_close,20)"
_RET = "excess_return"
_BATCH = {
    "f_mean": FACTOR, "f_std": "ts_std(raw_close_close,10)", "f_shift": "ts_shift(raw_close_vwap,3)", "f_vwap": "raw_close_vwap",
}


def _out(df: DataFrame) -> DataFrame:
    """Doubles rounded for comparison, counts as long."""
    cast = {"double": rounded, "int": lambda c: c.cast("long")}
    return df.select(*[cast.get(t, lambda c: c)(F.col(c)).alias(c) for c, t in df.dtypes])


def _based(spark, sf_dir: str, flag: str | None = None) -> DataFrame:
    """(keys, f, ret): the factor and the return two rows later."""
    panel = members(read_panel(spark, sf_dir), flag)
    return ic.with_return(evaluate(panel, {"f": FACTOR}, keep=[_RET]), _RET)


def _rows(spark, sf_dir):
    return ic.ic_rows(_based(spark, sf_dir), "f")


def ic_daily(spark, sf_dir):
    return _out(ic.daily_ic(_rows(spark, sf_dir)).select(DAY, "ic", "rank_ic", "n"))


def ic_report(spark, sf_dir):
    return _out(ic.ic_report(ic.daily_ic(_rows(spark, sf_dir))))


def ic_report_monthly(spark, sf_dir):
    return _out(ic.ic_report(ic.by_period(ic.daily_ic(_rows(spark, sf_dir)), "M")))


def ic_report_members(spark, sf_dir):
    return _out(ic.ic_report(ic.daily_ic(ic.ic_rows(_based(spark, sf_dir, "is_member"), "f"))))


def ic_yearly_ts_mean(spark, sf_dir):
    report = ic.ic_report(ic.daily_ic(_rows(spark, sf_dir)))
    return _out(report.where("period <> 'total'").select(F.col("period").cast("long").alias("year"), "ic", "t_value"))


def ic_cumulative(spark, sf_dir):
    return _out(ic.ic_cumulative(ic.daily_ic(_rows(spark, sf_dir))))


def ic_decay(spark, sf_dir):
    return _out(ic.ic_decay(_rows(spark, sf_dir)))


def group_box(spark, sf_dir):
    return _out(ic.group_box(_rows(spark, sf_dir)))


def factor_histogram(spark, sf_dir):
    return _out(ic.factor_histogram(_based(spark, sf_dir), "f"))


def factor_quantiles(spark, sf_dir):
    return _out(ic.factor_quantiles(_based(spark, sf_dir), "f"))


def factor_stock_count(spark, sf_dir):
    return _out(ic.factor_stock_count(_based(spark, sf_dir), "f"))


def factor_autocorr(spark, sf_dir):
    return _out(ic.factor_autocorr(_based(spark, sf_dir), "f"))


def _many(spark, sf_dir):
    return ic.with_return(evaluate(read_panel(spark, sf_dir), _BATCH, keep=[_RET]), _RET)


def batch_ic(spark, sf_dir):
    return _out(ic.batch_ic(_many(spark, sf_dir), list(_BATCH)))


def factor_corr(spark, sf_dir):
    return _out(ic.factor_corr(_many(spark, sf_dir), list(_BATCH)))


def _daily(spark, sf_dir, **how):
    return portfolio.daily_returns(portfolio.positions(_based(spark, sf_dir), "f", **how))


def long_short_daily(spark, sf_dir):
    return _out(_daily(spark, sf_dir, cap=None))


def long_short_capped(spark, sf_dir):
    return _out(_daily(spark, sf_dir, cap=0.05))


def long_short_top_rank(spark, sf_dir):
    return _out(_daily(spark, sf_dir, cap=None, rank=True, topn=10, inverse=True))


def return_report(spark, sf_dir):
    """Returns are taken as percents: the panel's weekly changes, as they are, compound to 1e117 and beyond."""
    held = portfolio.positions(_based(spark, sf_dir), "f", cap=None)
    return _out(portfolio.return_report(portfolio.daily_returns(held.withColumn("ret", F.col("ret") / 100))))


_COMPOUNDED = ["long_short_ret", "long_ret", "short_ret", "long_short_ret_fee", "ir", "tot_long_short_ret", "tot_long_ret", "tot_short_ret"]


def return_report_whole(spark, sf_dir):
    """The report on the changes as they are; compounded figures as sign(x) * log10(1 + |x|), so that digits can be compared."""
    report = _out(portfolio.return_report(_daily(spark, sf_dir, cap=None)))
    return _out(report.withColumns({c: F.signum(c) * F.log10(1 + F.abs(c)) for c in _COMPOUNDED}))


def return_cumulative(spark, sf_dir):
    return _out(portfolio.cumulative_returns(_daily(spark, sf_dir, cap=None)))


def layer_returns(spark, sf_dir):
    return _out(portfolio.layer_returns(_based(spark, sf_dir), "f", 10))


def layer_cumulative(spark, sf_dir):
    return _out(portfolio.layer_cumulative(portfolio.layer_returns(_based(spark, sf_dir), "f", 10)))


def _cells(spark, sf_dir):
    return event_cells(spark.read.parquet(f"{sf_dir}/events.parquet"))


_LAGS = (-3, 3)


def _around(spark, sf_dir, **more):
    return ev.event_returns(_cells(spark, sf_dir), "ret", "event", _LAGS, **more)


def event_lags(spark, sf_dir):
    got = ev.create_lag(_cells(spark, sf_dir), "ret", range(-1, 2))
    return _out(got.select(SECU, DAY, *[F.col(f"`{ev.lag_name('ret', k)}`").alias(n) for k, n in ((-1, "before"), (0, "same"), (1, "after"))]))


def event_study(spark, sf_dir):
    return _out(ev.event_summary(_around(spark, sf_dir)))


def event_study_intervals(spark, sf_dir):
    return _out(ev.event_summary(_around(spark, sf_dir, intervals=[(-3, 0), (0, 3)])))


def event_study_grouped(spark, sf_dir):
    cells = _cells(spark, sf_dir).withColumn("size", F.col("ret"))
    around = ev.event_returns(cells, "ret", "event", _LAGS, keep=["size"])
    return _out(ev.event_summary(ev.grouped(around, "size", 4), ["grp"]).select("lag", "grp", "mean", "clip_mean", "std", "t_value", "win_rate", "q50", "n"))


def event_study_tests(spark, sf_dir):
    cells = _cells(spark, sf_dir).withColumn("size", F.col("ret"))
    return ev.group_tests(ev.grouped(ev.event_returns(cells, "ret", "event", _LAGS, keep=["size"]), "size", 4))


def event_study_f(spark, sf_dir):
    cells = _cells(spark, sf_dir).withColumn("size", F.col("ret"))
    return _out(ev.group_f(ev.grouped(ev.event_returns(cells, "ret", "event", _LAGS, keep=["size"]), "size", 4)))


def event_study_win_p(spark, sf_dir):
    return ev.with_win_p(ev.event_summary(_around(spark, sf_dir)))


def event_path(spark, sf_dir):
    return _out(ev.event_path(ev.event_summary(_around(spark, sf_dir))))


def signal_study(spark, sf_dir):
    panel = evaluate(read_panel(spark, sf_dir), {"s": "cs_norm(raw_close_close)"}, keep=["raw_close_open"])
    return _out(ev.signal_study(panel, "s", "raw_close_open", [1, 2, 5]))


_NAMES = (
    "ic_daily ic_report ic_report_monthly ic_report_members ic_yearly_ts_mean ic_cumulative ic_decay group_box factor_histogram factor_quantiles factor_stock_count factor_autocorr batch_ic factor_corr "
    "long_short_daily long_short_capped long_short_top_rank return_report return_report_whole return_cumulative layer_returns layer_cumulative event_lags event_study event_study_intervals event_study_grouped event_study_tests event_study_f "
    "event_study_win_p event_path signal_study"
).split()
QUERIES = {n: globals()[n] for n in _NAMES}

_SECU_W = "OVER (PARTITION BY SecuCode ORDER BY TradingDay)"
_DAY_W = "OVER (PARTITION BY TradingDay)"


def _factor_sql(source: str = "panel") -> str:
    w = "OVER (PARTITION BY SecuCode ORDER BY TradingDay ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    return f"""{PANEL_SQL},
based AS (SELECT SecuCode, TradingDay, CASE WHEN count(raw_close_close) {w} = 20 THEN avg(raw_close_close) {w} END AS f, lead(excess_return, 2) {_SECU_W} AS ret FROM {source})"""


_CLIP = lambda z: f"CASE WHEN ({z}) IS NOT NULL THEN greatest(least({z}, 3.0), -3.0) END"
_RANK = lambda c, keys: f"(rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0) / count(*) OVER (PARTITION BY {keys})"
_Z = lambda c, keys: f"({c} - avg({c}) OVER (PARTITION BY {keys})) / nullif(stddev_pop({c}) OVER (PARTITION BY {keys}), 0)"
_ROWS = f""",
paired AS (SELECT SecuCode, TradingDay, f, ret AS r FROM based WHERE f IS NOT NULL AND ret IS NOT NULL),
icrows AS (SELECT *, {_CLIP(_Z('f', 'TradingDay'))} AS zf, {_CLIP(_Z('r', 'TradingDay'))} AS zr, {_RANK('f', 'TradingDay')} AS rf, {_RANK('r', 'TradingDay')} AS rr FROM paired)"""
_DAILY = f"""{_ROWS},
daily AS (SELECT TradingDay, avg(zf * zr) AS ic, covar_pop(rf, rr) / nullif(stddev_samp(rf) * stddev_samp(rr), 0) AS rank_ic,
          sum(CASE WHEN zf >= 0 THEN zf * zr END) AS pos, sum(CASE WHEN zf <= 0 THEN zf * zr END) AS neg, count(zf * zr) AS n FROM icrows GROUP BY TradingDay)"""
_T = lambda x: f"avg({x}) * sqrt(count({x})) / nullif(stddev_samp({x}), 0)"
_R = lambda e, name: f"round({e}, 6) + 0.0 AS {name}"
_REPORT = f"""SELECT CASE WHEN grouping(y) = 1 THEN 'total' ELSE y::VARCHAR END AS period, {_R('avg(ic) * 100', 'ic')}, {_R(_T('ic'), 't_value')},
{_R('sum(pos) / sum(n) * 100', 'ic_pos')}, {_R('sum(neg) / sum(n) * 100', 'ic_neg')}, {_R('avg(rank_ic) * 100', 'rank_ic')}, {_R('avg(ic) / nullif(stddev_samp(ic), 0)', 'icir')},
{_R('avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) * 100', 'winning_rate')}, {_R('min(ic) * 100', 'ic_min')}, {_R('max(ic) * 100', 'ic_max')}
FROM (SELECT *, year(TradingDay) AS y FROM {{0}}) GROUP BY ROLLUP (y)"""
_MONTH = ", monthly AS (SELECT date_trunc('month', TradingDay) AS TradingDay, sum(ic) / sqrt(count(ic)) AS ic, sum(rank_ic) / sqrt(count(rank_ic)) AS rank_ic, sum(pos) AS pos, sum(neg) AS neg, sum(n) AS n FROM daily GROUP BY ALL)"
_UNTIL = "OVER (ORDER BY TradingDay ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_IN_MONTH = "OVER (PARTITION BY date_trunc('month', TradingDay))"


def _decay_sql() -> str:
    parts = [f"SELECT {k}::BIGINT AS lag, {_R('avg(d)', 'ic')} FROM (SELECT avg(v) AS d FROM (SELECT TradingDay, zf * {'lead' if k >= 0 else 'lag'}(zr, {abs(k)}) {_SECU_W} AS v FROM icrows) GROUP BY TradingDay)" for k in range(-5, 12)]
    return f"WITH {_factor_sql()}{_ROWS} " + " UNION ALL ".join(parts)


def _autocorr_sql() -> str:
    parts = [
        f"SELECT {k}::BIGINT AS lag, {_R('avg(a)', 'autocorr')} FROM (SELECT avg(d * e) / nullif(var_pop(f), 0) AS a FROM (SELECT SecuCode, f, d, lead(d, {k}) {_SECU_W} AS e FROM dev) GROUP BY SecuCode)"
        for k in range(1, 11)
    ]
    return f"WITH {_factor_sql()}, dev AS (SELECT *, f - avg(f) OVER (PARTITION BY SecuCode) AS d FROM based WHERE f IS NOT NULL) " + " UNION ALL ".join(parts)


def _positions_sql(f: str, leg: str = "{0}") -> str:
    """f: the factor a position follows; leg: a condition put around each leg."""
    return f""",
zed AS (SELECT *, {f} AS g FROM based),
held AS (SELECT SecuCode, TradingDay, ret, CASE WHEN g <= 0 THEN -g END AS s0, CASE WHEN g >= 0 THEN g END AS l0 FROM zed WHERE ret IS NOT NULL),
legs AS (SELECT SecuCode, TradingDay, ret, {leg.format('s0')} AS s, {leg.format('l0')} AS l FROM held),
pos AS (SELECT SecuCode, TradingDay, ret, coalesce(l / nullif(sum(l) {_DAY_W}, 0), 0) AS lp, -coalesce(s / nullif(sum(s) {_DAY_W}, 0), 0) AS sp FROM legs)"""


_RETURNS = f""",
moved AS (SELECT *, abs(lp + sp - lag(lp + sp) {_SECU_W}) AS m FROM pos),
dr0 AS (SELECT TradingDay, sum(lp * ret) AS long_ret, sum(sp * ret) AS short_ret, coalesce(sum(m), 0) AS turnover FROM moved GROUP BY TradingDay),
dr AS (SELECT *, long_ret + short_ret AS long_short_ret, long_ret + short_ret - turnover * 0.0005 AS long_short_ret_fee FROM dr0)"""
_DR = f"SELECT TradingDay, {', '.join(_R(c, c) for c in ('long_ret', 'short_ret', 'turnover', 'long_short_ret', 'long_short_ret_fee'))} FROM dr"
_ZF = f"CASE WHEN f IS NOT NULL THEN {_CLIP(_Z('f', 'TradingDay'))} END"
_RF = "CASE WHEN f IS NOT NULL THEN (rank() OVER (PARTITION BY TradingDay ORDER BY -f NULLS LAST) + (count(*) OVER (PARTITION BY TradingDay, f) - 1) / 2.0) / count(f) OVER (PARTITION BY TradingDay) - 0.5 END"
_TOP = "CASE WHEN rank() OVER (PARTITION BY TradingDay ORDER BY {0} DESC NULLS LAST) + (count(*) OVER (PARTITION BY TradingDay, {0}) - 1) / 2.0 <= 10 THEN {0} END"
_ANNUAL = lambda c: f"(CASE WHEN product(1 + {c}) > 0 THEN pow(product(1 + {c}), 242.0 / count(*)) END - 1) * 100"
_RETREP = f"""SELECT CASE WHEN grouping(y) = 1 THEN 'total' ELSE y::VARCHAR END AS period, {', '.join(_R(_ANNUAL(c), c) for c in ('long_short_ret', 'long_ret', 'short_ret', 'long_short_ret_fee'))},
{_R('avg(CASE WHEN long_short_ret > 0 THEN 1.0 ELSE 0.0 END) * 100', 'winning_rate')}, {_R('avg(turnover) * 50', 'turnover')}, {_R('avg(long_short_ret) / nullif(stddev_samp(long_short_ret), 0) * sqrt(242)', 'sharpe')},
{_R(_ANNUAL('long_short_ret') + " / nullif(stddev_samp(long_short_ret) * CASE WHEN grouping(y) = 1 THEN sqrt(count(*)) ELSE sqrt(242) END * 100, 0)", 'ir')},
{', '.join(_R(f'CASE WHEN grouping(y) = 1 THEN (product(1 + {c}) - 1) * 100 END', f'tot_{c}') for c in ('long_short_ret', 'long_ret', 'short_ret'))}
FROM (SELECT *, year(TradingDay) AS y FROM dr) GROUP BY ROLLUP (y)"""
_LAYERS = f""",
lay AS (SELECT TradingDay, ret, ntile(10) OVER (PARTITION BY TradingDay ORDER BY f, SecuCode) AS layer, avg(ret) {_DAY_W} AS market FROM based WHERE f IS NOT NULL AND ret IS NOT NULL),
lr AS (SELECT TradingDay, layer::BIGINT AS layer, avg(ret) - first(market) AS ret FROM lay GROUP BY TradingDay, layer)"""


def _capped_sql(leg: str) -> str:
    """Common table expressions that hold a leg of pos0 at 0.05."""
    return f"""
{leg}1 AS (SELECT *, coalesce(sum({leg}) OVER (PARTITION BY TradingDay ORDER BY {leg} DESC, SecuCode ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
   row_number() OVER (PARTITION BY TradingDay ORDER BY {leg} DESC, SecuCode) - 1 AS k, sum(CASE WHEN {leg} > 0 THEN 1 ELSE 0 END) {_DAY_W} AS names, sum({leg}) {_DAY_W} AS a FROM pos0),
{leg}2 AS (SELECT *, (1.0 - k * 0.05) / nullif(a - b, 0) AS sc FROM {leg}1),
{leg}3 AS (SELECT *, min(CASE WHEN {leg} * sc <= 0.05 AND a - b > 1e-12 THEN k END) {_DAY_W} AS k0 FROM {leg}2),
{leg}4 AS (SELECT *, max(CASE WHEN k = k0 THEN sc END) {_DAY_W} AS share FROM {leg}3),
{leg}5 AS (SELECT SecuCode, TradingDay, CASE WHEN {leg} <= 0 THEN 0.0 WHEN names * 0.05 < 1 THEN 0.05 WHEN k < coalesce(k0, names) THEN 0.05 ELSE {leg} * share END AS w FROM {leg}4)"""


_CAPPED = f"""{_positions_sql(_ZF)},
pos0 AS (SELECT SecuCode, TradingDay, ret, lp AS l, -sp AS s FROM pos),{_capped_sql('l')},{_capped_sql('s')},
posc AS (SELECT SecuCode, TradingDay, ret, l5.w AS lp, -s5.w AS sp FROM pos0 JOIN l5 USING (SecuCode, TradingDay) JOIN s5 USING (SecuCode, TradingDay))"""

_F4 = ", ".join(f"{c}" for c in _BATCH)
_W10 = "OVER (PARTITION BY SecuCode ORDER BY TradingDay ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
_W20 = _W10.replace("9 PRECEDING", "19 PRECEDING")
_MANY = f"""{PANEL_SQL},
many AS (SELECT SecuCode, TradingDay, lead(excess_return, 2) {_SECU_W} AS ret, CASE WHEN count(raw_close_close) {_W20} = 20 THEN avg(raw_close_close) {_W20} END AS f_mean,
  CASE WHEN count(raw_close_close) {_W10} = 10 THEN stddev_samp(raw_close_close) {_W10} END AS f_std, lag(raw_close_vwap, 3) {_SECU_W} AS f_shift, raw_close_vwap AS f_vwap FROM panel)"""
_PAIRS = [(a, b) for i, a in enumerate(_BATCH) for b in list(_BATCH)[i + 1 :]]

_CELLS = """
cells AS (SELECT user_id AS SecuCode, CAST(ts AS DATE) AS TradingDay, avg(value) AS ret, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS event FROM events GROUP BY ALL),
ever AS (SELECT * FROM cells WHERE SecuCode IN (SELECT SecuCode FROM cells WHERE event = 1)),
days AS (SELECT TradingDay, row_number() OVER (ORDER BY TradingDay) AS t FROM (SELECT DISTINCT TradingDay FROM {0})),
vals AS (SELECT SecuCode, t, ret AS value FROM {0} JOIN days USING (TradingDay))"""
_AROUND = f"""{_CELLS.format('ever')},
around AS (SELECT e.SecuCode, e.TradingDay, e.ret AS size, lag, value FROM ever e JOIN days USING (TradingDay) CROSS JOIN (SELECT unnest(range(-3, 4)) AS lag)
           LEFT JOIN vals v ON v.SecuCode = e.SecuCode AND v.t = days.t + lag WHERE event = 1)"""


def _summary_sql(source: str, by: str) -> str:
    ends = f"(SELECT {by}, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM {source} GROUP BY {by})"
    return f"held AS (SELECT s.*, CASE WHEN value IS NOT NULL THEN greatest(least(value, hi), lo) END AS held FROM {source} s JOIN {ends} USING ({by}))"


_STATS = {
    "mean": "avg(value) * 100", "clip_mean": "avg(held) * 100", "std": "stddev_samp(value) * 100", "t_value": _T("value"), "t_clip": _T("held"),
    "win_rate": "count(CASE WHEN value > 0 THEN 1 END) / nullif(count(value), 0)::DOUBLE * 100", "min": "min(value) * 100", "q25": "quantile_cont(value, 0.25) * 100", "q50": "quantile_cont(value, 0.5) * 100",
    "q75": "quantile_cont(value, 0.75) * 100", "max": "max(value) * 100",
}
_ALL_STATS = ", ".join(_R(e, f'"{c}"') for c, e in _STATS.items()) + ", count(value) AS n, count(CASE WHEN value > 0 THEN 1 END) AS wins"
_SIGNAL = [1, 2, 5]
_BATCH_DAY = """d AS (SELECT {0}, TradingDay, avg(zf * zr) AS ic, covar_pop(rf, rr) / nullif(stddev_pop(rf) * stddev_pop(rr), 0) AS rank_ic, count(*) AS n,
    sum(CASE WHEN zf >= 0 THEN zf * zr END) AS pos, sum(CASE WHEN zf <= 0 THEN zf * zr END) AS neg, count(zf * zr) AS valid FROM z GROUP BY ALL)"""
_BATCH_REPORT = ", ".join(
    _R(e, c)
    for c, e in {
        "ic": "avg(ic) * 100", "t_value": _T("ic"), "ic_pos": "sum(pos) / nullif(sum(valid), 0) * 100", "ic_neg": "sum(neg) / nullif(sum(valid), 0) * 100", "rank_ic": "avg(rank_ic) * 100",
        "icir": "avg(ic) / nullif(stddev_samp(ic), 0)", "winning_rate": "avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) * 100", "ic_min": "min(ic) * 100", "ic_max": "max(ic) * 100", "mean_count": "avg(n)",
    }.items()
) + ", count(ic) AS n_days"


def _sums_sql(n: int) -> str:
    w = f"OVER (PARTITION BY SecuCode ORDER BY TradingDay ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
    return f"SELECT TradingDay, s, {n}::BIGINT AS length, CASE WHEN count(x) {w} = {n} THEN sum(x) {w} END AS v FROM sig"


ORACLE_SQL = {
    "ic_daily": f"WITH {_factor_sql()}{_DAILY} SELECT TradingDay, {_R('ic', 'ic')}, {_R('rank_ic', 'rank_ic')}, n FROM daily",
    "ic_report": f"WITH {_factor_sql()}{_DAILY} {_REPORT.format('daily')}",
    "ic_report_monthly": f"WITH {_factor_sql()}{_DAILY}{_MONTH} {_REPORT.format('monthly')}",
    "ic_report_members": f"WITH {_factor_sql('(SELECT * FROM panel WHERE is_member)')}{_DAILY} {_REPORT.format('daily')}",
    "ic_yearly_ts_mean": f"WITH {_factor_sql()}{_DAILY} SELECT year(TradingDay) AS year, {_R('avg(ic) * 100', 'ic')}, {_R(_T('ic'), 't_value')} FROM daily GROUP BY ALL",
    "ic_cumulative": f"WITH {_factor_sql()}{_DAILY} SELECT TradingDay, {_R('ic', 'ic')}, {_R(f'sum(ic) {_UNTIL}', 'cum_ic')}, {_R(f'avg(ic) {_IN_MONTH}', 'month_ic')} FROM daily",
    "ic_decay": _decay_sql(),
    "group_box": f"""WITH {_factor_sql()}{_ROWS}, z AS (SELECT zf, zr AS r, CASE WHEN zf > 0 THEN 1 ELSE 0 END AS side FROM icrows WHERE zf IS NOT NULL AND zr IS NOT NULL),
e AS (SELECT side, quantile_cont(zf, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM z GROUP BY side),
b AS (SELECT len([x for x in edges if x < zf]) + 1 + 10 * side AS bin, r FROM z JOIN e USING (side)),
q AS (SELECT bin, quantile_cont(r, 0.01) AS lo, quantile_cont(r, 0.99) AS hi FROM b GROUP BY bin)
SELECT bin::BIGINT AS bin, count(*) AS n, {_R('avg(greatest(least(r, hi), lo))', 'mean_ret')} FROM b JOIN q USING (bin) GROUP BY bin""",
    "factor_histogram": f"""WITH {_factor_sql()}, x AS (SELECT f, min(f) OVER () AS lo, max(f) OVER () AS hi FROM based WHERE f IS NOT NULL)
SELECT least(floor((f - lo) / (hi - lo) * 20) + 1, 20)::BIGINT AS bin, count(*) AS n FROM x GROUP BY 1""",
    "factor_quantiles": f"WITH {_factor_sql()} SELECT TradingDay, {', '.join(_R(f'quantile_cont(f, {q / 100})', f'q{q}') for q in (20, 40, 50, 60, 80))}, {_R('avg(f)', 'mean')} FROM based GROUP BY TradingDay",
    "factor_stock_count": f"WITH {_factor_sql()} SELECT TradingDay, count(f) AS n, count(CASE WHEN f <> 0 THEN 1 END) AS n_nonzero FROM based GROUP BY TradingDay",
    "factor_autocorr": _autocorr_sql(),
    "batch_ic": f"""WITH {_MANY}, long AS (UNPIVOT (SELECT TradingDay, ret AS r, {_F4} FROM many) ON {_F4} INTO NAME factor VALUE f),
z AS (SELECT factor, TradingDay, {_Z('f', 'factor, TradingDay')} AS zf, {_CLIP(_Z('r', 'factor, TradingDay'))} AS zr, {_RANK('f', 'factor, TradingDay')} AS rf, {_RANK('r', 'factor, TradingDay')} AS rr FROM long WHERE f IS NOT NULL AND r IS NOT NULL),
{_BATCH_DAY.format('factor')} SELECT factor, {_BATCH_REPORT} FROM d GROUP BY factor""",
    "factor_corr": f"WITH {_MANY} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_R(f'corr({a}, {b})', 'corr')} FROM many" for a, b in _PAIRS),
    "long_short_daily": f"WITH {_factor_sql()}{_positions_sql(_ZF)}{_RETURNS} {_DR}",
    "long_short_capped": f"WITH {_factor_sql()}{_CAPPED}{_RETURNS.replace('FROM pos)', 'FROM posc)')} {_DR}",
    "long_short_top_rank": f"WITH {_factor_sql()}{_positions_sql(_RF, _TOP)}{_RETURNS} {_DR}",
    "return_report": f"WITH {_factor_sql()}{_positions_sql(_ZF)}{_RETURNS.replace('* ret)', '* (ret / 100))')} {_RETREP}",
    "return_report_whole": f"WITH {_factor_sql()}{_positions_sql(_ZF)}{_RETURNS}, whole AS ({_RETREP}) SELECT period, winning_rate, turnover, sharpe, {', '.join(_R(f'sign({c}) * log10(1 + abs({c}))', c) for c in _COMPOUNDED)} FROM whole",
    "return_cumulative": f"WITH {_factor_sql()}{_positions_sql(_ZF)}{_RETURNS} SELECT TradingDay, {_R(f'sum(long_short_ret) {_UNTIL}', 'cum_ret')}, {_R(f'sum(long_short_ret_fee) {_UNTIL}', 'cum_ret_fee')}, {_R(f'sum(long_short_ret) {_IN_MONTH}', 'month_ret')} FROM dr",
    "layer_returns": f"WITH {_factor_sql()}{_LAYERS} SELECT TradingDay, layer, {_R('ret', 'ret')} FROM lr UNION ALL SELECT TradingDay, 0, {_R('avg(ret)', 'ret')} FROM lay GROUP BY TradingDay",
    "layer_cumulative": f"""WITH {_factor_sql()}{_LAYERS} SELECT TradingDay, layer, {_R('sum(ret) OVER (PARTITION BY layer ORDER BY TradingDay ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'cum_ret')} FROM lr
UNION ALL SELECT (SELECT min(TradingDay) FROM lr) - 1, layer, 0.0 FROM (SELECT DISTINCT layer FROM lr)""",
    "event_lags": f"""WITH {_CELLS.format('cells')} SELECT c.SecuCode, c.TradingDay, {_R('p.value', 'before')}, {_R('c.ret', 'same')}, {_R('n.value', 'after')} FROM cells c JOIN days USING (TradingDay)
LEFT JOIN vals p ON p.SecuCode = c.SecuCode AND p.t = days.t - 1 LEFT JOIN vals n ON n.SecuCode = c.SecuCode AND n.t = days.t + 1""",
    "event_study": f"WITH {_AROUND}, {_summary_sql('around', 'lag')} SELECT lag::VARCHAR AS lag, {_ALL_STATS} FROM held GROUP BY lag",
    "event_study_intervals": f"""WITH {_AROUND}, cut AS (SELECT SecuCode, TradingDay, CASE WHEN lag < 0 THEN '-3,0' ELSE '0,3' END AS lag, CASE WHEN count(value) >= 2 THEN avg(value) * 3 END AS value FROM around WHERE lag < 3 GROUP BY ALL),
{_summary_sql('cut', 'lag')} SELECT lag, {_ALL_STATS} FROM held GROUP BY lag""",
    "event_study_grouped": f"""WITH {_AROUND}, ed AS (SELECT quantile_cont(size, [0.25, 0.5, 0.75]) AS edges FROM (SELECT DISTINCT SecuCode, TradingDay, size FROM around)),
g AS (SELECT around.*, 'G' || (len([x for x in edges if x < size]) + 1) AS grp FROM around, ed), {_summary_sql('g', 'lag, grp')}
SELECT lag::VARCHAR AS lag, grp, {', '.join(_R(_STATS[c], c) for c in ('mean', 'clip_mean', 'std', 't_value', 'win_rate', 'q50'))}, count(value) AS n FROM held GROUP BY lag, grp""",
    "event_study_f": f"""WITH {_AROUND}, ed AS (SELECT quantile_cont(size, [0.25, 0.5, 0.75]) AS edges FROM (SELECT DISTINCT SecuCode, TradingDay, size FROM around)),
g AS (SELECT around.*, 'G' || (len([x for x in edges if x < size]) + 1) AS grp FROM around, ed), {_summary_sql('g', 'lag')},
u AS (SELECT lag, grp, value, held, CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END AS win FROM held WHERE value IS NOT NULL AND grp IS NOT NULL),
v AS (SELECT *, avg(value) OVER (PARTITION BY lag, grp) AS gv, avg(held) OVER (PARTITION BY lag, grp) AS gh, avg(win) OVER (PARTITION BY lag, grp) AS gw,
      avg(value) OVER (PARTITION BY lag) AS av, avg(held) OVER (PARTITION BY lag) AS ah, avg(win) OVER (PARTITION BY lag) AS aw FROM u)
SELECT lag::VARCHAR AS lag, count(DISTINCT grp) - 1 AS d1, count(*) - count(DISTINCT grp) AS d2,
{', '.join(_R(f'(sum((g{k} - a{k}) ** 2) / (count(DISTINCT grp) - 1)) / nullif(sum(({x} - g{k}) ** 2) / (count(*) - count(DISTINCT grp)), 0)', f'f_{c}') for c, k, x in (('mean', 'v', 'value'), ('clip', 'h', 'held'), ('win', 'w', 'win')))} FROM v GROUP BY lag""",
    "event_path": f"""WITH {_AROUND}, s AS (SELECT lag AS k, avg(value) AS m, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM around GROUP BY lag),
p AS (SELECT CASE WHEN k >= 0 THEN k + 1 ELSE k END AS step, m, a, b, sum(CASE WHEN k >= 0 THEN m ELSE -m END) OVER (PARTITION BY k >= 0 ORDER BY abs(k) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path FROM s)
SELECT step::BIGINT AS step, {_R('path', 'path')}, {_R('path - m + a', 'low')}, {_R('path - m + b', 'high')} FROM p UNION ALL SELECT 0, 0.0, 0.0, 0.0""",
    "signal_study": f"""WITH {PANEL_SQL}, sig AS (SELECT SecuCode, TradingDay, raw_close_open AS x, CASE WHEN raw_close_close IS NOT NULL THEN {_CLIP(_Z('raw_close_close', 'TradingDay'))} END AS s FROM panel),
c AS ({' UNION ALL '.join(map(_sums_sql, _SIGNAL))})
SELECT CASE WHEN grouping(y) = 1 THEN 'total' ELSE y::VARCHAR END AS period, length, {_R('avg(v) * 100', 'long_short')}, {_R('avg(CASE WHEN NOT s < 0 THEN v END) * 100', '"long"')}, {_R('avg(CASE WHEN NOT s > 0 THEN v END) * 100', 'short')},
CASE WHEN grouping(y) = 1 THEN round({_T('v')}, 6) + 0.0 END AS t_value FROM (SELECT *, year(TradingDay) AS y FROM c WHERE s IS NOT NULL) GROUP BY GROUPING SETS ((length), (length, y))""",
}


def _targets(spark, sf_dir):
    """The panel with the return to explain."""
    return ic.with_return(read_panel(spark, sf_dir), "raw_close_open")


_SCORED = ["ts_mean(raw_close_close,20)", "cs_rank(raw_close_vwap)", "ts_shift(raw_close_low,2)"]


def fitness_batch(spark, sf_dir):
    return _out(search.with_fitness(search.score_batch(_targets(spark, sf_dir), [parse(e) for e in _SCORED])))


def first_components(spark, sf_dir):
    values = evaluate(read_panel(spark, sf_dir), _BATCH)
    return _out(search.first_components(values, list(_BATCH)).select("factor", F.posexplode("pc").alias("day", "entry")))


def genetic_search(spark, sf_dir):
    history = search.Search(size=8, epochs=2, depth=2, seed=7).fit(_targets(spark, sf_dir), [FACTOR])
    return search.fitness_table(spark, history[-1]["scored"])


def out_of_sample(spark, sf_dir):
    return _out(search.out_of_sample(_targets(spark, sf_dir), _SCORED[:2], "1996-01-01"))


QUERIES |= {"fitness_batch": fitness_batch, "first_components": first_components, "genetic_search": genetic_search, "out_of_sample": out_of_sample}

_FIT = {
    _SCORED[0]: f"CASE WHEN count(raw_close_close) {_W20} = 20 THEN avg(raw_close_close) {_W20} END",
    _SCORED[1]: f"(rank() OVER (PARTITION BY TradingDay ORDER BY raw_close_vwap NULLS LAST) + (count(*) OVER (PARTITION BY TradingDay, raw_close_vwap) - 1) / 2.0) / count(raw_close_vwap) {_DAY_W}",
    _SCORED[2]: f"lag(raw_close_low, 2) {_SECU_W}",
}
_LONG = " UNION ALL ".join(f"SELECT '{k}' AS factor_name, TradingDay, {v} AS f, lead(raw_close_open, 2) {_SECU_W} AS ret FROM panel" for k, v in _FIT.items())
ORACLE_SQL["fitness_batch"] = f"""WITH {PANEL_SQL}, l AS ({_LONG}), k AS (SELECT * FROM l WHERE ret IS NOT NULL),
z AS (SELECT factor_name, TradingDay, CASE WHEN f IS NOT NULL THEN {_CLIP(_Z('f', 'factor_name, TradingDay'))} END * ret AS v FROM k),
d AS (SELECT factor_name, TradingDay, avg(v) AS v FROM z GROUP BY ALL),
s AS (SELECT factor_name, avg(v) * 100 AS ic, {_T('v')} AS tvalue, count(v) AS valid_factor_size, count(*) AS days FROM d GROUP BY factor_name),
f AS (SELECT *, CASE WHEN valid_factor_size < greatest(100, days // 5) THEN 0.0 ELSE abs(ic) + 3 * (exp(2 * abs(tvalue) / 3) - 1) / (exp(2 * abs(tvalue) / 3) + 1) END AS fit FROM s)
SELECT factor_name, {_R('ic', 'ic')}, {_R('tvalue', 'tvalue')}, valid_factor_size, {_R('fit', 'fitness_score')}, {_R('fit / sum(fit) OVER ()', 'selection_probability')} FROM f"""
ORACLE_SQL["out_of_sample"] = f"""WITH {PANEL_SQL}, l AS ({_LONG}), k AS (SELECT factor_name, TradingDay, f, ret AS r FROM l WHERE ret IS NOT NULL AND f IS NOT NULL AND TradingDay >= DATE '1996-01-01' AND factor_name <> '{_SCORED[2]}'),
z AS (SELECT factor_name, TradingDay, {_Z('f', 'factor_name, TradingDay')} AS zf, {_CLIP(_Z('r', 'factor_name, TradingDay'))} AS zr, {_RANK('f', 'factor_name, TradingDay')} AS rf, {_RANK('r', 'factor_name, TradingDay')} AS rr FROM k),
{_BATCH_DAY.format('factor_name')} SELECT factor_name AS factor, {_BATCH_REPORT} FROM d GROUP BY factor_name"""


_WIDE = {"mean": FACTOR, "vwap": "raw_close_vwap", "spread": "comb_sub(raw_close_high,raw_close_low)"}
_LEAST = {"all": 0.5, "member": 50.0}


def wide_factor_folder(spark, sf_dir):
    """Factors written as a folder of wide files, read back, and tested in two universes."""
    store = Store(spark)
    panel = ic.with_return(evaluate(read_panel(spark, sf_dir), _WIDE, keep=["is_member", "raw_close_open"]), "raw_close_open").drop("raw_close_open")
    panel = store.saved(panel, "wide-panel")  # it is read three times, and takes less room than what is shuffled to make it
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("file"), F.col(f).alias("factor")) for f in _WIDE]))
    folder = store.folder("wide-factors")
    write_wide(panel.select(SECU, DAY, each.alias("x")).select(SECU, DAY, "x.*").where("factor is not null"), folder, compression="gzip")
    universes = F.array_compact(F.array(F.lit("all"), F.when(F.col("is_member"), F.lit("member"))))
    return _out(folder_layers(read_wide(spark, folder), panel.select(SECU, DAY, "ret", universes.alias("universes")), 10, _LEAST))


QUERIES["wide_factor_folder"] = wide_factor_folder
_WIDE_SQL = {"mean": f"CASE WHEN count(raw_close_close) {_W20} = 20 THEN avg(raw_close_close) {_W20} END", "vwap": "raw_close_vwap", "spread": "raw_close_high - raw_close_low"}
_WIDE_ROWS = " UNION ALL ".join(f"SELECT '{k}' AS file, SecuCode::VARCHAR AS SecuCode, TradingDay, is_member, {v} AS f, lead(raw_close_open, 2) {_SECU_W} AS ret FROM panel" for k, v in _WIDE_SQL.items())
ORACLE_SQL["wide_factor_folder"] = f"""WITH {PANEL_SQL}, l AS ({_WIDE_ROWS}), k AS (SELECT * FROM l WHERE f IS NOT NULL AND ret IS NOT NULL),
u AS (SELECT *, 'all' AS universe FROM k UNION ALL SELECT *, 'member' FROM k WHERE is_member),
n AS (SELECT *, ntile(10) OVER (PARTITION BY file, universe, TradingDay ORDER BY f, SecuCode) AS layer, ret - avg(ret) OVER (PARTITION BY file, universe, TradingDay) AS over FROM u),
d AS (SELECT file, universe, TradingDay, layer, avg(over) AS over FROM n WHERE layer IN (1, 10) GROUP BY ALL),
e AS (SELECT file, universe, sum(CASE WHEN layer = 1 THEN over END) AS first, sum(CASE WHEN layer = 10 THEN over END) AS last FROM d GROUP BY ALL)
SELECT file, universe, {_R('first', 'first')}, {_R('last', 'last')}, coalesce(greatest(first, last) > CASE universe WHEN 'all' THEN 0.5 ELSE 50.0 END, false) AS notable FROM e"""


_LEAVES = [*COLUMNS, *_BATCH]


def factor_corr_many(spark, sf_dir):
    """Correlations of all leaf columns and some factors, whose missing values lie at unlike places."""
    return _out(ic.factor_corr(evaluate(read_panel(spark, sf_dir), _BATCH, keep=list(COLUMNS)), _LEAVES))


QUERIES["factor_corr_many"] = factor_corr_many
_LEAF_SQL = {c: f'"{c}"' for c in COLUMNS} | {c: c for c in _BATCH}
_LEAF_VALUES = ", ".join(f'"{c}"' for c in COLUMNS)
ORACLE_SQL["factor_corr_many"] = f"""WITH {_MANY.replace("raw_close_vwap AS f_vwap FROM", f"raw_close_vwap AS f_vwap, {_LEAF_VALUES} FROM")} """ + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {_R(f'corr({_LEAF_SQL[a]}, {_LEAF_SQL[b]})', 'corr')} FROM many" for i, a in enumerate(_LEAVES) for b in _LEAVES[i + 1 :]
)


register_group_kernel(["reg_resid", "reg_slope", "reg_start"], regression, 2)
register_group_kernel(["reg_resid_ind"], regression, 2, (DAY, INDUSTRY))
_REGRESSIONS = {f"{n}_{k}": f"{n}(raw_close_open,{x})" for n in ("reg_resid", "reg_slope", "reg_start", "reg_resid_ind") for k, x in (("vwap", "raw_close_vwap"), ("mean", "ts_mean(raw_close_close,5)"))}


def day_regressions(spark, sf_dir):
    """Least squares lines across the securities of a day, and of its industries, by group kernels."""
    return _out(evaluate(read_panel(spark, sf_dir), _REGRESSIONS))


QUERIES["day_regressions"] = day_regressions
_W5 = _W10.replace("9 PRECEDING", "4 PRECEDING")


def _line_sql(name: str, keys: str) -> str:
    """Columns of the line of raw_close_open on each regressor, over rows that have both."""
    out = []
    for k in ("vwap", "mean"):
        y, x, w = f"CASE WHEN x_{k} IS NOT NULL THEN y END", f"CASE WHEN y IS NOT NULL THEN x_{k} END", f"OVER (PARTITION BY {keys})"
        flat = f"max({x}) {w} = min({x}) {w}"
        slope = f"covar_pop({y}, {x}) {w} / nullif(var_pop({x}) {w}, 0)"
        out.append(f"CASE WHEN x_{k} IS NOT NULL AND y IS NOT NULL AND NOT {flat} THEN {slope} END AS {name}b_{k}, CASE WHEN x_{k} IS NOT NULL AND y IS NOT NULL THEN avg({y}) {w} - {slope} * avg({x}) {w} END AS {name}a_{k}")
    return ", ".join(out)


ORACLE_SQL["day_regressions"] = f"""WITH {PANEL_SQL}, i AS (SELECT SecuCode, TradingDay, SWF, raw_close_open AS y, raw_close_vwap AS x_vwap, CASE WHEN count(raw_close_close) {_W5} = 5 THEN avg(raw_close_close) {_W5} END AS x_mean FROM panel),
r AS (SELECT *, {_line_sql('d', 'TradingDay')}, {_line_sql('s', 'TradingDay, SWF')} FROM i)
SELECT SecuCode, TradingDay, {', '.join(f"{_R(f'y - db_{k} * x_{k} - da_{k}', f'reg_resid_{k}')}, {_R(f'db_{k}', f'reg_slope_{k}')}, {_R(f'CASE WHEN db_{k} IS NOT NULL THEN da_{k} END', f'reg_start_{k}')}, {_R(f'CASE WHEN SWF IS NOT NULL THEN y - sb_{k} * x_{k} - sa_{k} END', f'reg_resid_ind_{k}')}" for k in ('vwap', 'mean'))} FROM r"""


def event_lags_dense(spark, sf_dir):
    """Lags of half of the cells, so that many days are missing."""
    got = ev.dense_lags(_cells(spark, sf_dir).where(F.pmod(F.dayofyear(DAY) + F.col(SECU), F.lit(2)) == 0), "ret", range(-1, 2))
    return _out(got.select(SECU, DAY, *[F.col(f"`{ev.lag_name('ret', k)}`").alias(n) for k, n in ((-1, "before"), (0, "same"), (1, "after"))]))


def ic_two_weeks(spark, sf_dir):
    """IC of pairs of weeks, each third of the weeks left out, so that periods are empty."""
    daily = ic.daily_ic(_rows(spark, sf_dir)).where(F.pmod(F.datediff(DAY, F.lit("1970-01-05").cast("date")) / 7, F.lit(7)) > 2)
    return _out(periods.resample_ic(daily, "2W"))


def ic_business_months(spark, sf_dir):
    return _out(periods.resample_ic(ic.daily_ic(_rows(spark, sf_dir)), "BM"))


def narrow_types(spark, sf_dir):
    """What the columns of lineitem can be stored as."""
    plan = plan_narrowing(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    return _out(spark.createDataFrame([(p.column, p.new, p.null_share) for p in plan], "column string, new string, null_share double"))


QUERIES |= {q.__name__: q for q in (event_lags_dense, ic_two_weeks, ic_business_months, narrow_types)}
_HALF = _CELLS.format("half").replace("\ndays AS", "\nhalf AS (SELECT * FROM cells WHERE (dayofyear(TradingDay) + SecuCode) % 2 = 0),\ndays AS")
ORACLE_SQL["event_lags_dense"] = f"""WITH {_HALF}, g AS (SELECT SecuCode, days.TradingDay, days.t FROM (SELECT DISTINCT SecuCode FROM half), days),
w AS (SELECT g.SecuCode, g.TradingDay, h.SecuCode IS NOT NULL AS own, p.value AS before, s.value AS same, n.value AS after FROM g LEFT JOIN half h ON h.SecuCode = g.SecuCode AND h.TradingDay = g.TradingDay
LEFT JOIN vals p ON p.SecuCode = g.SecuCode AND p.t = g.t - 1 LEFT JOIN vals s ON s.SecuCode = g.SecuCode AND s.t = g.t LEFT JOIN vals n ON n.SecuCode = g.SecuCode AND n.t = g.t + 1)
SELECT SecuCode, TradingDay, {_R('before', 'before')}, {_R('same', 'same')}, {_R('after', 'after')} FROM w WHERE own OR before IS NOT NULL OR same IS NOT NULL OR after IS NOT NULL"""
_PERIOD = "sum(ic) / nullif(sqrt(count(ic)), 0)"
_PERIOD_OUT = f"{_R(_PERIOD, 'ic')}, {_R(_PERIOD.replace('ic', 'rank_ic'), 'rank_ic')}, {_R('sum(pos)', 'pos')}, {_R('sum(neg)', 'neg')}, sum(n)::BIGINT AS n"
ORACLE_SQL["ic_two_weeks"] = f"""WITH {_factor_sql()}{_DAILY}, k AS (SELECT * FROM daily WHERE (TradingDay - DATE '1970-01-05') // 7 % 7 > 2), b AS (SELECT date_trunc('week', min(TradingDay))::DATE AS lo, max(TradingDay) AS hi FROM k),
s AS (SELECT unnest(generate_series(lo, hi, INTERVAL 14 DAY))::DATE AS start FROM b)
SELECT (start + 13)::DATE AS TradingDay, {_PERIOD_OUT} FROM s LEFT JOIN k ON TradingDay BETWEEN start AND start + 13 GROUP BY start"""
_LAST_WEEKDAY = "(last_day(m) - greatest(isodow(last_day(m)) - 5, 0)::INT)::DATE"
ORACLE_SQL["ic_business_months"] = f"""WITH {_factor_sql()}{_DAILY}, b AS (SELECT date_trunc('month', min(TradingDay))::DATE AS lo, max(TradingDay) AS hi FROM daily),
m AS (SELECT unnest(generate_series(lo, hi + INTERVAL 1 MONTH, INTERVAL 1 MONTH))::DATE AS m FROM b), l AS (SELECT {_LAST_WEEKDAY} AS stop, lag({_LAST_WEEKDAY}) OVER (ORDER BY m) AS before FROM m),
p AS (SELECT stop, before FROM l, b WHERE before IS NULL OR before < hi)
SELECT stop AS TradingDay, {_PERIOD_OUT} FROM p LEFT JOIN daily ON TradingDay <= stop AND (before IS NULL OR TradingDay > before) GROUP BY stop"""
_WHOLE_SQL = lambda c: f"CASE WHEN min({c}) >= -128 AND max({c}) < 128 THEN 'tinyint' WHEN min({c}) >= -32768 AND max({c}) < 32768 THEN 'smallint' WHEN min({c}) >= -2147483648 AND max({c}) < 2147483648 THEN 'int' ELSE 'bigint' END"
_REAL_SQL = lambda c: f"CASE WHEN bool_and({c} = floor({c})) THEN {_WHOLE_SQL(c)} WHEN max(abs({c}::FLOAT::DOUBLE - {c}) / nullif(abs({c}), 0)) <= 1e-7 THEN 'float' ELSE 'double' END"
ORACLE_SQL["narrow_types"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column, {(_REAL_SQL if c in ('l_quantity', 'l_extendedprice', 'l_discount', 'l_tax') else _WHOLE_SQL)(c)} AS new, round(1 - count({c}) / count(*)::DOUBLE, 6) + 0.0 AS null_share FROM lineitem"
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
)
