"""A factor test in one call: from an expression and a panel to all reports."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorweave.functions.stats import DAY, SECU
from factorweave.operators import ic, portfolio
from factorweave.plans.ast import parse
from factorweave.plans.compiler import evaluate
from factorweave.sources.panel import members, params_json, write_report


@dataclass(frozen=True)
class Request:
    """universe: a flag column of the panel, or None for all; warmup: values may use days before `start`."""

    factor_name: str
    factor_expression: str
    return_type: str = "excess_return"
    universe: str | None = None
    start_date: str | None = None
    end_date: str | None = None
    turnover_fee: float = 0.0005
    ret_shift: int = 2
    freq: str = "D"
    normalize: bool = True
    rank: bool = False
    topn: int | None = None
    cap: float | None = 0.05
    warmup: bool = False

    @property
    def name(self) -> str:
        return self.factor_name.strip().replace(" ", "_")


def factor_values(panel: DataFrame, request: Request) -> DataFrame:
    """(SecuCode, TradingDay, factor, ret) of the request's universe and days."""
    if request.return_type not in panel.columns:
        raise ValueError(f"the panel has no return {request.return_type}")
    panel = members(panel, request.universe)
    if not request.warmup:
        panel = members(panel, None, request.start_date, request.end_date)
    values = evaluate(panel, {"factor": parse(request.factor_expression)}, keep=[request.return_type])
    led = ic.with_return(values, request.return_type, request.ret_shift)
    return members(led, None, request.start_date, request.end_date) if request.warmup else led


class Reports(dict[str, DataFrame]):
    """The reports by name; what they share stays in the executors' storage until close(), or the end of a with block."""

    def __init__(self, reports: dict[str, DataFrame], shared: list[DataFrame]):
        super().__init__(reports)
        self.shared = shared

    def close(self) -> None:
        while self.shared:
            self.shared.pop().unpersist()

    def __enter__(self) -> Reports:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def backtest(panel: DataFrame, request: Request) -> Reports:
    """All reports of a factor; one whose mean IC is below 0 is held the other way.

    The data behind each chart: histogram, quantiles, counts, autocorrelation, group boxes,
    decay, running IC and returns.  The values are computed once and kept while reports are.
    """
    values = factor_values(panel, request).persist()
    rows = ic.ic_rows(values, "factor").persist()
    daily = ic.daily_ic(rows)
    mean = daily.agg(F.avg("ic")).first()[0]
    how = {"normalize": request.normalize, "rank": request.rank, "topn": request.topn, "cap": request.cap, "inverse": mean is not None and mean < 0}
    returns = portfolio.daily_returns(portfolio.positions(values, "factor", **how), request.turnover_fee)
    reports = {
        "values": values.select(SECU, DAY, F.col("factor").alias(request.name)), "ic_rst": ic.ic_report(ic.by_period(daily, request.freq)), "ic_ts": daily.select(DAY, "ic", "rank_ic"),
        "ret_rst": portfolio.return_report(returns), "daily": returns, "histogram": ic.factor_histogram(values, "factor"), "quantiles": ic.factor_quantiles(values, "factor"),
        "stock_count": ic.factor_stock_count(values, "factor"), "autocorr": ic.factor_autocorr(values, "factor"), "group_box": ic.group_box(rows), "decay": ic.ic_decay(rows),
        "ic_cumsum": ic.ic_cumulative(daily), "ret_cumsum": portfolio.cumulative_returns(returns),
    }
    return Reports(reports, [values, rows])


def save(reports: dict[str, DataFrame], request: Request, path: str) -> None:
    """The two report tables as CSV, and the request as a line of JSON, below path/name."""
    base = f"{path.rstrip('/')}/{request.name}"
    for name in ("ic_rst", "ret_rst"):
        write_report(reports[name], f"{base}/{name}.csv")
    spark = reports["ic_rst"].sparkSession
    spark.createDataFrame([(params_json(**asdict(request)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/params.json")


def layers_by_universe(panel: DataFrame, request: Request, universes: list[str | None], groups: int = 20) -> dict[str, DataFrame]:
    """Running layer returns of one factor in each universe; None is the whole market."""
    out = {}
    for u in universes:
        values = factor_values(panel, Request(**{**asdict(request), "universe": u}))
        out[u or "all"] = portfolio.layer_cumulative(portfolio.layer_returns(values, "factor", groups))
    return out
