import math
from datetime import date, timedelta

import pytest

from factorweave.plans.ast import ExpressionError
from factorweave.plans.compiler import evaluate


def panel(spark, values, secu="a", industry="i"):
    rows = [(secu, date(2020, 1, 1) + timedelta(days=i), industry, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "SecuCode string, TradingDay date, SWF string, close double")


def series(spark, expression, values):
    return [r["v"] for r in evaluate(panel(spark, values), {"v": expression}).orderBy("TradingDay").collect()]


def test_short_history_is_null(spark):
    assert series(spark, "ts_mean(close,5)", [1, 2, 3]) == [None] * 3


def test_null_inside_a_window(spark):
    assert series(spark, "ts_mean(close,2)", [1, None, 3, 4, 5]) == [None, None, None, 3.5, 4.5]


def test_non_finite_is_missing(spark):
    assert series(spark, "ts_max(close,2)", [1, math.nan, 3, math.inf, 5, 6]) == [None, None, None, None, None, 6.0]


def test_skew_and_kurtosis(spark):
    assert series(spark, "ts_skew(close,5)", [1, 2, 4, 9, 3])[-1] == pytest.approx(1.5491313812566694)
    assert series(spark, "ts_kurt(close,5)", [1, 2, 4, 9, 3])[-1] == pytest.approx(2.6750983101286)


def test_constant_window(spark):
    flat = [2] * 12
    for e, want in (("ts_std(close,5)", 0.0), ("ts_skew(close,5)", 0.0), ("ts_kurt(close,5)", -3.0), ("ts_norm(close,5)", None), ("ts_autocorr(close,10)", None), ("ts_corr_10D(close,close)", None)):
        assert series(spark, e, flat)[-1] == want


def test_user_kernels(spark):
    from factorweave.operators import registry

    registry.register_kernel("ts_spread_of_mine", lambda w: w.max(1) - w.min(1))
    try:
        assert series(spark, "ts_spread_of_mine(close,3)", [1, 5, 2, None, 4, 4, 9]) == [None, None, 4.0, None, None, None, 5.0]
        with pytest.raises(ValueError):
            registry.register_kernel("ts_spread_of_mine", None)
    finally:
        del registry.OPERATORS["ts_spread_of_mine"]


def test_beyond_and_mass(spark):
    x = [1, 2, 1, 2, 1, 2, 1, 2, 1, 30]
    assert series(spark, "ts_ratio_beyond_2sigma(close,10)", x)[-1] == 0.1 and series(spark, "ts_ratio_beyond_3sigma(close,10)", x)[-1] == 0.0
    assert series(spark, "ts_index_mass_median(close,10)", x)[-1] == 1.0


def test_strikes_and_crossings(spark):
    x = [1, 5, 5, 5, 1, 1, 5, 1, 1, 1]
    m = sum(x) / 10
    assert series(spark, "ts_longest_strike_above_mean(close,10)", x)[-1] == 3
    assert series(spark, "ts_longest_strike_below_mean(close,10)", x)[-1] == 3
    assert series(spark, "ts_number_cross_mean(close,10)", x)[-1] == sum((p > m) != (q > m) for p, q in zip(x, x[1:]))


def test_ranks_average_ties(spark):
    df = spark.createDataFrame([(c, date(2020, 1, 1), "i", v) for c, v in zip("abcde", [1.0, 1.0, 2.0, None, 5.0])], "SecuCode string, TradingDay date, SWF string, close double")
    got = {r["SecuCode"]: r["v"] for r in evaluate(df, {"v": "cs_rank(close)"}).collect()}
    assert got == {"a": 0.375, "b": 0.375, "c": 0.75, "d": None, "e": 1.0}


def test_a_single_name_and_no_industry_are_null(spark):
    df = panel(spark, [1, 2]).unionByName(panel(spark, [3, 4], "b", None)).unionByName(panel(spark, [5, 7], "c", None))
    assert {r["v"] for r in evaluate(df, {"v": "ind_neu(close)"}).collect()} == {None}


def test_division_by_zero_is_null(spark):
    assert series(spark, "comb_div(close,comb_sub(close,close))", [1, 2]) == [None, None]


def test_shared_subtrees_equal_single_ones(spark):
    x = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8]
    both = evaluate(panel(spark, x), ["ts_mean(close,3)", "ts_diff(ts_mean(close,3),2)"]).orderBy("TradingDay").collect()
    assert [r["ts_diff(ts_mean(close,3),2)"] for r in both] == series(spark, "ts_diff(ts_mean(close,3),2)", x)
    assert [r["ts_mean(close,3)"] for r in both] == series(spark, "ts_mean(close,3)", x)


def test_unknown_column(spark):
    with pytest.raises(ExpressionError):
        evaluate(panel(spark, [1]), ["cs_rank(volume)"])


def test_empty_panel(spark):
    assert evaluate(panel(spark, []), ["ts_mean(close,3)"]).collect() == []


def test_infinity_on_request(spark):
    from pyspark.sql import functions as F

    from factorweave.functions.stats import ratio

    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 2.0), (None, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(ratio(F.col("a"), F.col("b"), inf=True)).collect()] == [math.inf, -math.inf, None, 0.5, None]


def test_ranks_of_what_is_not_comparable():
    from factorweave.plans import ast

    assert str(ast.combine("comb_add", ast.column("close"), ast.column("vwap"), comparable=False)) == "comb_add(cs_rank(close),cs_rank(vwap))"


def test_correlation_within_a_day(spark):
    from factorweave.operators.registry import OPERATORS, correlation, register_operator

    register_operator("day_corr_3", "pair", correlation(3, within_day=True), keys=("TradingDay",))
    try:
        df = spark.createDataFrame([(s, date(2020, 1, 1), "i", x, y) for s, x, y in zip("abcd", [1.0, 2.0, 3.0, 1.0], [2.0, 4.0, 6.0, 8.0])], "SecuCode string, TradingDay date, SWF string, close double, open double")
        got = {r["SecuCode"]: r["v"] for r in evaluate(df, {"v": "day_corr_3(close,open)"}).collect()}
        assert got["a"] is None and got["b"] is None and got["c"] == pytest.approx(-1.0) and got["d"] == pytest.approx(0.5)
    finally:
        del OPERATORS["day_corr_3"]


def test_correlations_are_computed_by_history(spark):
    """As the window columns of correlation() give them, but without a window that is gone through for each row."""
    import numpy as np

    from factorweave.operators.registry import OPERATORS, correlation, register_operator

    rng = np.random.default_rng(3)
    values = [(f"s{s}", date(2020, 1, 1) + timedelta(days=d), None if (d + s) % 23 == 5 else float(rng.normal()), 1.0 if s == 1 and d < 15 else float(rng.normal())) for s in range(3) for d in range(45)]
    df = spark.createDataFrame(values, "SecuCode string, TradingDay date, open double, close double").repartition(3)
    register_operator("windows_10", "pair", correlation(10), keys=("SecuCode",))
    got = evaluate(df, {"new": "ts_corr_10D(open,close)", "then": "ts_mean(ts_corr_10D(open,close),2)"})
    assert "covar_pop" not in got._jdf.queryExecution().executedPlan().toString()
    try:
        both = got.join(evaluate(df, {"old": "windows_10(open,close)"}), ["SecuCode", "TradingDay"]).collect()
    finally:
        del OPERATORS["windows_10"]
    assert len(both) == 135 and sum(r["new"] is not None for r in both) > 20
    assert [(r["new"] is None) == (r["old"] is None) and (r["new"] is None or abs(r["new"] - r["old"]) < 1e-9) for r in both] == [True] * 135
