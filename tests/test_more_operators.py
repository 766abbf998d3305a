import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorweave.functions import narrow, stats
from factorweave.functions.kernels import regression
from factorweave.operators import events, periods
from factorweave.operators.registry import OPERATORS, register_group_kernel
from factorweave.plans.ast import ExpressionError, apply, column, draw, parse
from factorweave.plans.compiler import evaluate


def day(i):
    return date(2020, 1, 1) + timedelta(days=i)


@pytest.fixture(scope="module")
def kernels():
    calls = []

    def double_and_rank(x):
        return 2 * x, np.argsort(np.argsort(x)) + 1.0

    if "k_double" not in OPERATORS:
        register_group_kernel(["k_double", "k_place"], double_and_rank)
        register_group_kernel("k_share", lambda x: x / x.sum(), 1, ("TradingDay", "SWF"))
        register_group_kernel("k_slope", lambda y, x: regression(y, x)[1], 2)
    return calls


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(2)
    rows = [(f"s{i}", day(d), rng.choice(["x", "y", None]), rng.uniform(1, 9) if rng.random() < 0.8 else None, rng.uniform(1, 9) if rng.random() < 0.9 else float("inf")) for d in range(6) for i in range(12)]
    rows += [("z", day(9), "x", 1.0, 2.0), ("z", day(10), None, None, None)]
    return spark.createDataFrame(rows, "SecuCode string, TradingDay date, SWF string, close double, high double").repartition(3)


def test_group_kernels_equal_pandas(panel, kernels):
    names = {"twice": "k_double(close)", "place": "k_place(close)", "share": "k_share(ts_mean(close,2))", "slope": "k_slope(close,high)", "after": "ts_diff(k_place(high),1)", "mixed": "cs_rank(k_double(close))"}
    got = evaluate(panel, names, keep=["high"]).toPandas().sort_values(["SecuCode", "TradingDay"]).reset_index(drop=True)
    pdf = panel.toPandas().replace([np.inf], np.nan).sort_values(["SecuCode", "TradingDay"]).reset_index(drop=True)
    by_day = pdf.groupby("TradingDay")
    mean = pdf.groupby("SecuCode")["close"].transform(lambda s: s.rolling(2).mean())
    share = mean / mean.where(mean.notna()).groupby([pdf["TradingDay"], pdf["SWF"]]).transform("sum")

    def slope(g):
        own = g.dropna(subset=["close", "high"])
        return pd.Series(np.polyfit(own["high"], own["close"], 1)[0] if len(own) > 1 else np.nan, own.index).reindex(g.index)

    want = {"twice": 2 * pdf["close"], "place": by_day["close"].rank(), "share": share, "mixed": by_day["close"].rank(pct=True), "slope": pd.concat([slope(g) for _, g in by_day]).sort_index()}
    high = by_day["high"].rank()
    want["after"] = high - high.groupby(pdf["SecuCode"]).shift(1)
    for k, w in want.items():
        assert np.allclose(got[k].astype(float), w.astype(float), equal_nan=True), k


def test_outputs_of_the_same_inputs_are_one_call(panel, kernels):
    plan = evaluate(panel, ["k_double(close)", "k_place(close)", "k_place(high)"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1


def test_group_kernels_are_operators(panel, kernels):
    assert str(parse("k_slope(close,high)")) == "k_slope(close,high)"
    with pytest.raises(ExpressionError):
        apply("k_slope", column("close"))
    with pytest.raises(ExpressionError, match="SWF"):
        evaluate(panel.drop("SWF"), ["k_share(close)"])
    with pytest.raises(ValueError, match="one or two"):
        register_group_kernel("k_three", lambda *x: x, 3)
    with pytest.raises(ValueError, match="TradingDay"):
        register_group_kernel("k_secu", lambda x: x, 1, ("SecuCode",))
    assert not any("k_" in str(draw(random.Random(i), 3)) for i in range(300))  # a weight of 0


def table(df, *names):
    return {r[0]: tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize(("freq", "pandas"), [("M", "ME"), ("MS", "MS"), ("Q", "QE"), ("QS", "QS"), ("Y", "YE"), ("W", "W"), ("BM", "BME"), ("BQ", "BQE"), ("D", "D")])
@pytest.mark.parametrize("seed", [1, 2])
def test_periods_equal_pandas(spark, freq, pandas, seed):
    rng = random.Random(seed)
    days = sorted(rng.sample(range(900), 25)) + [903, 905]  # with wide gaps
    rows = [(day(d), rng.uniform(-1, 1) if rng.random() < 0.9 else None) for d in days]
    df = spark.createDataFrame(rows, "TradingDay date, x double")
    got = {d: v for d, v in table(periods.resample(df, freq, {"n": F.count("x"), "s": F.sum("x")}), "n", "s").items()}
    own = pd.Series([r[1] for r in rows], pd.DatetimeIndex([r[0] for r in rows])).astype(float).resample(pandas)
    want = {d.date(): (int(n), s if n else None) for d, n, s in zip(own.count().index, own.count(), own.sum(), strict=True)}
    assert set(got) == set(want)
    for d, (n, s) in want.items():
        assert got[d] == (n, None if s is None else pytest.approx(s))
    some = periods.resample(df, freq, {"s": F.sum("x")}, empty=False)
    assert some.count() == len({d for d in want if any(True for _ in [0]) and own.size().loc[pd.Timestamp(d)] > 0})


def test_periods_of_several_units_and_wrong_ones(spark):
    df = spark.createDataFrame([(day(0), 1.0), (day(20), 2.0), (day(100), 4.0)], "TradingDay date, x double")
    assert table(periods.resample(df, "2W", {"s": F.sum("x")}), "s") == {date(2020, 1, 12): (1.0,), date(2020, 1, 26): (2.0,), **{date(2020, 1, 26) + timedelta(days=14 * k): (4.0 if k == 6 else None,) for k in range(1, 7)}}
    assert table(periods.resample(df, "3MS", {"s": F.sum("x")}), "s") == {date(2020, 1, 1): (3.0,), date(2020, 4, 1): (4.0,)}
    assert periods.resample(df.limit(0), "M", {"s": F.sum("x")}).collect() == []
    for wrong in ("X", "BW", "BMS", "0M", "M2"):
        with pytest.raises(ValueError, match="no frequency"):
            periods.spine(df, wrong)


def test_dense_lags_against_a_grid(spark):
    rng = random.Random(4)
    rows = [(s, day(d), rng.choice([None, float(d), float(d) / 3])) for s in "abc" for d in rng.sample(range(40), 9)]
    df = spark.createDataFrame(rows, "SecuCode string, TradingDay date, ret double")
    days = sorted({r[1] for r in rows})
    value = {(s, d): v for s, d, v in rows}
    want = {}
    for s in "abc":
        for i, d in enumerate(days):
            lags = tuple(value.get((s, days[i + k])) if 0 <= i + k < len(days) else None for k in (-1, 0, 2))
            if (s, d) in value or any(v is not None for v in lags):
                want[s, d] = lags
    got = {(r[0], r[1]): tuple(r[f"ret(t{k:+d})"] for k in (-1, 0, 2)) for r in events.dense_lags(df, "ret", [-1, 0, 2]).collect()}
    assert got == want and len(want) > len(rows)


def test_narrowed_types(spark):
    rows = [(1, 300, 70_000, 5_000_000_000, 1.0, 0.1, 1e300, float("nan"), None), (-128, -5, 3, 4, 100.0, 1 / 3, 1.0, 2.0, None), (None, 7, 3, 4, None, 2.5, 1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "a long, b int, c long, d long, e double, f double, g double, h double, i double")
    plan = {p.column: p for p in narrow.plan_narrowing(df)}
    assert {c: p.new for c, p in plan.items()} == {"a": "tinyint", "b": "smallint", "c": "int", "d": "bigint", "e": "tinyint", "f": "float", "g": "double", "h": "float", "i": "double"}
    assert plan["a"].null_share == pytest.approx(1 / 3) and 0 < plan["f"].loss < 1e-7 and plan["e"].loss == 0
    out = narrow.narrow(df)
    assert dict(out.dtypes) == {c: p.new for c, p in plan.items()}
    for old, new in zip(df.collect(), out.collect(), strict=True):
        assert all((a is None and b is None) or a == pytest.approx(b, rel=1e-7, nan_ok=True) for a, b in zip(old, new, strict=True))
    exact = {p.column: p.new for p in narrow.plan_narrowing(df, loss=0.0, whole=False)}
    assert exact["f"] == "double" and exact["e"] == "float" and exact["h"] == "float"
    assert narrow.plan_narrowing(df.limit(0))[0].new == "bigint" and narrow.narrow(df.select(F.lit("x").alias("s"))).dtypes == [("s", "string")]
    zero = spark.createDataFrame([(-0.0,), (1.0,)], "z double")
    assert narrow.plan_narrowing(zero)[0].new == "float" and str(narrow.narrow(zero).first()[0]) == "-0.0"


def test_quantiles_of_all_rows_and_missed_brackets(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=3000)
    df = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(3)
    got = stats.exact_quantiles(df, "v", [0.0, 0.25, 0.9, 1.0], [], accuracy=50).collect()
    assert len(got) == 1 and got[0].asDict().keys() == {"edges"} and np.allclose(got[0]["edges"], np.quantile(x, [0, 0.25, 0.9, 1]))


def test_event_summary_takes_large_groups_and_leaves_null_ones(spark):
    rng = np.random.default_rng(5)
    rows = [(str(k), g, float(v)) for k in (0, 1) for g in ("a", None) for v in rng.normal(size=200)] + [("2", "a", None)]
    df = spark.createDataFrame(rows, "lag string, grp string, value double")
    got = {(r["lag"], r["grp"]): r for r in events.event_summary(df, ["grp"]).collect()}
    assert set(got) == {("0", "a"), ("1", "a"), ("2", "a")} and got["2", "a"]["n"] == 0 and got["2", "a"]["q50"] is None
    for k in ("0", "1"):
        v = np.array([r[2] for r in rows if r[:2] == (k, "a")])
        q = np.quantile(v, [0.05, 0.25, 0.5, 0.75, 0.95])
        r = got[k, "a"]
        assert [r["q25"], r["q50"], r["q75"], r["clip_mean"]] == pytest.approx([*(100 * q[1:4]), 100 * np.clip(v, q[0], q[4]).mean()])
