import pytest

from factorweave.plans.backtest import Request, backtest, layers_by_universe, save
from factorweave.sources.panel import read_panel


def test_a_request_gives_all_reports(spark, sf, tmp_path):
    panel = read_panel(spark, sf)
    request = Request("my factor", "ts_mean(raw_close_close,20)", start_date="1995-06-01", end_date="1998-12-31")
    got = backtest(panel, request)
    assert got["values"].columns == ["SecuCode", "TradingDay", "my_factor"]
    assert [r["period"] for r in got["ic_rst"].orderBy("period").collect()] == ["1995", "1996", "1997", "1998", "total"]
    assert all(df.count() > 0 for df in got.values())
    save(got, request, str(tmp_path))
    assert spark.read.csv(f"{tmp_path}/my_factor/ic_rst.csv", header=True).count() == 5
    assert '"factor_expression": "ts_mean(raw_close_close,20)"' in spark.read.text(f"{tmp_path}/my_factor/params.json").first()[0]


def test_warmup_fills_the_first_days(spark, sf):
    from factorweave.plans.backtest import factor_values

    panel = read_panel(spark, sf)
    one = {w: factor_values(panel, Request("f", "ts_mean(raw_close_close,20)", start_date="1996-01-01", end_date="1996-12-31", warmup=w)).where("factor is null").count() for w in (False, True)}
    assert one[True] < one[False]


def test_universes(spark, sf):
    got = layers_by_universe(read_panel(spark, sf), Request("f", "raw_close_vwap"), [None, "is_member"], 3)
    assert set(got) == {"all", "is_member"} and all(df.where("layer = 1").count() > 10 for df in got.values())


def test_unknown_return(spark, sf):
    with pytest.raises(ValueError):
        backtest(read_panel(spark, sf), Request("f", "close", return_type="nope"))
