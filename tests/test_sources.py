from datetime import date

import pytest
from pyspark.sql import functions as F

from factorweave.operators import ic, portfolio
from factorweave.sources import panel as source

DAYS = [date(2020, 1, d) for d in (1, 2, 3, 6, 7, 8)]
SCHEMA = "SecuCode string, TradingDay date, f double, r double"


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(s, d, float(i + k), 0.01 * ((i * 7 + k * 3) % 5 - 2)) for k, s in enumerate("abcd") for i, d in enumerate(DAYS)], SCHEMA)


def test_joined_and_own_returns_agree(small):
    one = ic.ic_rows(ic.with_return(small, "r", 2), "f")
    two = ic.ic_rows(ic.join_return(small.select("SecuCode", "TradingDay", "f"), small.select("SecuCode", "TradingDay", "r"), "r", 2), "f")
    assert one.count() == 16 and one.exceptAll(two).count() == 0
    assert ic.ic_analysis(small, "f", "r").count() == 2


def test_factor_folder(spark, tmp_path):
    for name, x in (("one", 1.5), ("two", 2.5)):
        (tmp_path / f"{name}.csv").write_text(f"SecuCode,TradingDay,factor\n000001,2020-01-02,{x}\n")
    got = {r["file"]: (str(r["TradingDay"]), r["factor"]) for r in source.read_factor_dir(spark, str(tmp_path)).collect()}
    assert got == {"one": ("2020-01-02", 1.5), "two": ("2020-01-02", 2.5)}


def test_library_is_left_joined(spark, small, tmp_path):
    small.where("SecuCode < 'c'").select("SecuCode", "TradingDay", F.col("f").alias("lib1")).write.parquet(str(tmp_path / "a"))
    small.where("SecuCode = 'a'").select("SecuCode", "TradingDay", F.col("r").alias("lib2")).write.parquet(str(tmp_path / "b"))
    got = source.read_library(spark, [str(tmp_path / "a"), str(tmp_path / "b")], small)
    assert got.count() == 24 and got.where("lib1 is not null").count() == 12 and got.where("lib2 is not null").count() == 6


def test_values_by_epoch(spark, small, tmp_path):
    for epoch in (0, 1):
        source.write_values(small, str(tmp_path / "v"), epoch)
    assert {r["epoch"]: r["count"] for r in spark.read.parquet(str(tmp_path / "v")).groupBy("epoch").count().collect()} == {0: 24, 1: 24}


def test_notable_layers(spark, small):
    layers = portfolio.layer_cumulative(portfolio.layer_returns(small.withColumnRenamed("r", "ret"), "f", 2))
    ends = {r["layer"]: r["cum_ret"] for r in layers.where(F.col("TradingDay") == DAYS[-1]).collect()}
    best = max(ends[1], ends[2])
    assert portfolio.notable_layers({"all": layers}, 2, best - 1e-9) == {"all": True}
    assert portfolio.notable_layers({"all": layers}, 2, {"all": best + 1e-9}) == {"all": False}


def test_members(spark):
    df = spark.createDataFrame([("a", DAYS[0], True), ("b", DAYS[1], None), ("c", DAYS[2], False), ("d", DAYS[3], True)], "SecuCode string, TradingDay date, m boolean")
    assert [r[0] for r in source.members(df, "m").collect()] == ["a", "d"]
    assert [r[0] for r in source.members(df, None, "2020-01-02", "2020-01-03").collect()] == ["b", "c"]


def test_lines_are_dealt_once_for_a_panel(spark, sf):
    from factorweave.sources.panel import read_panel

    plan = read_panel(spark, sf).drop("excess_return")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(SecuCode") == 1 and "partial_sum" in plan
