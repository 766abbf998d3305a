import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest

from factorweave.functions import stats
from factorweave.operators import events, ic, portfolio, search
from factorweave.plans import ast
from factorweave.sources import panel as source
from factorweave.sources import wide
from factorweave.streaming import bars

DAY0 = date(2021, 1, 4)


def day(i):
    return DAY0 + timedelta(days=i)


def test_capped_weights_reach_the_fixpoint(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for d in range(12):
        w = np.array([rng.expovariate(1) if rng.random() < 0.8 else 0.0 for _ in range(rng.randint(2, 30))])
        w = w / w.sum() if w.sum() else w
        rows += [(f"s{i:02d}", day(d), float(v)) for i, v in enumerate(w)]
        c = 0.1
        if (w > 0).sum() * c < 1:
            out = np.where(w > 0, c, 0.0)
        else:
            out = w.copy()
            fixed = np.zeros(len(w), bool)
            while (out > c + 1e-12).any():
                fixed |= out > c + 1e-12
                out[fixed] = c
                rest = ~fixed & (w > 0)
                out[rest] = w[rest] / w[rest].sum() * (1 - c * fixed.sum())
        want |= {(f"s{i:02d}", day(d)): v for i, v in enumerate(out)}
    got = portfolio.capped(spark.createDataFrame(rows, "SecuCode string, TradingDay date, w double"), "w", 0.1).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["w"] == pytest.approx(want[r["SecuCode"], r["TradingDay"]], abs=1e-9)


def test_layers_give_the_rest_to_the_first(spark):
    df = spark.createDataFrame([(f"s{i:02d}", day(0), float(i), 0.1 * i) for i in range(23)], "SecuCode string, TradingDay date, f double, ret double")
    x = portfolio.layer_returns(df, "f", 5).orderBy("layer").collect()
    market = sum(0.1 * i for i in range(23)) / 23
    assert x[0]["ret"] == pytest.approx(market)
    assert x[1]["ret"] == pytest.approx(0.2 - market) and x[5]["ret"] == pytest.approx(0.1 * (19 + 22) / 2 - market)
    assert portfolio.wide_layers(portfolio.layer_returns(df, "f", 5)).columns == ["TradingDay", "layer1", "layer2", "layer3", "layer4", "layer5", "market"]
    assert portfolio.layer_returns(df, "f", 40).count() == 24


def test_buckets_keep_ties_together(spark):
    df = spark.createDataFrame([(float(i),) for i in range(9)], "x double")
    edges = stats.exact_quantiles(df, "x", [0.25, 0.5, 0.75], [])
    got = df.join(edges).select(stats.bucket(df.x, edges.edges).alias("b"), "x").orderBy("x").collect()
    assert [r["b"] for r in got] == [0, 0, 0, 1, 1, 2, 2, 3, 3]


def test_row_lag_and_calendar_lag_differ_at_a_gap(spark):
    df = spark.createDataFrame([("a", day(0), 1.0), ("a", day(2), 3.0), ("b", day(0), 5.0), ("b", day(1), 6.0), ("b", day(2), 7.0)], "SecuCode string, TradingDay date, ret double")
    got = {(r["SecuCode"], r["TradingDay"]): r["ret(t+1)"] for r in events.create_lag(df, "ret", range(-1, 2)).collect()}
    assert got["a", day(0)] is None and got["b", day(0)] == 6.0 and got["b", day(2)] is None


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_exact_quantiles(spark, accuracy):
    """The second run brackets the quantiles of the large group by the sketch."""
    rng = np.random.default_rng(6)
    groups = {"many": rng.normal(size=4000), "ties": rng.integers(0, 4, 900).astype(float), "two": np.array([3.0, 1.0]), "one": np.array([7.0])}
    rows = [(g, float(v)) for g, own in groups.items() for v in own] + [("none", None), ("many", None), ("two", float("nan"))]
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = {r["g"]: r["edges"] for r in stats.exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(3), "v", shares, ["g"], accuracy).collect()}
    assert set(got) == set(groups)
    for g, own in groups.items():
        assert got[g] == pytest.approx(np.quantile(own, shares))


def test_p_values():
    assert stats.beta_inc(2, 3, 0.4) == pytest.approx(0.5248)
    assert stats.f_p(3.0, 2, 20) == pytest.approx(0.0725, abs=2e-3)
    assert stats.f_p(0.0, 3, 10) == pytest.approx(1.0)
    assert stats.proportion_p(50, 100, 0.5) == pytest.approx(1.0)
    assert stats.proportion_p(60, 100, 0.5) == pytest.approx(2 * stats.norm_cdf(-0.1 / math.sqrt(0.0024)))


def test_group_tests(spark):
    groups = {"G1": [0.1, 0.2, 0.3], "G2": [0.2, -0.4, 0.6], "G3": [0.5, 0.5, 0.8]}
    rows = [("0", g, x) for g, own in groups.items() for x in own] + [("0", "G1", None), ("0", None, 0.3), ("1", "G1", 1.0), ("1", "G1", 2.0)]
    df = spark.createDataFrame(rows, "lag string, grp string, value double")
    got = {r["lag"]: r for r in events.group_f(df).collect()}

    def plain(groups):
        flat = [x for g in groups for x in g]
        between = sum(len(g) * (np.mean(g) - np.mean(flat)) ** 2 for g in groups) / 2
        return between / (sum((x - np.mean(g)) ** 2 for g in groups for x in g) / 6)

    assert (got["0"]["d1"], got["0"]["d2"]) == (2, 6)
    assert got["0"]["f_mean"] == pytest.approx(plain(list(groups.values())))
    low, high = np.quantile([x for _, _, x in rows[:9]] + [0.3], [0.05, 0.95])
    assert got["0"]["f_clip"] == pytest.approx(plain([np.clip(g, low, high).tolist() for g in groups.values()]))
    assert got["0"]["f_win"] == pytest.approx(plain([[float(x > 0) for x in g] for g in groups.values()]))
    assert got["1"]["f_mean"] is None
    p = {r["lag"]: r for r in events.group_tests(df).collect()}
    assert p["0"]["p_mean"] == pytest.approx(stats.f_p(got["0"]["f_mean"], 2, 6)) and p["1"]["p_mean"] is None


def test_rank_ic_of_a_perfect_factor(spark):
    df = spark.createDataFrame([(f"s{i}", day(d), float(i), float(i)) for d in range(3) for i in range(10)], "SecuCode string, TradingDay date, f double, ret double")
    got = ic.daily_ic(ic.ic_rows(df, "f")).collect()
    assert all(r["ic"] == pytest.approx(1) and r["rank_ic"] == pytest.approx(0.9) for r in got)


def test_selection_without_fitness_is_even():
    trees = [ast.parse(f"ts_mean(close,{n})") for n in (2, 3, 4)]
    pool = [search.Scored(t, 0.0, 0.0, 5, 0.0) for t in trees]
    seen = {str(search.select(pool, 1, random.Random(s))[0]) for s in range(40)}
    assert seen == {str(t) for t in trees}
    assert len(search.select(pool, 5, random.Random(0))) == 3


def test_uncorrelated_keeps_the_first(spark):
    pcs = spark.createDataFrame([("a", [1.0, 2.0, 3.0, 4.0]), ("b", [-1.0, -2.0, -3.0, -4.1]), ("c", [1.0, -1.0, 1.0, -1.0]), ("d", [2.0, 2.0, 2.0, 2.0])], "factor string, pc array<double>")
    assert search.uncorrelated(["a", "b", "c", "d"], pcs) == ["a", "c", "d"]
    assert search.uncorrelated(["b", "a"], pcs) == ["b"]


@pytest.mark.parametrize("securities", [2048, 3])
def test_first_components_equal_a_singular_value_decomposition(spark, securities):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(11, 6)) * np.array([1, 4, 1, 1, 2, 1])
    seen = rng.random((11, 6)) < 0.8
    rows = [(f"s{i}", day(d), float(x[i, d]) if seen[i, d] else None, 1.0, None) for i in range(11) for d in range(6)]
    values = spark.createDataFrame(rows, "SecuCode string, TradingDay date, a double, flat double, none double")
    got = {r["factor"]: np.array(r["pc"]) for r in search.first_components(values, ["a", "flat", "none"], securities).collect()}
    full = np.where(seen, x, 0.0)
    v = np.linalg.svd(full - full.mean(0), full_matrices=False)[2][0]
    assert np.allclose(got["a"], v * np.sign(v[np.abs(v).argmax()]))
    assert not got["flat"].any() and not got["none"].any() and len(got["none"]) == 6


def small_panel(spark):
    rng = random.Random(8)
    rows = [(f"s{i}", day(d), "i", rng.random(), rng.random(), rng.gauss(0, 1)) for i in range(6) for d in range(130)]
    return spark.createDataFrame(rows, "SecuCode string, TradingDay date, SWF string, close double, high double, ret double")


def test_correlated_trees_stay_with_fitness_0(spark):
    panel = small_panel(spark)
    trees = [ast.parse(e) for e in ("cs_norm(close)", "cs_norm(comb_add(close,close))", "cs_rank(high)", "ts_mean(close,3)")]
    run = search.Search(size=4, batch=2, pc_threshold=0.8)
    before = search.score(panel, trees)
    after = run._unlike(panel, before)
    assert {str(s.tree) for s in after} == {str(t) for t in trees}
    by_name = {str(s.tree): s for s in before}
    pair = sorted((str(trees[0]), str(trees[1])), key=lambda n: (-by_name[n].fitness, n))
    got = {str(s.tree): s.fitness for s in after}
    assert got[pair[1]] == 0.0 and got[pair[0]] == by_name[pair[0]].fitness > 0 and got[str(trees[2])] > 0


def test_a_search_stores_each_epoch_and_is_tested_again(spark, tmp_path):
    panel = small_panel(spark)
    (tmp_path / "start.csv").write_text('factor_name,fitness_score\n"ts_mean(close,3)",1.5\nfactor_name,fitness_score\ncs_rank(high),2.5\ncs_rank(close),0.5\ncs_rank(high),2.5\n')
    given = source.read_warm_start(spark, str(tmp_path / "start.csv"), 2)
    assert given == ["cs_rank(high)", "ts_mean(close,3)"]
    run = search.Search(size=5, epochs=2, depth=2, seed=1, batch=3, warm_start=2, columns=["close", "high"])
    history = run.fit(panel, given, str(tmp_path / "out"))
    assert [len(h["scored"]) for h in history] == [5, 5]
    assert history[0]["scored"] == run.fit(panel, given)[0]["scored"]  # seeded
    values = spark.read.parquet(str(tmp_path / "out" / "values"))
    for h in history:
        names = {str(s.tree) for s in h["saved"]}
        assert {r["factor"] for r in values.where(f"epoch = {h['epoch']}").select("factor").distinct().collect()} == names
    fitness = source.read_fitness(spark, str(tmp_path / "out" / "fitness"))
    assert fitness.count() == 10
    again = search.revalidate(panel, str(tmp_path / "out" / "fitness"), str(day(60)), threshold=0.0, least_t=0.0)
    assert {r["factor"] for r in again.collect()} == {r["factor_name"] for r in search.worth_keeping(fitness, least_t=0.0).collect()}
    assert search.revalidate(panel, str(tmp_path / "out" / "fitness"), str(day(60)), least_t=1e9).count() == 0


def test_warm_start_takes_the_best_of_more(spark):
    panel, rng = small_panel(spark), random.Random(2)
    run = search.Search(size=4, warm_start=3, batch=6, depth=1, columns=["close", "high"])
    trees = run.start(panel, rng, [])
    rng = random.Random(2)
    drawn = {}
    while len(drawn) < 12:
        t = ast.draw(rng, 1, ["close", "high"])
        drawn.setdefault(str(t), t)
    assert trees == [s.tree for s in search.score(panel, list(drawn.values()))[:4]]


def test_notable_factors(spark):
    rows = [(f, u, f"s{i}", day(d), float(i), 0.01 * i * (1 if f == "up" else 0)) for f in ("up", "flat") for u in ("all", "some") for i in range(6) for d in range(4)]
    df = spark.createDataFrame(rows, "file string, universe string, SecuCode string, TradingDay date, factor double, ret double")
    got = {(r["file"], r["universe"]): (r["first"], r["last"], r["notable"]) for r in portfolio.notable_factors(df, 3, {"all": 0.05, "some": 0.5}).collect()}
    assert got["up", "all"] == (pytest.approx(-0.08), pytest.approx(0.08), True) and not got["up", "some"][2] and not got["flat", "all"][2]


def test_batch_report(spark):
    df = small_panel(spark).withColumn("none", stats.F.lit(None).cast("double"))
    out = ic.batch_report(df, ["close", "high", "none"])
    assert out.failed == ["none"] and out.corr.count() == 1
    rows = out.rows.collect()
    assert {r["factor"] for r in rows} == {"close", "high"} and abs(rows[0]["ic"]) >= abs(rows[1]["ic"])
    for r in rows:
        assert r["ic_min"] <= r["ic"] <= r["ic_max"] and r["ic_pos"] + r["ic_neg"] == pytest.approx(r["ic"], abs=0.5)
    assert ic.batch_report(df, ["close", "high"], most_corr=1).corr is None and ic.batch_report(df, ["close", "high"], most_corr=1, force_corr=True).corr.count() == 1


def test_an_annual_rate_needs_something_left(spark):
    df = spark.createDataFrame([(day(i), r, 0.1, -0.1, r, 0.0) for i, r in enumerate([0.5, -2.5, 0.1])], "TradingDay date, long_short_ret double, long_ret double, short_ret double, long_short_ret_fee double, turnover double")
    total = {r["period"]: r for r in portfolio.return_report(df).collect()}["total"]
    assert total["long_short_ret"] is None and total["ir"] is None and total["long_ret"] > 0 and total["tot_long_short_ret"] < -100


def test_evolve_keeps_the_elite_and_the_size():
    rng = random.Random(5)
    pool = [search.Scored(ast.draw(rng, 2), 1.0, 1.0, 200, 10.0 - i) for i in range(10)]
    new = search.evolve(pool, 10, rng, 2, list(ast.COLUMNS))
    assert len(new) == len({str(t) for t in new}) == 10 and pool[0].tree in new


def test_worth_keeping(spark):
    df = spark.createDataFrame([("ts_mean(cs_rank(a),2)", 1.0, 5.0, 100, 1.0), ("cs_rank(a)", 1.0, 5.0, 100, 1.0), ("cs_rank(b)", 1.0, 2.0, 100, 1.0), ("cs_rank(c)", 1.0, 9.0, 10, 1.0)], search._SCORED)
    assert [r["factor_name"] for r in search.worth_keeping(df).collect()] == ["cs_rank(a)"]


def test_wide_csv_and_fitness_files(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("day,000001.SZ,000002.SZ\n2020-01-02,0.1,\n2020-01-03,Infinity,-0.2\n")
    got = {(r["SecuCode"], str(r["TradingDay"])): r["ret"] for r in wide.read_wide_returns(spark, str(tmp_path / "wide.csv")).collect()}
    assert got == {("000001", "2020-01-02"): 0.1, ("000001", "2020-01-03"): 0.0, ("000002", "2020-01-03"): -0.2}
    own = tmp_path / "fit"
    own.mkdir()
    (own / "epoch0.csv").write_text("factor_name,ic,tvalue,valid_factor_size\ncs_rank(a),1.0,4.0,10\nfactor_name,ic,tvalue,valid_factor_size\n")
    (own / "warm_start_up.csv").write_text("factor_name,ic,tvalue,valid_factor_size\ncs_rank(z),1.0,4.0,10\n")
    assert [r["factor_name"] for r in source.read_fitness(spark, str(own)).collect()] == ["cs_rank(a)"]


def test_streamed_bars_equal_batch_bars(spark, tmp_path):
    rows = [(u, datetime(2024, 1, 1) + timedelta(hours=7 * i), float(u + i % 5)) for u in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, value double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = bars.daily_bars(bars.read_events(spark, str(tmp_path / "in"), df.schema))
    bars.start(stream, lambda b, i: b.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = bars.daily_bars(df)
    assert got.count() > 15 and got.exceptAll(want).count() == 0


def test_daily_ic_carries_two_numbers_a_row(spark):
    """As the columns of ic_rows give it, without their windows."""
    from pyspark.sql import functions as F

    values = [(f"s{i}", f"2020-01-0{d}", float((i * 7 + d) % 5), float((i * i + d) % 7) if d != 2 else 1.0) for i in range(12) for d in (1, 2, 3)] + [("s0", "2020-01-04", 1.0, 2.0), ("s1", "2020-01-05", None, 2.0)]
    df = spark.createDataFrame(values, "SecuCode string, day string, f double, ret double").withColumn("TradingDay", F.to_date("day"))
    rows = ic.ic_rows(df, "f")
    daily = ic.daily_ic(rows)
    assert "rank(" not in daily._jdf.queryExecution().executedPlan().toString()
    x = F.col("zf") * F.col("zr")
    want = rows.groupBy("TradingDay").agg(
        F.avg(x).alias("ic"), F.try_divide(F.covar_pop("rf", "rr"), F.nullif(F.stddev_samp("rf") * F.stddev_samp("rr"), F.lit(0.0))).alias("rank_ic"),
        F.sum(F.when(F.col("zf") >= 0, x)).alias("pos"), F.sum(F.when(F.col("zf") <= 0, x)).alias("neg"), F.count(x).alias("n"),
    )
    got, want = ({r["TradingDay"]: tuple(r)[1:] for r in t.collect()} for t in (daily, want))
    assert got.keys() == want.keys() and len(got) == 4
    for day, r in want.items():
        assert [v if v is None else pytest.approx(v) for v in r] == list(got[day]), day


def test_a_day_is_sorted_once_for_ranked_legs(spark, sf):
    from factorweave.plans import analytics

    plan = analytics.long_short_top_rank(spark, sf)._jdf.queryExecution().executedPlan().toString()
    ranked = plan[: plan.index("rank(")] + plan[plan.index("rank(") :].split("Exchange")[0]
    assert ranked.count("Sort [TradingDay") == 1


def test_boxes_are_made_of_stored_scores(spark, sf):
    """Edges and rows are of one computation of the z-scores."""
    from factorweave.plans import analytics

    files = analytics.group_box(spark, sf).inputFiles()
    assert files and all("group-box-" in f for f in files)
