import random
import re

import pytest
from pyspark.sql import functions as F

from factorweave.functions.kernels import KERNELS
from factorweave.operators import queries, search
from factorweave.operators.ic import with_return
from factorweave.operators.registry import OPERATORS
from factorweave.plans.ast import ExpressionError, column, draw, parse
from factorweave.plans.compiler import evaluate
from factorweave.plans.population import Subtrees, across, evaluate_many, has_kernels, over_arrays, over_histories, worth_storing
from factorweave.sources.panel import read_panel


@pytest.fixture(scope="module")
def panel(spark, sf):
    df = with_return(read_panel(spark, sf), "raw_close_open")
    odd = F.when(F.col("TurnoverVolume") % 7 == 0, None).otherwise(F.col("raw_close_vwap"))
    return df.withColumns({"raw_close_vwap": odd, "vwap": F.when(F.col("TurnoverVolume") % 5 == 0, 1.0).otherwise(F.col("vwap")), "low": F.lit(3.7)}).persist()


def table(df, names):
    return {(r[0], r[1]): [r[n] for n in names] for r in df.select("SecuCode", "TradingDay", *names).collect()}


def assert_same(got, want):
    assert got.keys() == want.keys()
    for k, values in want.items():
        for a, b in zip(got[k], values, strict=True):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-7, abs=1e-9)), k


def test_every_kernel_equals_its_operator(panel):
    """With missing values, constant windows and windows longer than some histories."""
    names = {}
    for op in KERNELS:
        inputs = [("close", "open"), ("raw_close_vwap", "vwap")] if OPERATORS[op].arity == 2 else [("raw_close_vwap",), ("vwap",), ("low",)]
        for cols in inputs:
            for n in (1, 2, 3, 6, 15) if OPERATORS[op].takes_n else (None,):
                names[f"f{len(names)}"] = parse(f"{op}({','.join([*cols, *([str(n)] if n else [])])})")
    some = list(names)
    for a in range(0, len(some), 60):
        part = {k: names[k] for k in some[a : a + 60]}
        assert_same(table(over_arrays(panel, part), list(part)), table(evaluate(panel, part), list(part)))


def test_all_time_series_operators_have_a_kernel():
    assert set(KERNELS) == {n for n in queries._BUILT_IN if OPERATORS[n].keys[:1] != ("TradingDay",)}


def trees_of(n, seed=5, depth=3):
    rng, out = random.Random(seed), {}
    while len(out) < n:
        t = draw(rng, depth)
        out[str(t)] = t
    return list(out.values())


def test_what_is_stored():
    trees = [parse(x) for x in ("ts_mean(cs_rank(close),5)", "ts_std(cs_rank(close),5)", "ts_max(ts_mean(open,9),3)", "ts_min(ts_mean(open,9),3)", "ts_mean(ts_std(ts_rms(low,9),4),3)", "ts_max(ts_std(ts_rms(low,9),4),3)")]
    got = [str(x) for x in worth_storing(trees, 10)]
    assert got == ["cs_rank(close)", "ts_std(ts_rms(low,9),4)", "ts_mean(open,9)"]  # ts_rms only occurs inside a stored one
    assert [str(x) for x in worth_storing(trees, 1)] == ["cs_rank(close)"]


def test_values_with_stored_subtrees(panel):
    trees = {f"t{i}": t for i, t in enumerate([*trees_of(12, 8), parse("ts_mean(cs_rank(ts_std(close,3)),4)"), parse("cs_norm(ts_mean(cs_rank(ts_std(close,3)),4))"), parse("ind_neu(close)"), column("close")])}
    want = table(evaluate(panel, trees), list(trees))
    for budget in (1 << 30, 8 * panel.count() * 2, 0):  # all, two of them, none
        with Subtrees(panel, budget=budget) as s:
            s.prepare(list(trees.values()))
            assert len(s.place) == min(len(worth_storing(list(trees.values()), 10**6)), s.most)
            assert_same(table(s.values(trees), list(trees)), want)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning", plan))


def test_batches_exchange_nothing_and_read_what_is_stored(panel, spark):
    trees = trees_of(60)
    with Subtrees(panel) as s:
        s.prepare(trees)
        assert all(across(x) is False for t in trees for x in s.read(t).walk() if x.op)  # those are stored
        old = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        try:
            for a in range(0, 60, 20):
                part = {f"f{i}": t for i, t in enumerate(trees[a : a + 20])}
                assert all(has_kernels(s.read(t)) for t in part.values())
                assert exchanges(s.values(part)) == 0
        finally:
            spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", old)
        used = [t for t in trees if str(s.read(t)) != str(t)]
        assert used and all(c.startswith("sub") or c in panel.columns for t in used for c in s.read(t).columns())
        again = s.made
        s.prepare(trees[:30])  # a later batch or epoch
        assert s.made == again


def test_fitness_of_a_population(panel):
    trees = trees_of(50, 3, 2)
    fast = {str(x.tree): x for x in search.score(panel, trees, batch=20)}
    slow = [x for a in range(0, 50, 40) for x in search.score(panel, trees[a : a + 40], batch=40)]
    for x in slow:
        got = fast[str(x.tree)]
        assert (got.days, got.ic, got.tvalue, got.fitness) == (x.days, pytest.approx(x.ic, rel=1e-7, abs=1e-9), pytest.approx(x.tvalue, rel=1e-7, abs=1e-7), pytest.approx(x.fitness, rel=1e-7, abs=1e-7))


def test_folders_and_tables_go(panel, spark):
    before = {t.name for t in spark.catalog.listTables()}
    with Subtrees(panel) as s:
        s.prepare([parse("cs_rank(close)")])
        paths = list(s.store.paths)
    assert {t.name for t in spark.catalog.listTables()} == before and s.store.paths == []
    assert not any(spark.sparkContext._jvm.java.io.File(p.removeprefix("file://")).exists() for p in paths)


def test_many_at_once_equal_the_compiler(panel):
    """Trees of one security at a time, across days, both, and bare columns; kept columns and errors as there."""
    trees = {f"t{i}": t for i, t in enumerate([*trees_of(8, 21), parse("cs_rank(ts_mean(close,3))"), parse("ind_neu(comb_sub(open,close))"), parse("ts_std(cs_norm(ts_diff(close,1)),4)"), column("vwap")])}
    names = [*trees, "ret", "SWF"]
    assert_same(table(evaluate_many(panel, trees, ["ret"]), [*trees, "ret"]), table(evaluate(panel, trees, ["ret"]), [*trees, "ret"]))
    assert_same(table(evaluate_many(panel, {"a": "ts_mean(close,3)"}, ["ret"]), ["a", "ret"]), table(evaluate(panel, {"a": "ts_mean(close,3)"}, ["ret"]), ["a", "ret"]))
    assert set(names) - {"SWF"} <= set(evaluate_many(panel, trees, ["ret"]).columns)
    with pytest.raises(ExpressionError, match="nothing"):
        evaluate_many(panel, {"a": "ts_mean(nothing,3)"})


def test_short_histories_of_many_securities_in_one_call(spark):
    """Windows and lags end at a security's first day, in any order of rows and for histories longer than a batch."""
    rows = [(secu, day, float((7 * s + 3 * day) % 11) if (s + day) % 9 else None) for s, secu in enumerate([None, *range(1, 40)]) for day in range(1 + (s * 5) % 13 if s != 20 else 300)]
    df = spark.createDataFrame(rows, "SecuCode long, day int, close double").select("SecuCode", F.date_add(F.lit("2020-01-01").cast("date"), F.col("day")).alias("TradingDay"), "close").orderBy(F.xxhash64("day", "SecuCode"))
    names = {f"f{i}": parse(x) for i, x in enumerate(["ts_shift(close,6)", "ts_diff(ts_shift(close,4),3)", "ts_mean(ts_diff(close,6),2)", "ts_max(close,1)", "ts_std(close,5)", "comb_add(close,ts_shift(close,1))"])}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = table(evaluate(df, names), list(names))
    try:
        for most in (3, 50, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            assert_same(table(over_histories(df, names), list(names)), want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_no_windows_by_row_and_few_by_day_in_a_small_population(panel):
    """F8: rolling windows inside and around operators across a day are computed over arrays, each window of a day once."""
    trees = {f"t{i}": parse(x) for i, x in enumerate(["ts_norm_min(cs_rank(open),6)", "cs_norm(ts_kurt(high,9))", "ts_std(ind_neu(ts_mean(cs_norm(close),3)),4)", "comb_mul(low,high)"])}
    plan = evaluate_many(panel.sparkSession.createDataFrame([], panel.schema), trees, ["ret"])._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and not re.search(r"specifiedwindowframe\(RowFrame, -\d", plan)
    assert len(re.findall(r"windowspecdefinition", plan)) == 10  # 4 of the rank, 2 of each z-score
    assert_same(table(evaluate_many(panel, trees, ["ret"]), [*trees, "ret"]), table(evaluate(panel, trees, ["ret"]), [*trees, "ret"]))
