import random
import time
from datetime import date, timedelta

import pytest

from factorweave.plans.ast import ExpressionError, parse
from factorweave.plans.compiler import evaluate
from factorweave.streaming.rolling import look_back, rolling

SCHEMA = "SecuCode string, TradingDay date, close double, high double"
TREES = {"mean": "ts_mean(close,5)", "corr": "ts_corr_20D(close,high)", "deep": "ts_max(comb_sub(ts_shift(close,3),ts_rms(high,6)),4)", "leaf": "close", "diff": "ts_diff(close,2)"}


def bars(days=60):
    rng = random.Random(1)
    return [(s, date(2020, 1, 1) + timedelta(days=d), None if rng.random() < 0.03 else rng.uniform(1, 9), rng.uniform(1, 9)) for d in range(days) for s in "abc" if rng.random() < 0.9]


def streamed(spark, tmp_path, batches, name, expressions=TREES, **how):
    """The rows that the stream of these batches gives, each a file."""
    folder = tmp_path / name
    folder.mkdir()
    for i, rows in enumerate(batches):
        file = spark.createDataFrame(rows, SCHEMA).coalesce(1)
        file.write.parquet(str(tmp_path / "one"), mode="overwrite")
        next((tmp_path / "one").glob("part-*")).rename(folder / f"{i:03d}.parquet")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(folder))
    query = rolling(source, expressions, **how).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return {(r[0], r[1]): tuple(r)[2:] for r in spark.table(name).collect()}


def assert_same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert all((a is None) == (b is None) and (a is None or a == pytest.approx(b)) for a, b in zip(got[k], want[k], strict=True)), k


def batch_values(spark, rows, expressions=TREES):
    return {(r[0], r[1]): tuple(r)[2:] for r in evaluate(spark.createDataFrame(rows, SCHEMA), expressions).collect()}


def cut(rows, days):
    first = rows[0][1]
    out = {}
    for r in rows:
        out.setdefault((r[1] - first).days // days, []).append(r)
    return [out[k] for k in sorted(out)]


def test_look_back():
    assert [look_back(parse(t)) for t in TREES.values()] == [4, 19, 3 + 5, 0, 2]
    assert look_back(parse("ts_mean(ts_rms(close,9),3)")) == 10


@pytest.mark.parametrize("days", [1, 7])
def test_equals_the_batch(spark, tmp_path, days):
    rows = bars(40 if days == 1 else 60)[: 60 if days == 1 else None]
    assert_same(streamed(spark, tmp_path, cut(rows, days), f"s{days}"), batch_values(spark, rows))


def test_late_and_repeated_bars(spark, tmp_path):
    rows = bars(30)
    batches = cut(rows, 5)
    late = batches[2].pop(0)  # comes with the next batch: within the days of grace
    batches[3].append(late)
    batches[4] += [batches[0][0], batches[4][0], (None, date(2020, 3, 1), 1.0, 1.0), ("a", None, 1.0, 1.0)]  # long put out; repeated
    got = streamed(spark, tmp_path, batches, "late", grace_days=9)
    want = batch_values(spark, rows)
    newest = {s: max(r[1] for r in rows if r[0] == s) for s in "abc"}
    assert_same(got, {k: v for k, v in want.items() if k[1] + timedelta(days=9) <= newest[k[0]]})


def test_a_bar_too_late_is_left_out(spark, tmp_path):
    rows = [r for r in bars(20) if r[0] == "a"]
    batches = [rows[:5], rows[6:12], [rows[5]], rows[12:]]
    assert_same(streamed(spark, tmp_path, batches, "toolate"), batch_values(spark, rows[:5] + rows[6:]))


def test_only_one_security_at_a_time(spark):
    source = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ExpressionError, match="cs_rank"):
        rolling(source, {"x": "ts_mean(cs_rank(close),3)"})


def test_waiting_bars_go_out_after_the_timeout(spark, tmp_path):
    folder = tmp_path / "in"
    spark.createDataFrame([r for r in bars(8) if r[0] == "a"], SCHEMA).coalesce(1).write.parquet(str(folder))
    source = spark.readStream.schema(SCHEMA).parquet(str(folder))
    query = rolling(source, {"m": "ts_mean(close,2)"}, grace_days=3, timeout="1 second").writeStream.format("memory").queryName("timeout").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
    try:
        n, until = len([r for r in bars(8) if r[0] == "a"]), time.time() + 120
        while spark.table("timeout").count() < n and time.time() < until:
            time.sleep(0.5)
        assert spark.table("timeout").count() == n
    finally:
        query.stop()
