import math
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from factorweave.operators import portfolio
from factorweave.sources import wide
from factorweave.sources.shared import Store, shared_folder


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_files_of_unlike_headers(spark, tmp_path):
    (tmp_path / "one.csv").write_text(',000001.SZ,"000002.SH",000003\n2020-01-02,1.5,,inf\n2020/1/3,x,2.5\n20200106,3,4,5,6\nno day,7,8,9\n')
    (tmp_path / "two.csv").write_text("date,000009\r\n2020-01-02 00:00:00,-inf\r\n2020-01-03,nan\r\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("date,a,b\n")
    got = rows(wide.read_wide(spark, str(tmp_path)))
    day = lambda d: date(2020, 1, d)
    want = [("one", "000001", day(2), 1.5), ("one", "000003", day(2), math.inf), ("one", "000002", day(3), 2.5), *[("one", f"00000{k}", day(6), k + 2.0) for k in (1, 2, 3)], ("two", "000009", day(2), -math.inf)]
    assert [r for r in got if r[3] == r[3]] == sorted(want) and [r[:3] for r in got if r[3] != r[3]] == [("two", "000009", day(3))]
    back = rows(wide.read_wide_returns(spark, str(tmp_path / "two.csv")))
    assert back == [("000009", day(2), 0.0)]


def test_a_file_in_several_splits_has_one_header(spark, tmp_path):
    days = [f"{1990 + i // 12}-{i % 12 + 1:02d}-01" for i in range(360)]
    (tmp_path / "f.csv").write_text("d,a,b\n" + "".join(f"{d},{i},{-i}\n" for i, d in enumerate(days)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        df = wide.read_wide(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 1
        assert df.count() == 720 and df.agg(F.sum("factor")).first()[0] == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("n", [3, 5000])
def test_the_plan_does_not_grow_with_the_securities(spark, tmp_path, n):
    (tmp_path / "f.csv").write_text("d," + ",".join(f"s{i}" for i in range(n)) + "\n" + "\n".join(f"2020-01-{d:02d}," + ",".join(str(i * d) for i in range(n)) for d in (1, 2)))
    df = wide.read_wide(spark, str(tmp_path))
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 4000
    assert df.count() == 2 * n and df.agg(F.sum("factor")).first()[0] == 3 * n * (n - 1) / 2


def test_written_and_read_back(spark):
    long = [("x", "b", date(2020, 1, 2), 1.25), ("x", "a", date(2020, 1, 3), -1e-17), ("x", "c", date(2020, 1, 3), 3.0), ("y y", "b", date(2019, 1, 2), 0.1 + 0.2), ("y y", "b", date(2019, 1, 2), 0.1)]
    df = spark.createDataFrame([*long, (None, "a", date(2020, 1, 1), 1.0), ("x", "d", date(2020, 1, 3), None)], "file string, SecuCode string, TradingDay date, factor double")
    with Store(spark) as store:
        folder = store.folder("wide")
        wide.write_wide(df, folder)
        assert rows(wide.read_wide(spark, folder)) == sorted(long[:-1])
    assert spark.sparkContext._jvm.java.io.File(folder.removeprefix("file://")).exists() is False


def test_folder_of_wide_files_by_universe(spark, tmp_path):
    days, codes = [date(2020, 1, d) for d in range(1, 9)], [f"{i:06d}" for i in range(12)]
    values = {"up": lambda i, d: i + 0.01 * d, "down": lambda i, d: -i}
    for name, f in values.items():
        (tmp_path / f"{name}.csv").write_text("d," + ",".join(f"{c}.SZ" for c in codes) + "\n" + "\n".join(f"{x}," + ",".join(str(f(i, k)) for i in range(12)) for k, x in enumerate(days)))
    ret = spark.createDataFrame([(c, x, 0.01 * i * (1 if k % 3 else -0.2)) for i, c in enumerate(codes) for k, x in enumerate(days)], "SecuCode string, TradingDay date, ret double")
    returns = {"all": ret, "few": ret.where("SecuCode < '000006'")}
    got = {(r["file"], r["universe"]): r for r in wide.folder_layers(wide.read_wide(spark, str(tmp_path)), returns, 4, {"all": 0.1, "few": 1.0}).collect()}
    assert set(got) == {(f, u) for f in values for u in returns}
    for (f, u), r in got.items():
        df = returns[u].join(wide.read_wide(spark, str(tmp_path)).where(F.col("file") == f), ["SecuCode", "TradingDay"])
        ends = {x["layer"]: x["cum_ret"] for x in portfolio.layer_cumulative(portfolio.layer_returns(df, "factor", 4)).where(F.col("TradingDay") == days[-1]).collect()}
        assert (r["first"], r["last"]) == (pytest.approx(ends[1]), pytest.approx(ends[4]))
        assert r["notable"] == (max(ends[1], ends[4]) > {"all": 0.1, "few": 1.0}[u])
    assert rows(wide.notable_files(wide.folder_layers(wide.read_wide(spark, str(tmp_path)), returns, 4, {"all": 0.1, "few": 1.0}))) == [("down",), ("up",)]


def test_no_local_folder_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(dict)  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_a_line_is_split_once_and_not_for_each_cell(spark, tmp_path):
    (tmp_path / "f.csv").write_text("d,a,b\n2020-01-02,1,2\n")
    above, generate, _ = wide.read_wide(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().partition("Generate ")
    assert generate and "split(" not in above and "regexp_extract(" not in above


def test_large_files_are_written_in_parts(spark, tmp_path):
    days = [date(2020, 1, d) for d in range(1, 21)]
    df = spark.createDataFrame([(f, c, d, float(d.day)) for f in "xy" for c in "abc" for d in days if (c, d.day) != ("b", 3)], "file string, SecuCode string, TradingDay date, factor double")
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # else tasks of little are put together
    spark.conf.set(key, "false")
    try:
        wide.write_wide(df, str(tmp_path / "wide"), part_cells=10)
    finally:
        spark.conf.unset(key)
    parts = list((tmp_path / "wide" / "file=x").glob("*.txt"))
    assert len(parts) > 1 and all(p.read_text().startswith("TradingDay,a,b,c\n") for p in parts)
    assert rows(wide.read_wide(spark, str(tmp_path / "wide"))) == rows(df)


def dealt(spark, job):
    """How many rows a job writes to shuffles."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def rows_by_stage():
        stages = store.stageList(None, False, False, none, None)
        return {s.stageId(): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}

    before = rows_by_stage()
    job()
    return sum(n for k, n in rows_by_stage().items() if k not in before)


def long_rows(spark, files="xyz", codes=20, days=50):
    return spark.range(codes * days).selectExpr(f"explode(split('{','.join(files)}', ',')) file", f"cast(id % {codes} as int) SecuCode", f"date_add(date'2020-01-01', cast(id div {codes} as int)) TradingDay", "cast(xxhash64(id) as double) factor")


def test_cells_are_dealt_once_to_be_written(spark, tmp_path):
    df = long_rows(spark)
    assert dealt(spark, lambda: wide.write_wide(df, str(tmp_path / "wide"))) < 1.2 * df.count()
    assert rows(wide.read_wide(spark, str(tmp_path / "wide"))) == rows(df.withColumn("SecuCode", F.col("SecuCode").cast("string")))


def test_factors_and_returns_are_dealt_once_to_be_layered(spark):
    factors = long_rows(spark)
    ret = long_rows(spark, "r").select("SecuCode", "TradingDay", F.col("factor").alias("ret"))
    layers = wide.folder_layers(factors, {"all": ret, "few": ret.where("SecuCode < 12")}, 5, {"all": 0.0, "few": 0.0})
    key = "spark.sql.autoBroadcastJoinThreshold"  # else rows as few as these would be broadcast
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        assert dealt(spark, layers.collect) < 1.2 * (factors.count() + 1.6 * ret.count())
    finally:
        spark.conf.set(key, old)


def test_layers_equal_those_of_joined_rows(spark):
    """Of repeated rows, ties, days of few securities, keys of one side and missing values, with universes as dicts and as lists."""
    factors = long_rows(spark).withColumn("factor", F.when(F.col("SecuCode") == 3, float("nan")).otherwise(F.pmod(F.col("factor"), F.lit(7.0)))).where("TradingDay < '2020-02-10' or SecuCode < 2")
    ret = long_rows(spark, "r", 23).select("SecuCode", "TradingDay", F.when(F.col("SecuCode") != 5, F.col("factor") / 1e19).alias("ret"))
    again = ret.where("SecuCode = 7").unionByName(ret)
    few = ret.where("SecuCode in (0, 4, 7, 11)")
    least = {"all": 0.1, "few": 0.2}
    factors = factors.unionByName(factors.where("SecuCode = 8"))
    joined = again.withColumn("universe", F.lit("all")).unionByName(few.withColumn("universe", F.lit("few"))).withColumn("SecuCode", F.col("SecuCode").cast("string"))
    want = portfolio.notable_factors(factors.withColumn("SecuCode", F.col("SecuCode").cast("string")).join(joined, ["SecuCode", "TradingDay"]), 5, least)
    got = wide.folder_layers(factors, {"all": again, "few": few}, 5, least)
    listed = again.withColumn("universes", F.array(F.lit("all"))).unionByName(few.withColumn("universes", F.array(F.lit("few"))))
    for df in (got, wide.folder_layers(factors, listed, 5, least)):
        for a, b in zip(rows(df), rows(want), strict=True):
            assert (a[0], a[1], a[4]) == (b[0], b[1], b[4]) and a[2:4] == pytest.approx(b[2:4])


def test_odd_cells_are_written_and_read_back(spark, tmp_path):
    day = lambda d: date(2020, 1, d)
    long = [("x", "b", day(1), None), ("x", "b", day(2), 2.0), ("x", "b", day(2), math.inf), ("x", "b", day(2), None), ("x", "a", day(2), -1e300), ("x", "a", day(3), math.nan), ("x", "a", day(3), 1.0), ("x", "zz", day(4), 5e-324), ("one", "q", day(1), 0.0)]
    df = spark.createDataFrame(long, "file string, SecuCode string, TradingDay date, factor double")
    wide.write_wide(df, str(tmp_path / "wide"), compression="gzip")
    assert list((tmp_path / "wide" / "file=x").glob("*.txt.gz"))
    got = rows(wide.read_wide(spark, str(tmp_path / "wide")))
    assert math.isnan(got.pop(2)[3]) and got == [("one", "q", day(1), 0.0), ("x", "a", day(2), -1e300), ("x", "b", day(2), math.inf), ("x", "zz", day(4), 5e-324)]


def test_quoted_and_spaced_numbers(spark, tmp_path):
    (tmp_path / "f.csv").write_text('d,a,b,c,e,f\n2020-01-02,"1.5", 2 ,"", -Infinity,+inf\n')
    assert [r[3] for r in rows(wide.read_wide(spark, str(tmp_path)))] == [1.5, 2.0, -math.inf, math.inf]


def test_stored_tables_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def files():
        every = disk.getAllFiles()
        return {str(f) for f in map(every.apply, range(every.size())) if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}

    before = files()
    with Store(spark) as store:
        store.saved(spark.range(1000).repartition("id"), "kept")
        wide.write_wide(long_rows(spark), store.folder("wide"))
        until = time.time() + 10  # they are dropped in the background
        while files() - before and time.time() < until:
            time.sleep(0.1)
        assert files() <= before
