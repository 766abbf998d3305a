from datetime import date, datetime

import pyarrow as pa
import pyarrow.feather
import pytest

from factorweave.sources.feather import Part, FeatherReader, read_feather, write_feather


def big(n=1000):
    return pa.table({"SecuCode": [f"s{i % 7}" for i in range(n)], "TradingDay": [date(2020, 1, 1 + i % 20) for i in range(n)], "close": [None if i % 11 == 0 else i / 3 for i in range(n)], "n": pa.array(range(n), pa.int32()), "list": [[i, i + 1] for i in range(n)]})


def rows(df):
    return sorted(map(repr, df.collect()))


def test_a_partition_for_each_record_batch(spark, tmp_path):
    table, path = big(), str(tmp_path / "p.feather")
    pyarrow.feather.write_feather(table, path, chunksize=64)
    df = read_feather(spark, path)
    assert df.rdd.getNumPartitions() == 16 and df.columns == table.column_names
    assert rows(df) == sorted(repr(r) for r in spark.createDataFrame(table).collect())


def test_only_the_columns_asked_for_are_read(spark, tmp_path):
    path = str(tmp_path / "p.feather")
    pyarrow.feather.write_feather(big(), path, chunksize=200)
    df = read_feather(spark, path, ["n", "close"])
    assert df.columns == ["n", "close"] and df.count() == 1000 and df.agg({"n": "sum"}).first()[0] == 499500
    own = list(FeatherReader(path, pa.schema([("n", pa.int32())])).read(Part(path, 4)))
    assert [b.schema.names for b in own] == [["n"]] and own[0].column(0)[0].as_py() == 800
    with pytest.raises(Exception, match="no column x"):
        read_feather(spark, path, ["x"])


def test_folders_old_files_and_missing_columns(spark, tmp_path):
    pyarrow.feather.write_feather(pa.table({"a": [1, 2], "b": ["x", "y"]}), str(tmp_path / "0.feather"))
    pyarrow.feather.write_feather(pa.table({"a": [3]}), str(tmp_path / "1.feather"))
    pyarrow.feather.write_feather(pa.table({"a": [4], "b": ["z"]}), str(tmp_path / "2.feather"), version=1)
    (tmp_path / "_SUCCESS").write_text("")
    assert sorted(map(tuple, read_feather(spark, str(tmp_path)).collect())) == [(1, "x"), (2, "y"), (3, None), (4, "z")]
    with pytest.raises(Exception, match="missing"):
        read_feather(spark, str(tmp_path / "missing"))


def test_types_and_dictionaries(spark, tmp_path):
    table = pa.table({"d": pa.array(["a", "b", None]).dictionary_encode(), "t": pa.array([datetime(2020, 1, 2, 3), None, None], pa.timestamp("us")), "f": pa.array([1.5, None, 2.5], pa.float32()), "empty": pa.nulls(3, pa.string())})
    pyarrow.feather.write_feather(table, str(tmp_path / "t.feather"))
    df = read_feather(spark, str(tmp_path / "t.feather"))
    assert [t for _, t in df.dtypes] == ["string", "timestamp_ntz", "float", "string"]
    assert sorted(df.collect(), key=repr) == sorted([("a", datetime(2020, 1, 2, 3), 1.5, None), ("b", None, None, None), (None, None, 2.5, None)], key=repr)


def test_written_and_read_back(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame(big(300)).repartition(3)
    for _ in range(2):  # the second time over the first
        write_feather(df, path)
        assert rows(read_feather(spark, path)) == rows(df)
    write_feather(df.limit(5), path, "append")
    assert read_feather(spark, path).count() == 305
    assert not [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith(".")]
    write_feather(df.limit(0), path)
    assert read_feather(spark, path).count() == 0
