"""Wide CSV files, a column for each security and a row for each day, of any width.

Lines are read as text.  The first line of a file names its securities: it becomes one row, an
array of names by position, and the cells of the other lines take their names from it.  So the
plan is the same for 5 or 5,000 securities, and each file may list its own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorweave.functions.stats import DAY, SECU, finite
from factorweave.operators.portfolio import notable_ends
from factorweave.sources.shared import shuffles_dropped


def _bare(cell: Column) -> Column:
    """A cell without the space or quotes around it."""
    return F.btrim(F.btrim(cell), F.lit('"'))


def _cells(line: str) -> Column:
    """The cells of a line, as they are; separators inside quotes aren't read."""
    return F.split(F.regexp_replace(line, "\r$", ""), ",", -1)


def _number(cell: Column) -> Column:
    """A cell's number; the cast itself leaves out white space and knows infinity and NaN."""
    return F.when(cell.contains('"'), _bare(cell)).when(cell != "", cell).try_cast("double")


def _first_cell(line: str) -> Column:
    """The first of _cells(line), bare, without a look at the others."""
    return _bare(F.regexp_replace(F.substring_index(line, ",", 1), "\r$", ""))


def _day(cell: Column) -> Column:
    """A day written as 2020-01-31 (with a time or without), 2020/1/31 or 20200131."""
    text = F.regexp_replace(F.regexp_extract(cell, r"^[0-9]{4}([-/]?)[0-9]{1,2}\1[0-9]{1,2}", 0), "/", "-")
    compact = F.regexp_replace(text, r"^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3")
    return compact.try_cast("date")


def read_wide(spark: SparkSession, path: str, value: str = "factor") -> DataFrame:
    """(file, SecuCode, TradingDay, value) from a wide CSV file, or all those of a folder.

    The first line of each file is its header; its first cell is ignored, and a name
    `code.suffix` counts as `code`.  Cells that are empty or no number, repeated headers, and
    lines without a day have no row; infinity and NaN are kept as they are.  A file is named without its
    extension, or by the folder `file=...` it lies in.  Lines shorter than the header have no cells
    for the rest, longer ones none beyond it.
    """
    lines = spark.read.option("recursiveFileLookup", "false").text(path)
    name = F.col("file") if "file" in lines.columns else F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1)
    lines = lines.select(name.cast("string").alias("file"), F.col("_metadata.file_path").alias("from"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    header = lines.where("block = 0").groupBy("from").agg(F.min(F.struct("at", "value")).alias("head"))
    codes = F.transform(_cells("head.value"), lambda c: F.split(_bare(c), r"\.")[0])
    header = lines.select("from", "block").distinct().join(header, "from")  # for each block of a file its header, so a block is a task's part
    header = header.select("from", "block", F.col("head.value").alias("head"), codes.alias("codes"))
    lines = lines.join(header.hint("shuffle_hash"), ["from", "block"]).where("value <> head").select("file", _day(_first_cell("value")).alias(DAY), "codes", _cells("value").alias("cells")).where(f"{DAY} is not null")
    # a line's day and cells are columns before the cells become rows: whatever is left to do for each row must not look at the line
    rows = lines.select("file", DAY, F.explode(F.slice(F.arrays_zip(F.col("codes").alias("code"), F.col("cells").alias("cell")), 2, 1 << 30)).alias("c"))
    return rows.select("file", F.col("c.code").alias(SECU), DAY, _number(F.col("c.cell")).alias(value)).where(F.col(SECU).isNotNull() & F.col(value).isNotNull())


def read_wide_returns(spark: SparkSession, path: str, value: str = "ret") -> DataFrame:
    """(SecuCode, TradingDay, value) of a wide file of returns: infinite ones are 0, NaN ones have no row."""
    x = F.col(value)
    return read_wide(spark, path, value).drop("file").where(~F.isnan(x)).withColumn(value, F.when(F.abs(x) == float("inf"), 0.0).otherwise(x))


def _part_lines(key, cells: pa.Table, head: pa.Table) -> pa.Table:
    """(file, part, day, value): the header and the lines of a part of a file, from its cells and the file's codes."""
    codes, schema = head["codes"].combine_chunks().flatten(), pa.schema([("file", pa.string()), ("part", pa.int32()), ("day", pa.string()), ("value", pa.string())])
    if not cells.num_rows:
        return schema.empty_table()
    days, line = np.unique(cells[DAY].to_numpy(), return_inverse=True)
    at, v, have = pc.index_in(cells["code"], value_set=codes).to_numpy(), cells["v"].to_numpy(), cells["v"].is_valid().to_numpy()
    order, stop = np.argsort(line, kind="stable"), np.cumsum(np.bincount(line))
    lines = [pa.array(["TradingDay," + ",".join(codes.to_pylist())])]
    for day, own in zip(days, np.split(order, stop[:-1]), strict=True):
        own = own[np.lexsort((v[own], have[own]))]  # of cells of one place the last one stands, which is the largest
        place = np.full(len(codes), -1)
        place[at[own]] = own
        row = pa.array(v[place], mask=(place < 0) | ~have[place]).cast(pa.string()).fill_null("")
        lines.append(pc.binary_join_element_wise(str(day), pc.binary_join(pa.ListArray.from_arrays([0, len(row)], row), ","), ","))  # a chunk a line: nothing is copied once more
    n = len(lines)
    return pa.Table.from_arrays([pa.repeat(key[0], n), pa.repeat(key[1], n), pa.array(["", *map(str, days)]), pa.chunked_array(lines)], schema=schema)


def write_wide(df: DataFrame, path: str, file_col: str = "file", value_col: str = "factor", part_cells: int = 4_000_000, compression: str | None = None) -> None:
    """Writes rows (file, SecuCode, TradingDay, value) as one wide CSV for each file, in folders `file=...`.

    A file of more than part_cells cells is dealt by day over parts of about so many, each with the
    header; a part is written by one task.  Of rows of one key the largest value stands; days
    of a part ascend, and securities are in order of their codes.  compression: a codec of Spark's
    text files, such as gzip, whose files are read by one task each.

    df is read twice, first for the securities of each file; its cells are dealt once, as numbers.
    """
    rows = df.select(F.col(f"`{file_col}`").cast("string").alias("file"), SECU, F.col(DAY).cast("date").alias(DAY), F.col(f"`{value_col}`").cast("double").alias("v")).where(f"file is not null and {SECU} is not null and {DAY} is not null")
    codes = rows.groupBy("file", SECU).agg(F.count("*").alias("n"))
    places = codes.groupBy("file").agg(F.array_sort(F.collect_set(F.col(SECU).cast("string"))).alias("codes"), F.ceil(F.sum("n") / part_cells).cast("int").alias("parts"))  # the securities of a file
    heads = places.select(F.col("file").alias("file"), "codes", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = rows.join(F.broadcast(places.select("file", "parts")), "file").withColumn("part", F.pmod(F.xxhash64(DAY), F.col("parts")).cast("int")).drop("parts").repartition("file", "part")
    cells = dealt.withColumn("code", F.col(SECU).cast("string")).select("file", "part", DAY, "code", "v")
    text = cells.groupBy("file", "part").cogroup(heads.groupBy("file", "part")).applyInArrow(_part_lines, "file string, part int, day string, value string")
    with shuffles_dropped(df.sparkSession):
        text.sortWithinPartitions("file", "part", "day").drop("part", "day").write.partitionBy("file").text(path, compression=compression)


def _day_layers(groups: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """A function of a day's factors and returns: the mean return, over the market's, of the first and last of each file's layers in each universe."""

    def ends(key, factors, returns):
        found: list[tuple] = []
        codes = pa.chunked_array([*factors[SECU].chunks, *returns[SECU].chunks], pa.string()).combine_chunks().dictionary_encode()
        rank = np.empty(len(codes.dictionary), np.int64)
        rank[pc.sort_indices(codes.dictionary).to_numpy()] = np.arange(len(rank))
        ids = rank[codes.indices.to_numpy()]
        lists = returns["universes"].combine_chunks()
        files, universes, row = factors["file"].combine_chunks().dictionary_encode(), lists.flatten().dictionary_encode(), pc.list_parent_indices(lists).to_numpy()
        secu, held = ids[: factors.num_rows], ids[factors.num_rows :]
        file, universe = files.indices.to_numpy(), universes.indices.to_numpy()
        order = np.lexsort((secu, factors["f"].to_numpy(), file))
        secu, file, ret = secu[order], file[order], returns["ret"].to_numpy()
        for u, name in enumerate(universes.dictionary.to_pylist()):
            own = row[universe == u]
            own = own[np.argsort(held[own], kind="stable")]
            n = np.bincount(held[own], minlength=len(rank))
            times = n[secu]  # an inner join: a factor's row for each return of its security
            at = np.repeat((np.cumsum(n) - n)[secu] - np.cumsum(times) + times, times) + np.arange(times.sum())
            got, sizes = ret[own][at], np.bincount(np.repeat(file, times), minlength=len(files.dictionary))
            for label, part in zip(files.dictionary.to_pylist(), np.split(got, np.cumsum(sizes)[:-1]), strict=True):
                whole, more = divmod(len(part), groups)
                layers = {groups: part[len(part) - whole :], 1: part[: whole + (more > 0)]}
                found += [(label, name, key[0].as_py(), k, float((x - part.mean()).mean())) for k, x in layers.items() if len(x)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [()] * 5, _DAY_LAYERS.types, strict=True)], schema=_DAY_LAYERS)

    return ends


_DAY_LAYERS = pa.schema([("file", pa.string()), ("universe", pa.string()), (DAY, pa.date32()), ("layer", pa.int32()), ("over", pa.float64())])


def folder_layers(factors: DataFrame, returns: DataFrame | dict[str, DataFrame], groups: int, threshold: dict[str, float]) -> DataFrame:
    """(file, universe, first, last, notable): layers of every factor file in every universe, in one plan.

    returns: (SecuCode, TradingDay, ret, universes), with the names of the universes a row is in, or for
    each universe (SecuCode, TradingDay, ret), whose days and securities are those looked at;
    threshold: what the first or last layer's running return has to exceed there.

    Factors and returns of a day meet in a task, the only place where they are put side by side.
    """
    if isinstance(returns, dict):
        returns = reduce(DataFrame.unionByName, [r.select(SECU, DAY, "ret", F.array(F.lit(u)).alias("universes")) for u, r in returns.items()])
    every = returns.select(F.col(SECU).cast("string").alias(SECU), DAY, F.col("ret").cast("double").alias("ret"), "universes").where(f"{SECU} is not null and {DAY} is not null and ret is not null")
    values = factors.select("file", F.col(SECU).cast("string").alias(SECU), DAY, finite(F.col("factor")).alias("f")).where(f"file is not null and {SECU} is not null and {DAY} is not null and f is not null")
    daily = values.groupBy(DAY).cogroup(every.groupBy(DAY)).applyInArrow(_day_layers(groups), f"file string, universe string, {DAY} date, layer int, over double")
    return notable_ends(daily, groups, threshold)


def notable_files(layers: DataFrame) -> DataFrame:
    """(file) of the factors that are notable in any universe."""
    return layers.groupBy("file").agg(F.max("notable").alias("any")).where("any").select("file")
