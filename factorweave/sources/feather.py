"""Feather (Arrow IPC) files as a data source: `spark.read.format("feather")` and `df.write.format("feather")`.

The driver reads only the footers; each record batch is a partition of its own, and a task reads
no other columns than those asked for.  Old files (of version 1) are one partition each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.feather
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

_OLD = b"FEA1"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The files of a path, or of a folder, that are not hidden; by name."""
    fs, at = _filesystem(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [at]
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))


def _plain(schema: pa.Schema) -> pa.Schema:
    """The schema as Spark holds it: dictionaries as their values, Spark's own widths."""
    fields = [pa.field(f.name, f.type.value_type if pa.types.is_dictionary(f.type) else f.type) for f in schema]
    return to_arrow_schema(from_arrow_schema(pa.schema(fields), prefer_timestamp_ntz=True))


def _cast(batch: pa.RecordBatch | pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    table = pa.table(batch) if isinstance(batch, pa.RecordBatch) else batch
    columns = [table[f.name].cast(f.type) if f.name in table.column_names else pa.nulls(table.num_rows, f.type) for f in schema]
    yield from pa.Table.from_arrays(columns, schema=schema).to_batches()


@dataclass
class Part(InputPartition):
    """A record batch of a file; none: the whole of an old file."""

    file: str
    batch: int | None


class FeatherReader(DataSourceReader):
    def __init__(self, path: str, schema: pa.Schema):
        self.path, self.schema = path, schema

    def partitions(self) -> list[Part]:
        fs, _ = _filesystem(self.path)
        out = []
        for file in _files(self.path):
            with fs.open_input_file(file) as f:
                if f.read(4) == _OLD:
                    out.append(Part(file, None))
                    continue
                f.seek(0)
                out += [Part(file, i) for i in range(pa.ipc.open_file(f).num_record_batches)]
        return out

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is no record batch
            return
        fs, _ = _filesystem(self.path)
        with fs.open_input_file(partition.file) as f:
            if partition.batch is None:
                yield from _cast(pyarrow.feather.read_table(f, columns=self.schema.names), self.schema)
                return
            names = pa.ipc.open_file(f).schema.names
            f.seek(0)
            own = [i for i, n in enumerate(names) if n in self.schema.names]
            batch = pa.ipc.open_file(f, options=pa.ipc.IpcReadOptions(included_fields=own or [0])).get_batch(partition.batch)
            yield from _cast(batch, self.schema)


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    file: str


class FeatherWriter(DataSourceArrowWriter):
    """A file for each task, written under a hidden name and renamed when all tasks are done."""

    def __init__(self, path: str, overwrite: bool, schema: pa.Schema):
        self.path, self.overwrite, self.schema = path, overwrite, schema
        fs, at = _filesystem(path)
        self.before = _files(path) if overwrite and fs.get_file_info(at).type != pafs.FileType.NotFound else []
        fs.create_dir(at, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = _filesystem(self.path)
        name = f"part-{uuid.uuid4().hex}.feather"
        out = Written(f"{at}/.{name}", f"{at}/{name}")
        with fs.open_output_stream(out.temporary) as f, pa.ipc.new_file(f, self.schema) as writer:
            for batch in iterator:
                for b in _cast(batch, self.schema):
                    writer.write_batch(b)
        return out

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = _filesystem(self.path)
        for m in messages:
            if m:
                fs.move(m.temporary, m.file)
        for old in self.before:
            fs.delete_file(old)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = _filesystem(self.path)
        for m in messages:
            if m and fs.get_file_info(m.temporary).type == pafs.FileType.File:
                fs.delete_file(m.temporary)


class Feather(DataSource):
    """Options: path; columns, a comma-separated list of those to read (by default all)."""

    @classmethod
    def name(cls) -> str:
        return "feather"

    def schema(self):
        """That of the first file; columns that other files lack are null in them."""
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no file in {self.options['path']}")
        fs, _ = _filesystem(self.options["path"])
        with fs.open_input_file(files[0]) as f:
            old = f.read(4) == _OLD
            f.seek(0)
            schema = _plain(pyarrow.feather.read_table(f).schema if old else pa.ipc.open_file(f).schema)
        names = [c.strip() for c in self.options["columns"].split(",")] if self.options.get("columns") else schema.names
        if missing := [c for c in names if c not in schema.names]:
            raise ValueError(f"{self.options['path']} has no column {', '.join(missing)}")
        return from_arrow_schema(pa.schema([schema.field(c) for c in names]), prefer_timestamp_ntz=True)

    def reader(self, schema) -> FeatherReader:
        return FeatherReader(self.options["path"], to_arrow_schema(schema))

    def writer(self, schema, overwrite: bool) -> FeatherWriter:
        return FeatherWriter(self.options["path"], overwrite, to_arrow_schema(schema))


def read_feather(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Feather file, or all those of a folder; with `columns`, tasks read no others."""
    spark.dataSource.register(Feather)
    reader = spark.read.format("feather")
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(path)


def write_feather(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of Feather files, one for each partition."""
    df.sparkSession.dataSource.register(Feather)
    df.write.format("feather").mode(mode).save(path)
