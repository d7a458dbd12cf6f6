"""Feature matrices as NumPy files: a Python data source whose tasks write and read the shards.

A shard is `part-<n>.npy`, the matrix rows, and `part-<n>.parquet`, the other columns of the same rows in the same order. Tasks
write shards of at most SHARD_ROWS rows under names of their own attempt; the driver's commit renames those of the attempts that
count and writes `manifest.json`, a line a shard. Any file system that Arrow opens will do, so executors share the folder, and
nothing but names passes through the driver."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SHARD_ROWS = 100_000


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Shards(WriterCommitMessage):
    made: list[tuple[str, int, int]]  # staged name, rows, columns


class MatrixWriter(DataSourceArrowWriter):
    def __init__(self, path: str, column: str, rows: int, overwrite: bool):
        self.path, self.column, self.rows, self.overwrite = path, column, rows, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shards:
        files, top = _open(self.path)
        files.create_dir(f"{top}/_staged", recursive=True)
        made: list[tuple[str, int, int]] = []
        held: list[pa.RecordBatch] = []

        def shard() -> None:
            table, name = pa.Table.from_batches(held), uuid.uuid4().hex
            flat = table.column(self.column).combine_chunks()
            if flat.null_count:
                raise ValueError(f"{self.column} holds nulls")
            sizes = np.diff(flat.offsets.to_numpy())
            if len(sizes) and sizes.min() != sizes.max():
                raise ValueError(f"{self.column} holds vectors of several widths")
            matrix = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)
            out = io.BytesIO()
            np.save(out, matrix)
            with files.open_output_stream(f"{top}/_staged/{name}.npy") as f:
                f.write(out.getbuffer())
            with files.open_output_stream(f"{top}/_staged/{name}.parquet") as f:
                pq.write_table(table.drop_columns([self.column]), f)
            made.append((name, table.num_rows, matrix.shape[1]))
            held.clear()

        for batch in iterator:
            for at in range(0, batch.num_rows, self.rows):
                part = batch.slice(at, self.rows)
                if held and sum(b.num_rows for b in held) + part.num_rows > self.rows:
                    shard()
                held.append(part)
        if held:
            shard()
        return Shards(made)

    def commit(self, messages: list[Shards | None]) -> None:
        files, top = _open(self.path)
        made = [x for m in messages if m for x in m.made]
        widths = {w for _, _, w in made}
        if len(widths) > 1:
            self.abort(messages)
            raise ValueError(f"{self.column} holds vectors of several widths")
        old = [f for f in files.get_file_info(fs.FileSelector(top)) if f.base_name.startswith("part-") or f.base_name == "manifest.json"]
        if old and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.path)
        for f in old:
            files.delete_file(f.path)
        lines = []
        for k, (name, rows, width) in enumerate(made):
            for kind in ("npy", "parquet"):
                files.move(f"{top}/_staged/{name}.{kind}", f"{top}/part-{k:05d}.{kind}")
            lines.append(json.dumps({"part": f"part-{k:05d}", "rows": rows, "columns": width}))
        files.delete_dir(f"{top}/_staged")  # what attempts that don't count have left goes too
        with files.open_output_stream(f"{top}/manifest.json") as f:
            f.write("\n".join(lines).encode())

    def abort(self, messages: list[Shards | None]) -> None:
        files, top = _open(self.path)
        for name in (x[0] for m in messages if m for x in m.made):
            for kind in ("npy", "parquet"):
                try:
                    files.delete_file(f"{top}/_staged/{name}.{kind}")
                except FileNotFoundError:
                    pass


@dataclass
class Part(InputPartition):
    name: str


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, column: str, schema: StructType):
        self.path, self.column, self.names = path, column, schema.fieldNames()

    def partitions(self) -> list[Part]:
        files, top = _open(self.path)
        with files.open_input_file(f"{top}/manifest.json") as f:
            return [Part(json.loads(line)["part"]) for line in f.read().decode().splitlines()]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a matrix without shards
            return
        files, top = _open(self.path)
        with files.open_input_file(f"{top}/{partition.name}.npy") as f:
            matrix = np.load(io.BytesIO(f.read()))
        with files.open_input_file(f"{top}/{partition.name}.parquet") as f:
            table = pq.read_table(f)
        ends = pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32())
        table = table.append_column(self.column, pa.ListArray.from_arrays(ends, pa.array(matrix.ravel())))
        yield from table.select(self.names).to_batches()


class Matrices(DataSource):
    """format("matrix"): options path and column (`x`, an array of doubles), rows (of a shard)."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def _column(self) -> str:
        return self.options.get("column", "x")

    def reader(self, schema: StructType) -> MatrixReader:
        return MatrixReader(self.options["path"], self._column(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> MatrixWriter:
        if schema[self._column()].dataType.simpleString() != "array<double>":
            raise ValueError(f"{self._column()} must be an array of doubles")
        return MatrixWriter(self.options["path"], self._column(), int(self.options.get("rows", SHARD_ROWS)), overwrite)


def write_matrix(df: DataFrame, path: str, column: str = "x", rows: int = SHARD_ROWS) -> None:
    """df's column of vectors as NumPy shards in the folder path, its other columns beside them."""
    df.sparkSession.dataSource.register(Matrices)
    df.write.format("matrix").mode("overwrite").option("path", path).option("column", column).option("rows", rows).save()


def read_matrix(spark: SparkSession, path: str, schema: StructType | str, column: str = "x") -> DataFrame:
    """What write_matrix wrote, a partition a shard."""
    spark.dataSource.register(Matrices)
    return spark.read.format("matrix").schema(schema).option("path", path).option("column", column).load()
