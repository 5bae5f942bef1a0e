"""Files of packed rows as a data source of Spark.

Reading cuts a file into ranges of rows.  Writing takes pieces (offset, raw) in
any order: every task puts its pieces at their places of one file, which gets its
name only when all tasks have committed.  A piece always has the same bytes and
the same place, so that repeated tasks do no harm.  The folder has to be mounted
wherever tasks run; no content passes the driver.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a partition, and of a row that it yields, when reading.
PART, CHUNK = 64 << 20, 1 << 20

PIECES = "offset long, raw binary"


class PackedError(RuntimeError):
    """A file does not hold what it should."""


@dataclass
class Rows(InputPartition):
    first: int
    count: int


@dataclass
class Written(WriterCommitMessage):
    size: int


def _exactly(file, size: int) -> bytes:
    raw = file.read(size)
    if len(raw) != size:
        raise PackedError(f"{file.name} ends after {file.tell()} bytes")
    return raw


class RowReader(DataSourceReader):
    """(first, raw): some rows of fixed width, beginning with row ``first``."""

    def __init__(self, options: dict):
        self.path, self.width, self.rows, self.head = options["path"], int(options["width"]), int(options["rows"]), int(options.get("head", 0))

    def partitions(self) -> list[InputPartition]:
        step = max(1, PART // self.width)
        return [Rows(first, min(step, self.rows - first)) for first in range(0, self.rows, step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        step, stop = max(1, CHUNK // self.width), partition.first + partition.count
        with open(self.path, "rb") as file:
            file.seek(self.head + partition.first * self.width)
            for first in range(partition.first, stop, step):
                yield first, _exactly(file, min(step, stop - first) * self.width)


class RecordReader(DataSourceReader):
    """(first, raw): row number and bytes of each record of a file whose ends a second one (``offsets``, four or eight bytes each) tells."""

    def __init__(self, options: dict):
        self.path, self.offsets, self.rows, self.wide = options["path"], options["offsets"], int(options["rows"]), int(options.get("wide", 4))

    def partitions(self) -> list[InputPartition]:
        size = os.path.getsize(self.path)
        step = max(1, self.rows * PART // max(size, 1))
        return [Rows(first, min(step, self.rows - first)) for first in range(0, self.rows, step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        if not partition.count:
            return
        with open(self.offsets, "rb") as ends, open(self.path, "rb") as file:
            ends.seek(partition.first * self.wide)
            at = np.frombuffer(_exactly(ends, (partition.count + 1) * self.wide), f"<u{self.wide}").astype(np.int64)
            file.seek(at[0])
            for k, size in enumerate(np.diff(at).tolist()):
                yield partition.first + k, _exactly(file, size)


class PieceWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.part, self.size, self.head = options["path"], options["part"], int(options["size"]), int(options["head"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        size, file = 0, os.open(self.part, os.O_WRONLY)
        try:
            for batch in iterator:
                for offset, raw in zip(batch.column("offset").to_pylist(), batch.column("raw"), strict=True):
                    view = memoryview(raw.as_buffer())
                    if not 0 <= offset <= self.size - len(view):
                        raise PackedError(f"a piece at {offset} is not inside of {self.path}")
                    size += len(view)
                    while len(view):
                        done = os.pwrite(file, view, offset)
                        offset, view = offset + done, view[done:]
            os.fsync(file)
        finally:
            os.close(file)
        return Written(size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        size = sum(m.size for m in messages if m)
        if size != self.size - self.head:
            self.abort(messages)
            raise PackedError(f"{self.path} got {size} bytes instead of {self.size - self.head}")
        os.replace(self.part, self.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        Path(self.part).unlink(missing_ok=True)


class Packed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed"

    def schema(self) -> str:
        return "first long, raw binary"

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(self.options) if "offsets" in self.options else RowReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return PieceWriter(self.options)


def _named(spark: SparkSession) -> str:
    spark.dataSource.register(Packed)
    return Packed.name()


def read_rows(spark: SparkSession, path: str, width: int, rows: int, head: int = 0) -> DataFrame:
    """(first, raw): up to CHUNK bytes of rows of ``width`` bytes each, from row ``first`` on."""
    return spark.read.format(_named(spark)).options(path=path, width=width, rows=rows, head=head).load()


def read_records(spark: SparkSession, path: str, offsets: str, rows: int, wide: int = 4) -> DataFrame:
    """(first, raw): the number and the bytes of each record."""
    return spark.read.format(_named(spark)).options(path=path, offsets=offsets, rows=rows, wide=wide).load()


def write_pieces(pieces: DataFrame, path: str, size: int, head: bytes = b"") -> None:
    """Writes a file of ``size`` bytes from (offset, raw), which must not overlap and have to fill what ``head`` leaves."""
    part = f"{path}.part-{uuid.uuid4().hex}"
    with open(part, "wb") as file:
        file.truncate(size)
        file.write(head)
    pieces.write.format(_named(pieces.sparkSession)).options(path=path, part=part, size=size, head=len(head)).mode("append").save()
