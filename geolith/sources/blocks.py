"""CSV files by blocks of bytes, of which only those that are asked for are read.

A block is a stretch of a file; it holds the lines that begin in it. The files are listed with their sizes, and blocks put
in a seeded order, so that any number of them from the beginning is spread over all files. A data source of its own reads the chosen
ones: a task opens the file at the block's first byte and stops behind its last line.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from geolith.operators.clean import COLUMN_MAP

BLOCK_BYTES = 16 << 20
#: Bytes that are read at a time.
READ_BYTES = 1 << 20
LINE_SCHEMA = "_file string, _offset long, _line string"


@dataclass(frozen=True)
class Block(InputPartition):
    file: str
    start: int
    length: int


def _opened(path: str):
    """A file of any kind that Arrow knows (local, hdfs, s3, gs), to be read anywhere."""
    path = "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
    fs, inside = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(inside)


def lines(file: str, start: int, length: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in a block, without the header and empty lines."""
    with _opened(file) as f:
        size = f.size()
        at, held = start, b""
        if start:
            at -= 1  # the line that the byte before the block belongs to is not the block's
        end, skip = min(size, start + length), True
        begin = at
        while True:
            data = f.read_at(READ_BYTES, begin + len(held)) if begin + len(held) < size else b""
            held += data
            while (cut := held.find(b"\n")) >= 0 or (not data and held):
                line = held[:cut] if cut >= 0 else held
                if not skip and line.strip():
                    if begin >= end:
                        return
                    yield begin, line.rstrip(b"\r")
                skip = False
                begin += len(line) + (cut >= 0)
                held = held[cut + 1 :] if cut >= 0 else b""
                if begin >= end:
                    return
            if not data:
                return


class _Reader(DataSourceReader):
    def __init__(self, chosen: Sequence[Block]):
        self.chosen = chosen

    def partitions(self) -> Sequence[InputPartition]:
        return self.chosen

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, bytes]] = []

        def batch() -> pa.RecordBatch:
            offsets, texts = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([partition.file] * len(rows)), pa.array(offsets, pa.int64()), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=["_file", "_offset", "_line"])

        for row in lines(partition.file, partition.start, partition.length):
            rows.append(row)
            if len(rows) == 4096:
                yield batch()
                rows.clear()
        if rows:
            yield batch()


class _LineSource(DataSource):
    """Lines of the blocks that the options list: file, start and length of each by number."""

    @classmethod
    def name(cls) -> str:
        return "csv_blocks"

    def schema(self) -> str:
        return LINE_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        n = int(self.options["blocks"])
        return _Reader([Block(self.options[f"file{i}"], int(self.options[f"start{i}"]), int(self.options[f"length{i}"])) for i in range(n)])


def position() -> Column:
    """Orders rows as the files do."""
    return F.struct("_file", "_offset")


class CsvBlocks:
    """The blocks of all CSV files below a path; the files share a header, which is checked when a file is first read."""

    def __init__(self, spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES, seed: int | None = 42, columns: list[str] | None = None):
        """``seed`` None: in the order of the files."""
        self.spark, self.block_bytes, self.seed = spark, block_bytes, seed
        self.columns = list(COLUMN_MAP) if columns is None else columns
        spark.dataSource.register(_LineSource)
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path)
        self.files = sorted((r.path, r.length) for r in found.select("path", "length").collect())  # names and sizes, no content
        if not self.files:
            raise FileNotFoundError(f"no CSV files in {path}")
        self._headers: dict[str, list[str]] = {}

    def blocks(self) -> list[Block]:
        every = [Block(f, start, min(self.block_bytes, size - start)) for f, size in self.files for start in range(0, size, self.block_bytes)]
        if self.seed is None:
            return every
        root = os.path.commonprefix([f for f, _ in self.files]).rpartition("/")[0]  # a copy elsewhere has the same order
        return sorted(every, key=lambda b: (hashlib.md5(f"{b.file.removeprefix(root)}:{b.start}:{self.seed}".encode()).digest(), b.file, b.start))

    def waves(self, n: int) -> Iterator[list[Block]]:
        every = self.blocks()
        yield from (every[i : i + n] for i in range(0, len(every), n))

    def header(self, file: str) -> list[str]:
        if file not in self._headers:
            with _opened(file) as f:
                first = f.read(READ_BYTES).split(b"\n", 1)[0].rstrip(b"\r").decode("utf-8-sig")
            self._headers[file] = self.spark.range(1).select(F.from_csv(F.lit(first), ", ".join(f"c{i} string" for i in range(first.count(",") + 1))).alias("h")).first()["h"]
            self._headers[file] = [c for c in self._headers[file] if c is not None]
        return self._headers[file]

    def read(self, chosen: Sequence[Block]) -> DataFrame:
        """The rows of the chosen blocks as text columns by the names of each file's own header, with ``_file`` and ``_offset``."""
        options = {"blocks": str(len(chosen))}
        for i, b in enumerate(chosen):
            options |= {f"file{i}": b.file, f"start{i}": str(b.start), f"length{i}": str(b.length)}
        rows = self.spark.read.format("csv_blocks").options(**options).load()
        by_header: dict[tuple[str, ...], list[str]] = {}
        for f in sorted({b.file for b in chosen}):
            by_header.setdefault(tuple(self.header(f)), []).append(f)
        out = None
        for header, own in by_header.items():
            one = self._parsed(rows if len(by_header) == 1 else rows.where(F.col("_file").isin(own)), list(header))
            out = one if out is None else out.unionByName(one)
        return out

    def _parsed(self, rows: DataFrame, header: list[str]) -> DataFrame:
        ddl = ", ".join(f"`{c.replace('`', '``')}` string" for c in header)
        row = rows.select("_file", "_offset", "_line", F.from_csv("_line", ddl, {"escape": '"'}).alias("r"))
        # rows with more fields than the header go; what stands in quotes has no separators
        bare = F.regexp_replace("_line", r'"(?:[^"]|"")*"', "")
        row = row.where(F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) < len(header))

        def field(c: str) -> Column:
            return F.nullif(F.col("r").getField(c), F.lit("")) if c in header else F.lit(None).cast("string")

        return row.select("_file", "_offset", *[field(c).alias(c) for c in self.columns])
