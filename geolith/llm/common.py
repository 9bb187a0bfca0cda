"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors share.

    A session in one process (local[...], as in tests) without that setting gets a temporary folder of its own; a
    cluster's executors would not see that, so there it is an error.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if base is None:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="geolith-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame written as a table in the shared folder and read again: its lineage ends there.

    While it is written, Spark sends at most PIECE_ROWS rows to Python at once; the session is left as it was.
    """
    spark = df.sparkSession
    path, key = shared_dir(spark, label), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        if not 0 < int(before) <= PIECE_ROWS:
            spark.conf.set(key, str(PIECE_ROWS))
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of text that an operator turns into Python objects at a time (a longer text alone).
PIECE_ROWS, PIECE_BYTES = 1000, 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], at: int | None = 1) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in small batches, by the texts of column ``at``, or by their mean size.

    Spark itself bounds what it sends at once, by spark.sql.execution.arrow.maxBytesPerBatch.
    """
    for batch in batches:
        if at is None:
            rows = max(1, min(PIECE_ROWS, len(batch) * PIECE_BYTES // max(1, batch.nbytes)))
            yield from (batch.slice(begin, rows) for begin in range(0, len(batch), rows))
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(batch):
            before = int(sizes[begin - 1]) if begin else 0
            end = min(begin + PIECE_ROWS, max(begin + 1, int(np.searchsorted(sizes, before + PIECE_BYTES, side="right"))))
            yield batch.slice(begin, end - begin)
            begin = end
    give_memory_back()


def give_memory_back() -> None:
    """Returns what a Python worker has freed to the system at the end of a task: the worker lives on for others.

    Arrow's pool and, where the C library has ``malloc_trim``, its heap.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns, ``id`` long and ``text`` string (null: empty), whatever else the table holds."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until the table has no such column in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Remembered(dict):
    """Values of a pure function by argument. Two generations of ``entries`` at most are kept: what is in use survives."""

    def __init__(self, compute: Callable, entries: int):
        super().__init__()
        self.compute, self.entries, self.older = compute, entries, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.older = {}
