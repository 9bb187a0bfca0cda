"""An index of a table's keys, so that an append by key reads few of them.

Below the table, in the hidden folder ``_keys``, lie *segments*. A segment covers some data files of the table: it lists them, holds
their keys dealt to buckets by hash, and a Bloom filter per bucket. Rows that come in are tested against the
filters; only buckets that may hold one of their keys are read.

The data files are the truth. A segment is whole once its list of files, written last, is there. Data files that no segment lists are
indexed when the next append begins, also those of a table that never had an index or of an append that failed
half-way; a segment of which a file has gone is left aside, and its other files are indexed anew. When there are more than
``MAX_SEGMENTS``, the smaller ones become one, so a key is indexed again a logarithmic number of times, not at each append.

One writer at a time: two appends at once can both find a key new, with or without an index.

A bucket has about ``BUCKET_KEYS`` keys whatever the size of the table: larger segments have more buckets. Small buckets share
files, sorted by bucket: a segment has a file for about ``BUCKET_KEYS`` keys, but ``PARTS`` at least if it has so many buckets. Filters take
``BITS`` bits a key, for about one false answer in 20,000.
"""

from __future__ import annotations

import functools
import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "_keys"
BUCKET_KEYS, BITS, HASHES = 200_000, 21, 10
MAX_SEGMENTS, PARTS = 8, 64
#: Buckets up to which only their keys are taken from the files that hold them.
MAX_NAMED = 1000

FILTER_SCHEMA = "_bucket long, _words array<long>"
FILES_SCHEMA = "file string, buckets long, words long, n long, per_part long"


def _hash(keys: tuple[str, ...], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])


def _hashed(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Adds two hashes, of 31 and 61 bits, that decide a key's bucket and its places in the filter; no sum of them overflows."""
    return df.withColumns({"_h": _hash(keys, 0).bitwiseAND(F.lit((1 << 31) - 1)), "_g": _hash(keys, 1).bitwiseAND(F.lit((1 << 61) - 1))})


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, a = _fs(spark, old)
    if not fs.rename(a, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"{old} could not be renamed to {new}")


def data_files(spark: SparkSession, path: str) -> dict[str, int]:
    """The Parquet files of a table and their bytes; none if there is no table."""
    if not exists(spark, path):
        return {}
    fs, where = _fs(spark, path)
    found, it = {}, fs.listFiles(where, True)
    root = fs.makeQualified(where).toString().rstrip("/") + "/"
    while it.hasNext():
        status = it.next()
        name = status.getPath().toString()
        if name.endswith(".parquet") and not any(part[0] in "_." for part in name.removeprefix(root).split("/")):
            found[name] = status.getLen()
    return found


def _filter_of(n_words: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one bucket's hashes: its filter."""
        words = np.zeros(n_words, np.uint64)
        g, h = (table[c].to_numpy().astype(np.uint64) for c in ("_g", "_h"))
        for i in range(HASHES):
            place = (g + np.uint64(i) * h) % np.uint64(64 * n_words)
            np.bitwise_or.at(words, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        return pa.table({"_bucket": table["_bucket"].slice(0, 1), "_words": pa.array([words.view(np.int64)], pa.list_(pa.int64()))})

    return run


def _may_hold(words: Column, n_words: int) -> Column:
    def bit(i: int) -> Column:
        place = (F.col("_g") + F.lit(i) * F.col("_h")) % F.lit(64 * n_words)
        word = F.get(words, F.shiftright(place, 6).cast("int"))
        return F.call_function("shiftrightunsigned", word, (place % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

    out = bit(0)
    for i in range(1, HASHES):
        out = out & bit(i)
    return out


@dataclass(frozen=True)
class Segment:
    folder: str
    buckets: int
    words: int  # of a filter
    n: int
    per_part: int  # buckets that share a file
    files: frozenset[str]


class KeyIndex:
    """The index of the table at ``path`` by ``keys``."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], bucket_keys: int = BUCKET_KEYS):
        self.spark, self.path, self.keys, self.bucket_keys = spark, path.rstrip("/"), keys, bucket_keys
        self.folder = f"{self.path}/{FOLDER}/by_{'_'.join(keys)}"
        #: Bytes of key files that the last ``existing`` read, and of all there are.
        self.bytes_read = self.bytes_all = 0

    def _segments(self) -> list[Segment]:
        if not exists(self.spark, self.folder):
            return []
        fs, where = _fs(self.spark, self.folder)
        out = []
        for status in fs.listStatus(where):
            name = status.getPath().toString()
            if exists(self.spark, f"{name}/files/_SUCCESS"):
                rows = self.spark.read.schema(FILES_SCHEMA).parquet(f"{name}/files").collect()  # a row for each data file
                files = frozenset(r.file for r in rows) if rows[0].per_part else frozenset({""})  # one of an older layout counts as if a file had gone
                out.append(Segment(name, rows[0].buckets, rows[0].words, rows[0].n, rows[0].per_part, files))
        return out

    def refresh(self) -> list[Segment]:
        """Indexes the data files that no segment lists. Returns the segments that are good."""
        there = {*data_files(self.spark, self.path)}
        found = sorted(self._segments(), key=lambda x: -x.n)
        good = [x for x in found if x.files <= there]
        left = there - {f for x in good for f in x.files}
        if left and len(good) >= MAX_SEGMENTS:
            # those stay that have more keys than all smaller ones together
            good = [x for i, x in enumerate(good) if x.n > sum(y.n for y in good[i + 1 :])][: MAX_SEGMENTS // 2]
            left = there - {f for x in good for f in x.files}
        if left:
            good.append(self._add(left))
        for x in found:
            if x not in good:
                delete(self.spark, x.folder)
        return good

    def _add(self, files: set[str]) -> Segment:
        name = f"{self.folder}/{uuid.uuid4().hex}"
        rows = self.spark.read.option("basePath", self.path).parquet(*sorted(files)).select(*self.keys)
        n = rows.count()
        buckets = 1 << max(0, math.ceil(math.log2(max(1, n) / self.bucket_keys)))
        words = max(1, math.ceil(n / buckets * 1.1 * BITS / 64))
        per_part = max(1, min(BUCKET_KEYS // self.bucket_keys, buckets // PARTS))
        dealt = _hashed(rows, self.keys).withColumn("_bucket", F.pmod(F.col("_h"), F.lit(buckets))).withColumn("_part", F.expr(f"_bucket div {per_part}"))
        dealt.repartition("_part").sortWithinPartitions("_part", "_bucket").write.partitionBy("_part").parquet(f"{name}/keys")
        kept = self.spark.read.schema("_g long, _h long, _bucket long").parquet(f"{name}/keys")
        filters = kept.select("_bucket", "_g", "_h").groupBy("_bucket").applyInArrow(_filter_of(words), FILTER_SCHEMA)
        filters.write.parquet(f"{name}/filters")
        listed = self.spark.createDataFrame([(f, buckets, words, n, per_part) for f in sorted(files)], FILES_SCHEMA)
        listed.coalesce(1).write.parquet(f"{name}/files")
        return Segment(name, buckets, words, n, per_part, frozenset(files))

    def existing(self, incoming: DataFrame) -> DataFrame | None:
        """The stored keys among which all of ``incoming`` that are stored can be found; None where no bucket can hold any."""
        found, self.bytes_read, self.bytes_all = [], 0, 0
        come = _hashed(incoming.select(*self.keys), self.keys).select("_h", "_g").distinct()
        for x in self.refresh():
            filters = self.spark.read.schema(FILTER_SCHEMA).parquet(f"{x.folder}/filters")
            asked = come.withColumn("_bucket", F.pmod(F.col("_h"), F.lit(x.buckets))).join(filters, "_bucket").where(_may_hold(F.col("_words"), x.words))
            named = [r[0] for r in asked.select("_bucket").distinct().collect()]  # a row for each bucket, not each key
            wanted = sorted({f"{x.folder}/keys/_part={b // x.per_part}" for b in named})
            self.bytes_all += _bytes(self.spark, f"{x.folder}/keys")
            self.bytes_read += sum(_bytes(self.spark, p) for p in wanted)
            if wanted:
                held = self.spark.read.parquet(*wanted)
                found.append((held.where(F.col("_bucket").isin(named)) if len(named) <= MAX_NAMED else held).select(*self.keys))
        return functools.reduce(DataFrame.unionByName, found) if found else None


def _bytes(spark: SparkSession, path: str) -> int:
    fs, where = _fs(spark, path)
    return fs.getContentSummary(where).getLength()
