"""Readers, writers and the physical layout of tables."""

from __future__ import annotations

import functools
import operator
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from geolith.operators.clean import COLUMN_MAP
from geolith.sources import keys as key_index
from geolith.sources.shared import shared_dir  # noqa: F401


def split_session(spark: SparkSession, split_bytes: int | None) -> SparkSession:
    """A session like this one whose read tasks have at most so many bytes; the given session stays as it is."""
    if not split_bytes:
        return spark
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    return own


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, split_bytes: int | None = None) -> DataFrame:
    """Text columns of CSV files by the names of their header, in any number of splits. A file whose header differs from the first file's is an error when it is read (``blocks`` reads such files).

    Rows with more fields than the header (empty ones count) are left out, rows with fewer have nulls, empty fields are null, columns that the
    files lack are null. ``columns`` are those to return, the raw names of the clean table unless told.
    """
    spark = split_session(spark, split_bytes)
    header, odd = spark.read.csv(path, header=True).columns, "_odd"
    schema = StructType([StructField(c, StringType()) for c in [*header, odd]])
    raw = spark.read.schema(schema).option("columnPruning", False).csv(path, header=True, mode="PERMISSIVE", enforceSchema=False, escape='"', columnNameOfCorruptRecord=odd)
    # a row that has not as many fields as the header comes as text too; what stands in quotes has no separators
    bare = F.regexp_replace(odd, r'"(?:[^"]|"")*"', "")
    read = F.length(F.coalesce(F.col(f"`{header[0]}`"), F.lit(""))) >= 0  # always so; Spark refuses to read the odd rows' text alone
    raw = raw.where(read & (F.col(odd).isNull() | (F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) < len(header))))
    wanted = list(COLUMN_MAP) if columns is None else columns
    return raw.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) if c in header else F.lit(None).cast("string").alias(c) for c in wanted])


def gathered(df: DataFrame) -> DataFrame:
    """The rows of many small splits in partitions of usual size, so that what is stored from them is not a file for each split."""
    return df.hint("rebalance")


def file_position() -> Column:
    """Orders rows as their files do: file, split, row."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, split_bytes: int | None = None, form: str = "parquet") -> DataFrame:
    """A table with a given, narrower or inferred schema; ``split_bytes`` bounds what a task reads of this table."""
    reader = split_session(spark, split_bytes).read.format(form)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def overwrite(df: DataFrame, path: str, *partition_by: str) -> int:
    """Writes a table in place of what is there, and returns its row count from the same pass."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return seen.get["rows"]


def new_rows(incoming: DataFrame, existing: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``incoming`` whose key is not in ``existing``, one for each key. A null is a value of a key like others."""
    one_each, stored = incoming.dropDuplicates(list(keys)), existing.select(*[F.col(k).alias(f"_stored_{k}") for k in keys])
    same = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_stored_{k}")) for k in keys])
    return one_each.join(stored, same, "left_anti")


def _observed(seen: Observation) -> int:
    """The observed count; Spark drops an observation together with a relation that it finds empty, and then has no row to show."""
    try:
        return seen.get["n"]
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() != "AssertionError":
            raise
        return 0


#: Bytes of a table from which on an append keeps an index of its keys.
INDEX_FROM = 64 << 20
#: An append of more than this share of the table's rows reads all stored keys once: to index and to ask would shuffle more than that.
INDEX_SHARE = 0.1


def append_new(incoming: DataFrame, path: str, *keys: str, bucket_keys: int = key_index.BUCKET_KEYS, index_from: int = INDEX_FROM) -> dict[str, int]:
    """Appends what is new by key, so that a second run appends nothing: ``rows_in, appended, skipped``.

    Of a table of at least ``index_from`` bytes, only those stored keys are read that its index (see ``keys``) cannot rule out, and
    ``incoming`` is read three times: to be counted, for its keys, and to be stored. Of a smaller table all keys are read, and also for an
    append of more than INDEX_SHARE of the table's rows; what such an append stores is indexed by the next one that is small.
    """
    spark = incoming.sparkSession
    read, put = Observation(), Observation()
    size = sum(key_index.data_files(spark, path).values())
    if size >= max(1, index_from) and incoming.count() <= INDEX_SHARE * spark.read.parquet(path).count():
        existing = key_index.KeyIndex(spark, path, keys, bucket_keys).existing(incoming)
    else:
        existing = spark.read.parquet(path).select(*keys) if size else None
    seen = incoming.observe(read, F.count(F.lit(1)).alias("n"))
    fresh = seen.dropDuplicates(list(keys)) if existing is None else new_rows(seen, existing, *keys)
    fresh.observe(put, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    n, k = _observed(read), _observed(put)
    return {"rows_in": n, "appended": k, "skipped": n - k}


def replace(df: DataFrame, path: str) -> int:
    """Writes a table beside the one at ``path`` and then puts it in its place, so that a failure loses neither; returns its row count.

    Where renaming a folder is one step of the file system, readers see the old table or the new one.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    new, old = (f"{path}-{what}-{uuid.uuid4().hex}" for what in ("new", "old"))
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(new)
    if key_index.exists(spark, path):
        key_index.rename(spark, path, old)
        try:
            key_index.rename(spark, new, path)
        except Exception:
            key_index.rename(spark, old, path)
            raise
        key_index.delete(spark, old)
    else:
        key_index.rename(spark, new, path)
    return _observed(seen)


def month_buckets(df: DataFrame, min_rows: int = 1) -> DataFrame:
    """The (year, month) buckets of a table, largest first; rows without a date are a bucket of their own."""
    out = df.groupBy(F.year("start_time").alias("year"), F.month("start_time").alias("month")).agg(F.count("*").alias("count")).where(F.col("count") >= min_rows)
    label = F.when(F.col("year").isNotNull(), F.format_string("%d-%02d", "year", "month")).otherwise(F.lit("sin_fecha"))
    return out.withColumn("label", label).orderBy(F.desc("count"), "label")


def inventory(tables: dict[str, DataFrame], main: str) -> DataFrame:
    """``name, rows, ready``: the main table is ready when it has rows."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows", (F.lit(name != main) | (F.col("rows") > 0)).alias("ready"))
        out = one if out is None else out.unionByName(one)
    return out


#: A geometry body of any accepted form.
GEOMETRY = "struct<type: string, coordinates: string, geometry: struct<type: string, coordinates: string>, bbox: array<double>>"


def polygons_of(body: Column) -> Column:
    """JSON text (Polygon, MultiPolygon, Feature, ``geometry`` or ``bbox``) as the coordinates of a multipolygon; null if it is none of them."""
    g = F.from_json(body, GEOMETRY)

    def parsed(kind: Column, text: Column) -> Column:
        one = F.from_json(text, "array<array<array<double>>>")
        many = F.from_json(text, "array<array<array<array<double>>>>")
        return F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)

    b = g["bbox"]
    ring = F.array(*[F.array(b[i], b[j]) for i, j in ((0, 1), (2, 1), (2, 3), (0, 3), (0, 1))])
    box = F.when((F.size(b) == 4) & (b[0] < b[2]) & (b[1] < b[3]), F.array(F.array(ring)))
    return F.coalesce(parsed(g["type"], g["coordinates"]), parsed(g["geometry"]["type"], g["geometry"]["coordinates"]), box)
