"""Whether two tables are equal, and where not: digests of buckets of keys, in two levels, then the keys of those that differ.

A bucket's digest is its number of rows and two sums over hashes of whole rows, so neither order nor partitions matter and a
row that stands twice counts twice. Equal tables are read once each and shuffle one row a task and bucket; of tables that differ,
only rows of buckets that differ on both levels are ever compared by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024
WHAT = ("only_a", "only_b", "changed", "repeated")


def one_each(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each key, the least by its other columns: the same one in whatever order the table is read (which ``dropDuplicates`` does not promise)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*") if rest else df.distinct()


def _hashed(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``_h, _r, _s`` beside the keys: a hash of the keys and two of the whole row."""
    columns = sorted(df.columns)
    key, row, other = F.xxhash64(*[F.col(k) for k in keys]), F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c in columns])
    # a null hashes like no column at all: which columns are null is part of the row
    nulls = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in columns])
    return df.select(*keys, key.alias("_h"), F.xxhash64(row, nulls).alias("_r"), F.xxhash64(other, nulls).alias("_s"))


def _bucket(level: int) -> Column:
    return F.pmod(F.floor(F.pmod(F.col("_h"), F.lit(BUCKETS**2)) / BUCKETS**level), F.lit(BUCKETS)).cast("int")


def _digests(hashed: DataFrame, *by: Column) -> DataFrame:
    wide = "decimal(38,0)"
    return hashed.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("_r").cast(wide)).alias("r"), F.sum(F.col("_s").cast(wide)).alias("s"))


def _unlike(a: DataFrame, b: DataFrame, *by: Column) -> DataFrame:
    """The groups whose digests are not the same in both."""
    x, y = _digests(a, *by), _digests(b, *by)
    names = [c for c in x.columns if c not in ("n", "r", "s")]
    y = y.withColumnsRenamed({c: f"{c}_b" for c in ("n", "r", "s")})
    both = x.join(y, names, "full_outer")
    return both.where(~(F.col("n").eqNullSafe(F.col("n_b")) & F.col("r").eqNullSafe(F.col("r_b")) & F.col("s").eqNullSafe(F.col("s_b"))))


def differences(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """The keys that differ and ``what``: only in one table, changed, or (with equal sets of rows) repeated another number of times. No row if the tables are equal.

    Tables with other columns are an error. A null is a value of a key like others.
    """
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError("the tables have not the same columns")
    a, b = _hashed(a, keys), _hashed(b, keys)
    first = [r.b0 for r in _unlike(a, b, _bucket(0).alias("b0")).select("b0").collect()]  # BUCKETS at most
    if not first:
        return a.limit(0).select(*keys, F.lit("").alias("what"))
    a, b = (x.where(_bucket(0).isin(first)) for x in (a, b))
    second = _unlike(a, b, _bucket(0).alias("b0"), _bucket(1).alias("b1")).select("b0", "b1")
    a, b = (x.withColumns({"b0": _bucket(0), "b1": _bucket(1)}).join(second, ["b0", "b1"], "left_semi") for x in (a, b))
    by = [F.col(k) for k in keys]
    kinds = F.sort_array(F.collect_set(F.struct("_r", "_s")))
    x = a.groupBy(*by).agg(F.count("*").alias("n_a"), kinds.alias("rows_a"))
    y = b.groupBy(*[F.col(k).alias(f"_b_{k}") for k in keys]).agg(F.count("*").alias("n_b"), kinds.alias("rows_b"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    both = x.join(y, same, "full_outer")
    what = F.when(F.col("n_b").isNull(), "only_a").when(F.col("n_a").isNull(), "only_b").when(F.col("rows_a") != F.col("rows_b"), "changed").when(F.col("n_a") != F.col("n_b"), "repeated")
    named = [F.when(F.col("n_a").isNull(), F.col(f"_b_{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    return both.withColumn("what", what).where("what IS NOT NULL").select(*named, "what")
