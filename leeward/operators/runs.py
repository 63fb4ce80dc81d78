"""Comparing two runs: checksums, differences, key-by-key status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def checksum(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row (n_rows, checksum), the same for any order and layout of the rows.

    A sum of row digests in decimal arithmetic: it does not overflow, and it merges freely.
    """
    columns = columns or df.columns
    # every value goes in with its length, a NULL as a mark of its own: different rows give different texts
    values = [F.col(c).cast("string") for c in columns]
    text = F.concat(*[F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values])
    digest = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("checksum"))


def fast_checksum(df: DataFrame) -> DataFrame:
    """As ``checksum`` with a cheaper digest, for comparing runs of this engine with each other."""
    digest = F.xxhash64(*df.columns).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("checksum"))


def run_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows on each side, and rows (with multiplicity) that only one side has.

    Equal rows are counted on both sides in a single merged aggregation, so many copies of one
    row cost no more than one.
    """
    b = b.select(*a.columns)
    both = a.withColumn("__l", F.lit(1)).withColumn("__r", F.lit(0)).unionByName(
        b.withColumn("__l", F.lit(0)).withColumn("__r", F.lit(1)))
    counted = both.groupBy(*a.columns).agg(F.sum("__l").alias("l"), F.sum("__r").alias("r"))
    zero = F.lit(0)
    return counted.agg(
        F.coalesce(F.sum("l"), zero).alias("n_left"), F.coalesce(F.sum("r"), zero).alias("n_right"),
        F.coalesce(F.sum(F.greatest(F.col("l") - F.col("r"), zero)), zero).alias("only_left"),
        F.coalesce(F.sum(F.greatest(F.col("r") - F.col("l"), zero)), zero).alias("only_right"))


def diff_runs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer comparison by key: status in same, changed, only_left, only_right."""
    rest = [c for c in a.columns if c not in keys]
    left = a.select(*keys, F.struct(*rest).alias("left"), F.lit(True).alias("__in_left"))
    right = b.select(*keys, F.struct(*rest).alias("right"), F.lit(True).alias("__in_right"))
    joined = left.join(right, keys, "full_outer")
    equal = reduce(lambda x, y: x & y, [F.col(f"left.{c}").eqNullSafe(F.col(f"right.{c}")) for c in rest], F.lit(True))
    status = (F.when(F.col("__in_right").isNull(), "only_left").when(F.col("__in_left").isNull(), "only_right")
              .when(equal, "same").otherwise("changed"))
    return joined.withColumn("status", status).drop("__in_left", "__in_right")
