"""The device registry: change feed to versions with validity, and as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leeward.operators.slices import SLICE, slice_no, with_previous


def scd2(feed: DataFrame, key: str = "device_id", seq: str = "seq", deletes: Column | None = None,
         seq_width: int = 1_000_000, drop: tuple[str, ...] = ("op",)) -> DataFrame:
    """Versions with ``start_seq``, ``end_seq`` and ``is_current`` from a change feed.

    A change valid at ``seq`` ends the version before it; a delete ends without opening one.
    Repeated changes of the same (key, seq) count once, and the order of arrival is irrelevant.
    """
    deletes = F.col("op") == "DELETE" if deletes is None else deletes
    rest = [c for c in feed.columns if c not in (key, seq)]
    once = (feed.groupBy(key, seq).agg(F.min(F.struct(*rest)).alias("__one")).select(key, seq, "__one.*"))
    back = -F.col(seq)   # the row before it in reverse order is the next change
    timed = with_previous(once, [key], [back], {"end_seq": F.col(seq)}, seq_width)
    return (timed.filter(~F.coalesce(deletes, F.lit(False))).withColumnRenamed(seq, "start_seq")
            .withColumn("is_current", F.col("end_seq").isNull()).drop(*drop))


def current(versions: DataFrame) -> DataFrame:
    return versions.filter("is_current")


def with_device(readings: DataFrame, versions: DataFrame, take: list[str], key: str = "device_id") -> DataFrame:
    """Left join with the current version of each device."""
    return readings.join(current(versions).select(key, *take), key, "left")


def as_of(readings: DataFrame, versions: DataFrame, at: Column, take: list[str], key: str = "device_id",
          width: int = 6 * 3600) -> DataFrame:
    """Readings with the version valid at ``at``: start <= at < end; none leaves NULLs.

    Both sides are laid into one order per (key, slice) and the last version start is carried
    forward, so the work is linear however many versions or readings a key has. What is valid
    at the beginning of a slice comes from a summary with one row per slice.
    """
    columns = readings.columns
    version = F.struct(F.col("start_seq").alias("start"), F.col("end_seq").alias("end"),
                       *[F.col(c).alias(f"v_{c}") for c in take])
    left = readings.select(key, at.cast("long").alias("__at"), F.lit(1).alias("__kind"),
                           F.struct(*[c for c in columns if c != key]).alias("__row"))
    right = versions.select(key, F.col("start_seq").cast("long").alias("__at"), F.lit(0).alias("__kind"),
                            version.alias("__version"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn(SLICE, slice_no(F.col("__at"), width))
    by_slice = Window.partitionBy(key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = (both.groupBy(key, SLICE).agg(F.max(F.when(F.col("__kind") == 0, F.struct("__at", "__version"))).alias("__tail"))
               .select(key, SLICE, F.last("__tail.__version", ignorenulls=True).over(by_slice).alias("__carry")))
    w = (Window.partitionBy(key, SLICE).orderBy("__at", "__kind")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("__found", F.last("__version", ignorenulls=True).over(w))
    found = found.filter(F.col("__kind") == 1).join(carried, [key, SLICE], "left")
    version_at = F.coalesce("__found", "__carry")
    found = found.withColumn("__v", version_at)
    valid = F.coalesce(F.col("__v.end").isNull() | (F.col("__at") < F.col("__v.end")), F.lit(False))
    taken = [F.when(valid & F.col("__v").isNotNull(), F.col(f"__v.v_{c}")).alias(c) for c in take]
    return found.select(key, "__row.*", *taken).select(*columns, *take)
