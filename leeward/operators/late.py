"""Late readings: explicit lag, stateless split, and the removal of repeated readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leeward.functions.numeric import epoch_s, holds, lag_minutes
from leeward.operators.slices import runs, with_previous


def with_lag(df: DataFrame, max_minutes: float = 15.0) -> DataFrame:
    """Adds ``lag_minutes`` and ``is_late``. Exactly ``max_minutes`` is still on time."""
    lag = lag_minutes(F.col("sent_at"), F.col("event_time"))
    return df.withColumn("lag_minutes", lag).withColumn("is_late", F.col("lag_minutes") > max_minutes)


def with_route(df: DataFrame, max_minutes: float = 15.0) -> DataFrame:
    """``route`` in on_time, late, bad_timestamp: every row gets exactly one."""
    df = with_lag(df, max_minutes)
    return df.withColumn("route", F.when(F.col("is_late").isNull(), "bad_timestamp")
                         .when(F.col("is_late"), "late").otherwise("on_time"))


def split_late(df: DataFrame, max_minutes: float = 15.0) -> tuple[DataFrame, DataFrame]:
    """(on time, late). Stateless, so it works on streams and does not depend on batches.

    Rows without a usable timestamp are in neither part; ``without_time`` has them.
    """
    df = with_lag(df, max_minutes)
    return df.filter(holds(~F.col("is_late"))), df.filter(holds(F.col("is_late")))


def without_time(df: DataFrame) -> DataFrame:
    """Readings whose lag cannot be told, with the columns of ``split_late``."""
    return with_lag(df).filter(F.col("is_late").isNull())


def dedup_exact(df: DataFrame, keys=("device_id", "event_time"), prefer=("sent_at", "ingestion_path"),
                watermark_minutes: int = 15) -> DataFrame:
    """One row per key.

    On a stream the state is bounded by a watermark just wider than the lag rule: Spark treats
    an event time equal to the watermark as late, and a lag of exactly the limit must survive.
    In batch the smallest row by ``prefer`` stays; the minimum is merged before the shuffle, so
    a key with very many copies costs one row per task.
    """
    if df.isStreaming:
        return (df.withWatermark("event_time", f"{watermark_minutes * 60 + 1} seconds")
                .dropDuplicatesWithinWatermark(list(keys)))
    order = [c for c in prefer if c in df.columns]
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("best"))
    return best.select(*keys, "best.*").select(*df.columns)


def dedup_paths(df: DataFrame, tolerance_s: int = 5, slice_seconds: int = 6 * 3600) -> DataFrame:
    """Near copies of one reading that came by several ingest paths: the least delayed stays.

    Readings of a device whose event times follow each other within ``tolerance_s`` form a
    group. Expects ``lag_minutes``. The earliest ``event_time`` of the group is kept as ``group_s``.
    """
    df = df.withColumn("__t", epoch_s(F.col("event_time")))
    order = [F.col("__t"), F.col("ingestion_path"), F.col("lag_minutes")]
    df = runs(df, ["device_id"], order, {"t": F.col("__t")},
              lambda before, now: now["t"] - before["t"] > tolerance_s, slice_seconds)
    rest = [c for c in df.columns if not c.startswith("__") and c not in
            ("device_id", "lag_minutes", "ingestion_path", "run_start", "run_len")]
    best = df.groupBy("device_id", F.col("run_start").alias("group_s")).agg(
        F.min(F.struct("lag_minutes", "ingestion_path", *rest)).alias("best"),
        F.count(F.lit(1)).alias("copies"))
    return best.select("device_id", "group_s", "copies", "best.*")


def union_paths(*frames: DataFrame) -> DataFrame:
    """Union of ingest paths whose columns differ; missing columns become NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def clock_disorder(df: DataFrame, slice_seconds: int = 6 * 3600) -> DataFrame:
    """Flags readings whose event time is before the one that arrived just before it.

    Readings without both times have no place in the order: they are not flagged and come before nothing.
    """
    timed = F.col("sent_at").isNotNull() & F.col("event_time").isNotNull()
    rest = df.filter(~timed).withColumn("prev_event_s", F.lit(None).cast("long")).withColumn("is_disordered", F.lit(False))
    df = df.filter(timed)
    order = [epoch_s(F.col("sent_at")), F.col("event_id"), F.col("ingestion_path")]
    df = with_previous(df, ["device_id"], order, {"prev_event_s": epoch_s(F.col("event_time"))}, slice_seconds)
    return df.withColumn("is_disordered", holds(epoch_s(F.col("event_time")) < F.col("prev_event_s"))).unionByName(rest)
