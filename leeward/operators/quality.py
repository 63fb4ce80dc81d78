"""Rules that need a device's history: residual drift, frozen values, steps, warm-up, unit shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leeward.config import Limits
from leeward.functions.numeric import epoch_s, holds
from leeward.operators.neighbours import confirmed_by_neighbours, members, neighbourhood, per_minute
from leeward.operators.slices import SLICE, carry_runs, runs_of_value, slice_no, trailing, with_previous

DEVICE = ["device_id"]


def event_s() -> Column:
    return epoch_s(F.col("event_time"))


def in_time() -> list[Column]:
    return [event_s(), F.col("ingestion_path")]


def with_model_band(readings: DataFrame, band: DataFrame, origin_s: int = 0) -> DataFrame:
    """Left join with the hourly model band on (cell_id, hour_no); no band leaves NULLs.

    ``origin_s`` is the epoch second at which hour 0 of the band begins.
    """
    hour = F.floor((event_s() - F.lit(origin_s)) / 3600).cast("long")
    return readings.withColumn("hour_no", hour).join(band, ["cell_id", "hour_no"], "left")


def with_residual(df: DataFrame, background: float = 0.05) -> DataFrame:
    """ln(dose / (background + model median)); NULL where it is undefined."""
    ratio = F.try_divide(F.col("dose_rate_usv_h"), F.lit(background) + F.col("median"))
    return df.withColumn("residual", F.log(F.when(ratio > 0, ratio)))


def residual_mean(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Mean residual over the trailing window, current reading included."""
    return trailing(df, DEVICE, event_s(), limits.drift_window_minutes * 60, limits.slice_seconds,
                    {"residual_30m": F.avg("residual")})


def same_as_prev(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    df = with_previous(df, DEVICE, in_time(), {"prev_dose": F.col("dose_rate_usv_h")}, limits.slice_seconds)
    return df.withColumn("same_as_prev", holds(F.col("dose_rate_usv_h") == F.col("prev_dose")))


def max_delta(df: DataFrame, column: str = "wind_speed_ms", limit: float = 25.0,
              slice_seconds: int = Limits.slice_seconds) -> DataFrame:
    """Flags steps between neighbouring readings of a device beyond ``limit``."""
    df = with_previous(df, DEVICE, in_time(), {"prev_value": F.col(column)}, slice_seconds)
    step = F.abs(F.col(column) - F.col("prev_value"))
    return df.withColumn("step", step).withColumn("step_exceeded", holds(F.col("step") > limit))


def frozen_run(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Length so far of the series of equal dose values, and the flag from the n-th repeat on."""
    df = runs_of_value(df, DEVICE, in_time(), F.col("dose_rate_usv_h"), limits.slice_seconds)
    return df.withColumn("is_frozen", F.col("run_len") >= limits.frozen_repeats)


def frozen_runs(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per series of at least n equal values."""
    marked = runs_of_value(df, DEVICE, in_time(), F.col("dose_rate_usv_h"), limits.slice_seconds)
    per_run = marked.groupBy("device_id", F.col("run_start").alias("start_s")).agg(
        F.max(F.unix_seconds("event_time")).alias("end_s"), F.max("run_len").alias("n_readings"),
        F.max("dose_rate_usv_h").alias("dose_rate_usv_h"))
    return per_run.filter(F.col("n_readings") >= limits.frozen_repeats)


def warmup(df: DataFrame, minutes: int = 10) -> DataFrame:
    """Flags the first minutes of a device. The first time per device is a merged minimum."""
    first = df.groupBy("device_id").agg(F.min(event_s()).alias("first_s"))
    return (df.join(first, "device_id")
            .withColumn("is_warmup", event_s() - F.col("first_s") < minutes * 60))


def mark_history(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The trailing residual and the marks of equal-value runs, in one shuffle and one sort.

    Needs ``residual``. What a run inherits from the slice before it is added by ``resolve_runs``,
    which reads this frame twice: hand it a written table.
    """
    width, reach = limits.slice_seconds, limits.drift_window_minutes * 60
    own = slice_no(event_s(), width)
    df = df.withColumn("__sec", event_s()).withColumn("__home_slice", own)
    df = df.withColumn(SLICE, F.explode(F.sequence(own, slice_no(F.col("__sec") + F.lit(reach), width))))
    df = df.withColumn("__home", F.col(SLICE) == F.col("__home_slice"))
    w = Window.partitionBy("device_id", SLICE).orderBy("__sec", "ingestion_path")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    frame = Window.partitionBy("device_id", SLICE).orderBy("__sec").rangeBetween(-reach, 0)
    dose = F.col("dose_rate_usv_h")
    df = df.withColumns({"__first": F.row_number().over(w) == 1, "__before": F.lag(dose).over(w),
                         "__rn": F.count_if("__home").over(upto)})
    df = df.withColumn("__open", F.when(~F.col("__first"), F.coalesce(F.col("__before") != dose, F.lit(True))))
    df = df.withColumns({"__open_rn": F.max(F.when(F.col("__home") & F.col("__open"), F.col("__rn"))).over(upto),
                         "residual_30m": F.avg("residual").over(frame)})
    return df.filter("__home").drop("__home", "__home_slice", "__first", "__before")


def resolve_runs(marked: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``run_len`` and ``is_frozen`` from the marks."""
    keys = ["device_id"]
    ends = F.struct("__sec", "ingestion_path", "dose_rate_usv_h", "__open")
    per_slice = marked.groupBy(*keys, SLICE).agg(
        F.count(F.lit(1)).alias("n"), F.max("__open_rn").alias("last_rn"),
        F.min(ends).alias("head"), F.max(ends).alias("tail"))
    by_slice = Window.partitionBy(*keys).orderBy(SLICE)
    same = F.col("tail_before.dose_rate_usv_h") == F.col("head.dose_rate_usv_h")
    # the first row of a slice knows whether it opens a run if a row of the last minutes stood before it
    linked = F.when(F.col("head.__open").isNotNull(), ~F.col("head.__open")).otherwise(F.coalesce(same, F.lit(False)))
    per_slice = per_slice.withColumn("tail_before", F.lag("tail").over(by_slice)).withColumn("linked", linked)
    per_slice = per_slice.withColumn("last_pos", F.lit(None).cast("long")).withColumn("head_pos", F.col("head.__sec"))
    out = marked.join(carry_runs(per_slice, keys).drop("__pos_in"), [*keys, SLICE], "left")
    run_len = F.when(F.col("__open_rn").isNull(), F.col("__rn") + F.col("__len_in")).otherwise(
        F.col("__rn") - F.col("__open_rn") + 1).cast("long")
    return (out.withColumn("run_len", run_len).withColumn("is_frozen", F.col("run_len") >= limits.frozen_repeats)
            .drop(SLICE, "__sec", "__open", "__open_rn", "__rn", "__len_in"))


def history(clean: DataFrame, band: DataFrame, origin_s: int = 0, limits: Limits = Limits()) -> DataFrame:
    """Clean readings with band, residual and history marks: the frame to write before judging."""
    return mark_history(with_residual(with_model_band(clean, band, origin_s), limits.background_usv_h), limits)


def quality_status(marked: DataFrame, points: DataFrame, pairs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``quality_status`` in clean, drift_suspect, frozen, warmup, from a written ``history``.

    ``points`` and ``pairs`` are the positions of the devices and the groups around them (``neighbourhood``); they
    change only with the registry.

    A raised residual that the neighbours share is a real signal over an area (``plume_signal``);
    one they do not share is drift. Only device-minutes with a raised residual are compared, and
    only readings of their neighbours in those minutes take part.
    """
    minute = F.floor(event_s() / 60).cast("long")
    confirmed = confirmed_by_neighbours(marked, "residual_30m", points, pairs, limits.drift_threshold)
    df = warmup(resolve_runs(marked, limits), limits.warmup_minutes).withColumn("minute", minute)
    df = df.join(confirmed, ["device_id", "minute"], "left")
    up = holds(F.col("residual_30m") > limits.drift_threshold)
    shared = holds(F.col("confirmed"))
    status = (F.when(F.col("is_warmup"), "warmup").when(F.col("is_frozen"), "frozen")
              .when(up & ~shared, "drift_suspect").otherwise("clean"))
    return df.withColumn("plume_signal", up & shared).withColumn("quality_status", status).drop("confirmed")


def quality_status_stable(quality: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Keeps a drift flag only from the n-th reading in a row on that carries it."""
    df = runs_of_value(quality.drop("run_len", "run_start"), DEVICE, in_time(), F.col("quality_status"),
                       limits.slice_seconds)
    brief = (F.col("quality_status") == "drift_suspect") & (F.col("run_len") < limits.stable_repeats)
    return df.withColumn("quality_status_stable", F.when(brief, "clean").otherwise(F.col("quality_status")))


def unit_shift(df: DataFrame, column: str = "wind_speed_ms", block_minutes: int = 30,
               limits: Limits = Limits()) -> DataFrame:
    """Level shifts of a whole series, as after a change of unit.

    Medians of neighbouring blocks of time are compared, so a single spike changes nothing.
    One row per device and block.
    """
    block = F.floor(event_s() / (block_minutes * 60)).cast("long")
    levels = (df.filter(F.col(column).isNotNull()).groupBy("device_id", block.alias("block"))
              .agg(F.percentile(F.col(column), F.lit(0.5)).alias("level"), F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("device_id").orderBy("block")
    levels = levels.withColumn("prev_level", F.lag("level").over(w)).withColumn(
        "ratio", F.try_divide("level", "prev_level"))
    suspect = holds(F.col("ratio").between(limits.unit_ratio_low, limits.unit_ratio_high))
    return levels.withColumn("unit_suspect", suspect)


def impute_gaps(df: DataFrame, devices: DataFrame, gap_minutes: float = 5.0,
                limits: Limits = Limits()) -> DataFrame:
    """Missing minutes of a device, filled with the mean of its neighbours and marked as imputed.

    Only the minutes inside a gap are generated. Minutes without any neighbour stay NULL.
    """
    minute = F.floor(event_s() / 60).cast("long")
    seen = df.select("device_id", minute.alias("minute"), "ingestion_path", "event_time")
    seen = with_previous(seen, DEVICE, [F.col("minute"), F.col("event_time"), F.col("ingestion_path")],
                         {"prev_minute": F.col("minute")}, limits.slice_seconds // 60)
    gaps = seen.filter(F.col("minute") - F.col("prev_minute") > gap_minutes)
    missing = gaps.select("device_id", F.explode(
        F.sequence(F.col("prev_minute") + 1, F.col("minute") - 1)).alias("minute"))
    points, pairs = neighbourhood(devices, limits.neighbour_km)
    values = per_minute(df, "dose_rate_usv_h").join(members(points, pairs), "device_id")
    sums = values.groupBy("near", "minute").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    around = (missing.join(points.select("device_id", "point"), "device_id", "left").join(pairs, "point", "left")
              .join(sums, ["near", "minute"], "left")
              .groupBy("device_id", "minute").agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
    return around.select("device_id", "minute", F.try_divide("s", "n").alias("dose_rate_usv_h"),
                         F.coalesce("n", F.lit(0)).alias("n_neighbours"), F.lit(True).alias("is_imputed"))
