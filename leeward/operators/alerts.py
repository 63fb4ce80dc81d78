"""Alerts against the model band, and the figures of the monitoring board."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leeward.functions.numeric import holds


def alerts(quality: DataFrame) -> DataFrame:
    """``outside_model_band`` from clean readings only; ``sensor_fault`` from quarantined ones."""
    outside = holds(~F.col("dose_rate_usv_h").between(F.col("p05"), F.col("p95")))
    kind = (F.when((F.col("quality_status") == "clean") & outside, "outside_model_band")
            .when(F.col("quality_status") == "drift_suspect", "sensor_fault"))
    return quality.withColumn("alert_type", kind).filter(F.col("alert_type").isNotNull())


def fault_alerts(refused: DataFrame) -> DataFrame:
    """Readings refused by a hard rule, as ``sensor_fault``."""
    return refused.withColumn("alert_type", F.lit("sensor_fault"))


def active_alerts(found: DataFrame, by: list[str]) -> DataFrame:
    return found.groupBy("alert_type", *by).agg(F.count(F.lit(1)).alias("n_alerts"),
                                                F.count_distinct("device_id").alias("n_devices"))


def clean_share(quality: DataFrame, window_minutes: int = 60, by: list[str] = ()) -> DataFrame:
    """Confidence of each window: the share of its readings that are clean."""
    start = (F.floor(F.unix_seconds("event_time") / (window_minutes * 60)) * (window_minutes * 60)).cast("long")
    out = quality.groupBy(*by, start.alias("window_s")).agg(
        F.count(F.lit(1)).alias("n_readings"), F.count_if(F.col("quality_status") == "clean").alias("n_clean"))
    return out.withColumn("clean_share", F.col("n_clean") / F.col("n_readings"))


def with_confidence(found: DataFrame, shares: DataFrame, window_minutes: int = 60, by: list[str] = ()) -> DataFrame:
    """Alerts with the clean share of their window."""
    start = (F.floor(F.unix_seconds("event_time") / (window_minutes * 60)) * (window_minutes * 60)).cast("long")
    return found.withColumn("window_s", start).join(shares.select(*by, "window_s", "clean_share"), [*by, "window_s"], "left")


def dq_metrics(routed: DataFrame, by: list[str]) -> DataFrame:
    """Shares of late and refused readings. Expects ``route`` and ``reasons``."""
    total = F.count(F.lit(1))
    late = F.count_if(F.col("route") == "late")
    refused = F.count_if((F.col("route") == "on_time") & (F.size("reasons") > 0))
    broken = F.when((F.col("route") == "on_time") & (F.size("reasons") > 0), F.col("device_id"))
    return routed.groupBy(*by).agg(
        total.alias("n_sent"), late.alias("n_late"), refused.alias("n_refused"),
        (late / total).alias("late_share"), (refused / total).alias("refused_share"),
        F.count_distinct(broken).alias("devices_refused"))


def band_share(readings: DataFrame, by: list[str]) -> DataFrame:
    """Share of readings inside the model band. Rows without a band are not counted."""
    inside = F.col("dose_rate_usv_h").between(F.col("p05"), F.col("p95"))
    return readings.filter(inside.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_readings"), F.avg(inside.cast("double")).alias("in_band"))


def device_counts(readings: DataFrame, by: list[str], approx: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approx else F.count_distinct
    return readings.groupBy(*by).agg(count(F.col("device_id")).alias("n_devices"),
                                     count(F.col("cell_id")).alias("n_cells"), F.count(F.lit(1)).alias("n_readings"))


def hourly_sketches(readings: DataFrame, log2_size: int = 12) -> DataFrame:
    """One mergeable distinct-count sketch of the devices per cell and hour, a few kilobytes however many readings there are."""
    hour = F.floor(F.unix_seconds("event_time") / 3600).cast("long")
    return readings.where("event_time is not null").groupBy("cell_id", hour.alias("hour")).agg(
        F.hll_sketch_agg("device_id", F.lit(log2_size)).alias("devices"), F.count(F.lit(1)).alias("n_readings"))


def distinct_devices(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Distinct devices of any range of stored sketches, by uniting them: no reading is read again."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("devices")).alias("n_devices"), F.sum("n_readings").alias("n_readings"))


def expected_dose(band: DataFrame) -> DataFrame:
    """Median per cell and hour, the export a reading source compares itself with."""
    return band.select("cell_id", "hour_no", F.col("median").alias("expected_dose"))
