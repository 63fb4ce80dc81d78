"""Device health: quarantined after a series of bad readings, healthy again after good ones in a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leeward.config import Limits
from leeward.functions.numeric import epoch_s
from leeward.operators.slices import runs_of_value, with_previous


def health_events(readings: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """State changes (device_id, at_s, state) from readings with a boolean ``bad``.

    A series of equal outcomes that reaches its required length asks for a state; a request for
    the state the device already has changes nothing. Devices begin healthy.
    """
    order = [epoch_s(F.col("event_time")), F.col("ingestion_path")]
    marked = runs_of_value(readings.select("device_id", "event_time", "ingestion_path", "bad"),
                           ["device_id"], order, F.col("bad"), limits.slice_seconds)
    asks = F.when(F.col("bad") & (F.col("run_len") == limits.bad_run), "quarantined").when(
        ~F.col("bad") & (F.col("run_len") == limits.good_run), "healthy")
    asked = (marked.withColumn("state", asks).filter(F.col("state").isNotNull())
             .select("device_id", epoch_s(F.col("event_time")).alias("at_s"), "ingestion_path", "state"))
    asked = with_previous(asked, ["device_id"], [F.col("at_s"), F.col("ingestion_path")],
                          {"before": F.col("state")}, limits.slice_seconds)
    changed = F.col("state") != F.coalesce("before", F.lit("healthy"))
    return asked.filter(changed).select("device_id", "at_s", "state")


def device_health(readings: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Current state per device, since when, and how often it was quarantined."""
    events = health_events(readings, limits)
    last = events.groupBy("device_id").agg(
        F.max(F.struct("at_s", "state")).alias("last"),
        F.count_if(F.col("state") == "quarantined").alias("n_quarantined"))
    devices = readings.groupBy("device_id").agg(F.count(F.lit(1)).alias("n_readings"), F.count_if("bad").alias("n_bad"))
    return devices.join(last, "device_id", "left").select(
        "device_id", "n_readings", "n_bad", F.coalesce("last.state", F.lit("healthy")).alias("state"),
        F.col("last.at_s").alias("since_s"), F.coalesce("n_quarantined", F.lit(0)).alias("n_quarantined"))
