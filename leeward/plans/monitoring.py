"""Sensor path in batch: sent readings to clean, late and refused parts, then quality and alerts.

The same functions run on the stream up to the clean table. Quality needs the rows before
a reading and is rebuilt from the clean table at each refresh, which also makes a full replay
from the raw readings the reference for everything downstream.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from leeward.config import Limits
from leeward.operators.alerts import alerts, clean_share, with_confidence
from leeward.operators.late import dedup_exact, with_route
from leeward.operators.neighbours import neighbourhood
from leeward.operators.quality import history, quality_status
from leeward.operators.rules import apply_rules, quarantine, reading_rules
from leeward.session import staged


@dataclass(frozen=True)
class Split:
    clean: DataFrame
    late: DataFrame
    refused: DataFrame
    untimed: DataFrame


def route_readings(readings: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Every sent reading with its ``route`` and the array of broken rules. No shuffle."""
    return apply_rules(with_route(readings, limits.max_lag_minutes), reading_rules(limits))


def split_readings(readings: DataFrame, limits: Limits = Limits()) -> Split:
    routed = with_route(readings, limits.max_lag_minutes)
    # the rules come after the shuffle of the deduplication, so their result does not travel
    on_time = routed.filter("route = 'on_time'").select(*readings.columns)
    once = apply_rules(dedup_exact(on_time, watermark_minutes=limits.dedup_watermark_minutes), reading_rules(limits))
    clean, refused = quarantine(once)
    return Split(clean.drop("reasons"), routed.filter("route = 'late'"), refused, routed.filter("route = 'bad_timestamp'"))


def clean_readings(readings: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return split_readings(readings, limits).clean


def refresh_quality(readings: DataFrame, devices: DataFrame, band: DataFrame, origin_s: int = 0,
                    limits: Limits = Limits()) -> DataFrame:
    """Quality of all clean readings, from the raw readings.

    The history frame is written once; the judgement then reads only the columns it needs from it.
    """
    marked = staged(history(clean_readings(readings, limits), band, origin_s, limits), "history")
    points, pairs = neighbourhood(devices, limits.neighbour_km)
    return quality_status(marked, points, pairs, limits)


def live_alerts(quality: DataFrame, window_minutes: int = 60) -> DataFrame:
    """Alerts with the share of clean readings in their hour as confidence."""
    return with_confidence(alerts(quality), clean_share(quality, window_minutes), window_minutes)
