"""Explicit schemas of the landed inputs and of the gold contract."""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, DoubleType, LongType, StringType, StructField, StructType, TimestampType)


def _s(*cols) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in cols])


S, D, L, TS = StringType(), DoubleType(), LongType(), TimestampType()

READING = _s(("device_id", S), ("event_time", TS), ("sent_at", TS), ("dose_rate_usv_h", D),
             ("wind_speed_ms", D), ("battery", D))

DEVICE_CHANGE = _s(("device_id", S), ("seq", L), ("op", S), ("firmware", S), ("jurisdiction_code", S),
                   ("cell_id", L), ("lat", D), ("lon", D))

# The seven hourly variables of a weather file.
HOURLY = ("wind_speed_10m", "wind_direction_10m", "wind_speed_100m", "wind_direction_100m",
          "precipitation", "cloud_cover", "shortwave_radiation")

WEATHER_FILE = StructType([
    StructField("latitude", D), StructField("longitude", D), StructField("elevation", D),
    StructField("req_lat", D), StructField("req_lon", D),
    StructField("hourly_units", _s(*[(name, S) for name in HOURLY])),
    StructField("hourly", StructType([StructField("time", ArrayType(S))] +
                                     [StructField(name, ArrayType(D)) for name in HOURLY])),
])

SOURCE_TERM = _s(("nuclide", S), ("hour", TS), ("source_term_bq", D))
DOSE_POINT = _s(("lat", D), ("lon", D), ("measured_at", TS), ("dose_rate_usv_h", D))
DEPOSIT_SAMPLE = _s(("lat", D), ("lon", D), ("sampled_at", TS), ("medium", S), ("nuclide", S), ("kbq_m2", D))
CITY = _s(("city_id", L), ("name", S), ("aliases", S), ("lat", D), ("lon", D), ("population", L))
POPULATION_POINT = _s(("x", D), ("y", D), ("people", D))

CITY_EXPOSURE = _s(("site_no", L), ("city_id", L), ("nuclide", S), ("threshold_id", S),
                   ("distance_km", D), ("bearing_deg", D), ("population", L), ("p_exceed", D),
                   ("dep_p05", D), ("dep_p50", D), ("dep_p95", D), ("arrival_h_p50", D),
                   ("worst_wind_sector", L), ("n_scenarios", L), ("model_version", S))
