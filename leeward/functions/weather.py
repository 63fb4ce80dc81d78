from __future__ import annotations

from pyspark.sql import Column, functions as F


def plume_direction(wind_from: Column) -> Column:
    """Where the plume goes: the wind direction names where the wind comes from."""
    return F.pmod(wind_from.cast("double") + F.lit(180.0), F.lit(360.0))


def wind_u(speed: Column, wind_from: Column) -> Column:
    return -speed * F.sin(F.radians(wind_from.cast("double")))


def wind_v(speed: Column, wind_from: Column) -> Column:
    return -speed * F.cos(F.radians(wind_from.cast("double")))


def _by_speed(speed: Column, bounds, values) -> Column:
    out = F.when(speed < bounds[0], values[0])
    for bound, value in zip(bounds[1:], values[1:]):
        out = out.when(speed < bound, value)
    return out.otherwise(values[-1])


# Stability by wind speed. Day rows are the radiation bins from strong to weak.
SPEED_BOUNDS = (2.0, 3.0, 5.0, 6.0)
DAY_CLASSES = (
    (925.0, ("A", "A", "B", "C", "C")),
    (675.0, ("A", "B", "B", "C", "D")),
    (175.0, ("B", "C", "C", "D", "D")),
    (0.0, ("D", "D", "D", "D", "D")),
)
NIGHT_SPEED_BOUNDS = (2.0, 3.0, 5.0)
NIGHT_CLOUDY = ("E", "E", "D", "D")
NIGHT_CLEAR = ("F", "F", "E", "D")


def stability_class(speed: Column, radiation: Column, cloud: Column) -> Column:
    """Stability A to F from wind and radiation by day, wind and cloud cover by night."""
    day = F.when(radiation >= DAY_CLASSES[0][0], _by_speed(speed, SPEED_BOUNDS, DAY_CLASSES[0][1]))
    for floor, classes in DAY_CLASSES[1:]:
        day = day.when(radiation >= floor, _by_speed(speed, SPEED_BOUNDS, classes))
    night = F.when(cloud >= 50, _by_speed(speed, NIGHT_SPEED_BOUNDS, NIGHT_CLOUDY)).otherwise(
        _by_speed(speed, NIGHT_SPEED_BOUNDS, NIGHT_CLEAR))
    return F.when(radiation > 0, day).otherwise(night)


def wind_at_height(speed_10m: Column, speed_100m: Column, height_m: float) -> Column:
    """Power-law profile through the 10 m and 100 m speeds; 10 m speed where one of them is not positive."""
    exponent = F.log(speed_100m / speed_10m) / F.lit(2.302585092994046)
    both = (speed_10m > 0) & (speed_100m > 0)
    return F.when(both, speed_10m * F.pow(F.lit(height_m / 10.0), exponent)).otherwise(speed_10m)
