"""Gaussian plume with ground reflection, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Open-country spread curves. Lateral slope per class; vertical slope with the
# factor and power of its range correction.
SIGMA_Y = {"A": 0.22, "B": 0.16, "C": 0.11, "D": 0.08, "E": 0.06, "F": 0.04}
SIGMA_Z = {
    "A": (0.20, 0.0, 0.0),
    "B": (0.12, 0.0, 0.0),
    "C": (0.08, 0.0002, -0.5),
    "D": (0.06, 0.0015, -0.5),
    "E": (0.03, 0.0003, -1.0),
    "F": (0.016, 0.0003, -1.0),
}


def _by_class(stability: Column, value) -> Column:
    names = list(SIGMA_Y)
    out = F.when(stability == names[0], value(names[0]))
    for name in names[1:-1]:
        out = out.when(stability == name, value(name))
    return out.otherwise(value(names[-1]))


def sigma_y(stability: Column, x: Column) -> Column:
    slope = _by_class(stability, lambda c: F.lit(SIGMA_Y[c]))
    return slope * x / F.sqrt(F.lit(1.0) + F.lit(0.0001) * x)


def sigma_z(stability: Column, x: Column, cap: float) -> Column:
    def curve(c):
        slope, factor, power = SIGMA_Z[c]
        if power == 0.0:
            return F.lit(slope) * x
        base = F.lit(1.0) + F.lit(factor) * x
        return F.lit(slope) * x / (F.sqrt(base) if power == -0.5 else base)
    return F.least(_by_class(stability, curve), F.lit(float(cap)))


def curve_columns(stability: Column) -> dict[str, Column]:
    """The class's curve constants as columns, so that a large join compares no strings per row."""
    return {
        "ay": _by_class(stability, lambda c: F.lit(SIGMA_Y[c])),
        "az": _by_class(stability, lambda c: F.lit(SIGMA_Z[c][0])),
        "fz": _by_class(stability, lambda c: F.lit(SIGMA_Z[c][1])),
        "z_linear": _by_class(stability, lambda c: F.lit(SIGMA_Z[c][2] == -1.0)),
    }


def sigma_y_of(ay: Column, x: Column) -> Column:
    return ay * x / F.sqrt(F.lit(1.0) + F.lit(0.0001) * x)


def sigma_z_of(az: Column, fz: Column, z_linear: Column, x: Column, cap: float) -> Column:
    base = F.lit(1.0) + fz * x
    return F.least(az * x / F.when(z_linear, base).otherwise(F.sqrt(base)), F.lit(float(cap)))


def widest_half_angle_deg(edge_sigmas: float) -> float:
    """Largest angle between plume axis and a point inside the plume edge, over all classes."""
    return math.degrees(math.atan(edge_sigmas * max(SIGMA_Y.values())))


def ground_concentration(y: Column, wind: Column, s_y: Column, s_z: Column, height: float) -> Column:
    """Ground-level air concentration per unit release rate, s/m3."""
    crosswind = F.exp(-(y * y) / (F.lit(2.0) * s_y * s_y))
    vertical = F.exp(F.lit(-height * height) / (F.lit(2.0) * s_z * s_z))
    return crosswind * vertical / (F.lit(math.pi) * wind * s_y * s_z)


def column_load(y: Column, wind: Column, s_y: Column) -> Column:
    """Vertically integrated concentration per unit release rate, s/m2, which rain washes out."""
    return F.exp(-(y * y) / (F.lit(2.0) * s_y * s_y)) / (F.lit(math.sqrt(2 * math.pi)) * wind * s_y)


def concentration_3d(y: Column, z: Column, wind: Column, s_y: Column, s_z: Column, height: float) -> Column:
    up = F.exp(-((z - F.lit(height)) * (z - F.lit(height))) / (F.lit(2.0) * s_z * s_z))
    image = F.exp(-((z + F.lit(height)) * (z + F.lit(height))) / (F.lit(2.0) * s_z * s_z))
    return F.exp(-(y * y) / (F.lit(2.0) * s_y * s_y)) * (up + image) / (F.lit(2 * math.pi) * wind * s_y * s_z)
