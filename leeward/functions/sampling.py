"""Seeded draws that do not depend on partitioning.

``rand(seed)`` changes with the layout of the data. These draws hash the row's own key, so the
same key gives the same number on any cluster and in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def uniform(seed: int | str, *key: Column) -> Column:
    """Uniform in [0, 1) from the first 32 bits of an md5 over seed and key."""
    text = F.concat_ws("-", F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def standard_normal(seed: int | str, *key: Column) -> Column:
    """Box-Muller over two uniforms."""
    u1 = F.greatest(uniform(f"{seed}a", *key), F.lit(1e-12))
    u2 = uniform(f"{seed}b", *key)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def lognormal(seed: int | str, sigma: float, *key: Column) -> Column:
    return F.exp(F.lit(float(sigma)) * standard_normal(seed, *key))
