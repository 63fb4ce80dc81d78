"""From hourly deposits to the dose rate above the ground, and its band over the variants of a run.

What lies on the ground in an hour is all that fell so far, decayed since: a running sum with decay along the hours of a receptor and
variant. It runs within slices of ``SLICE_HOURS``; what a slice inherits is one number per nuclide, carried from the ends of the slices before it.
Hours without a deposit are part of the spine, so a band has a row for every receptor and hour.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from leeward.config import Nuclide, Physics
from leeward.operators.quantiles import percentile_of_sorted

SLICE_HOURS = 24
HOURS_PER_YEAR = 8766.0


def hourly_decay(n: Nuclide) -> float:
    """Share that is left after an hour."""
    return 0.5 ** (3600.0 / n.half_life_s)


def usv_h_per_kbq_m2(n: Nuclide) -> float:
    """Dose rate of a fresh deposit: the first year's dose over the hours it lasts, counted at full strength."""
    mean_life_h = n.half_life_s / 3600.0 / math.log(2)
    full_hours = mean_life_h * (1.0 - math.exp(-HOURS_PER_YEAR / mean_life_h))
    return n.msv_per_kbq_m2 * 1000.0 / full_hours


def _running(fallen: Column, i: int, keep: float, hours: int) -> Column:
    """Activity of nuclide ``i`` at each hour of a slice from what fell in it: an array of ``hours`` values."""
    def at(hour: Column) -> Column:
        return F.aggregate(F.filter(fallen, lambda x: x["at"] == hour), F.lit(0.0), lambda acc, x: acc + x[f"dep{i}"])
    start = F.struct(F.array().cast("array<double>").alias("past"), F.lit(0.0).alias("now"))

    def step(acc: Column, hour: Column) -> Column:
        now = acc["now"] * keep + at(hour)
        return F.struct(F.array_append(acc["past"], now).alias("past"), now.alias("now"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(hours - 1)), start, step, lambda acc: acc["past"])


def _carried(ends: Column, keep: float) -> Column:
    return F.aggregate(ends, F.lit(0.0), lambda acc, e: acc * keep + e)


def ground_dose_rate(deposits: DataFrame, receptors: DataFrame, n_hours: Column | int, n_variants: int, physics: Physics,
                     slice_hours: int = SLICE_HOURS) -> DataFrame:
    """(site_no, receptor_id, variant_id, hour_no, dose_usv_h) for hours 0 to ``n_hours`` - 1 of one episode.

    ``deposits`` has a column per nuclide (dep0, dep1, ..) and ``hour_in_episode``; hours count from the release. ``receptors`` has (site_no, receptor_id).
    """
    n_hours = (F.lit(n_hours) if not isinstance(n_hours, Column) else n_hours).cast("long")
    key = ["site_no", "receptor_id", "variant_id"]
    number = F.col("hour_in_episode").cast("long")
    fell = F.struct((number % slice_hours).cast("int").alias("at"), *[F.col(f"dep{i}") for i in range(len(physics.nuclides))])
    fallen = deposits.groupBy(*key, F.floor(number / slice_hours).alias("slice")).agg(F.collect_list(fell).alias("fallen"))
    spine = (receptors.select("site_no", "receptor_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_variants - 1).cast("long"))).alias("variant_id"))
             .withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n_hours - 1) / slice_hours)))))
    whole = spine.join(fallen, [*key, "slice"], "left")
    before = Window.partitionBy(*key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    for i, n in enumerate(physics.nuclides):
        whole = whole.withColumn(f"own{i}", _running(F.coalesce("fallen", F.array()), i, hourly_decay(n), slice_hours))
    for i, n in enumerate(physics.nuclides):
        # Only the slices' ends travel along the key, a number per slice.
        ends = F.collect_list(F.element_at(f"own{i}", -1)).over(before)
        whole = whole.withColumn(f"held{i}", _carried(ends, hourly_decay(n) ** slice_hours))
    hours = F.transform(F.sequence(F.lit(0), F.lit(slice_hours - 1)), lambda k: F.struct(
        k.alias("at"), sum((usv_h_per_kbq_m2(n) * (F.col(f"own{i}")[k] + F.col(f"held{i}") * F.pow(F.lit(hourly_decay(n)), k + 1))
                            for i, n in enumerate(physics.nuclides)), F.lit(0.0)).alias("dose_usv_h")))
    out = whole.select(*key, "slice", F.inline(hours))
    return out.select(*key, (F.col("slice") * slice_hours + F.col("at")).alias("hour_no"), "dose_usv_h").where(F.col("hour_no") < n_hours)


def hourly_band(doses: DataFrame) -> DataFrame:
    """Median, P5 and P95 over the variants, per receptor and hour. A group holds one value per variant, a setting."""
    level = lambda p: F.percentile("dose_usv_h", F.lit(p))
    return doses.groupBy("site_no", "receptor_id", "hour_no").agg(
        level(0.5).alias("median"), level(0.05).alias("p05"), level(0.95).alias("p95"))


def deposition_band(deposits: DataFrame, column: str, n_variants: int) -> DataFrame:
    """Median, P5 and P95 over the variants of what fell in the whole episode; a variant that missed a receptor counts as zero."""
    fell = deposits.groupBy("site_no", "receptor_id", "variant_id").agg(F.sum(column).alias("total"))
    sums = fell.groupBy("site_no", "receptor_id").agg(F.sort_array(F.collect_list("total")).alias("totals"))     # one per variant
    level = lambda p: percentile_of_sorted(F.col("totals"), F.lit(n_variants), p)
    return sums.select("site_no", "receptor_id", level(0.5).alias("median"), level(0.05).alias("p05"), level(0.95).alias("p95"))


def with_measurement_spread(band: DataFrame, background: float, low: float, high: float) -> DataFrame:
    """The band in which readings are expected: background added, and widened by the spread of a detector around the true value."""
    return band.withColumns({"p05": (F.lit(background) + F.col("p05")) * F.lit(low), "p95": (F.lit(background) + F.col("p95")) * F.lit(high)})
