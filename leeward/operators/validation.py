"""Model quality against measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leeward.operators.geometry import snap_to_cells


def obs_to_cells(obs: DataFrame, sites: DataFrame, side: int) -> DataFrame:
    """Measurement points with (site_no, lat, lon) get the grid cell they fall into."""
    return snap_to_cells(obs, sites, side)


def validation_metrics(points: DataFrame, by: list[str]) -> DataFrame:
    """Coverage of [p05, p95], FAC2, FAC5 and the error of the plume direction, with totals by rollup.

    ``points``: obs, pred, p05, p95 and the place (x_m, y_m) relative to the source. Samples
    without a positive observation are left out and counted. The direction error is the angle
    between the bearings of the predicted and the observed centre of deposition. All sums merge.
    """
    counted = F.coalesce(F.col("obs") > 0, F.lit(False))
    ratio = F.try_divide("pred", "obs")

    def share(condition):
        return F.avg(F.when(counted, condition.cast("double")))

    def toward(weight: str):
        x = F.sum(F.when(counted, F.col(weight) * F.col("x_m")))
        y = F.sum(F.when(counted, F.col(weight) * F.col("y_m")))
        return F.degrees(F.atan2(x, y))

    turn = toward("pred") - toward("obs")
    out = points.rollup(*by).agg(
        F.count_if(counted).alias("n_samples"), F.count_if(~counted).alias("n_zero"),
        share(F.col("obs").between(F.col("p05"), F.col("p95"))).alias("coverage"),
        share(ratio.between(0.5, 2.0)).alias("fac2"), share(ratio.between(0.2, 5.0)).alias("fac5"),
        turn.alias("turn"))
    signed = F.when(F.col("turn") > 180, F.col("turn") - 360).when(F.col("turn") < -180, F.col("turn") + 360).otherwise(F.col("turn"))
    return out.withColumn("direction_error_deg", F.abs(signed)).drop("turn").fillna("all", subset=by)
