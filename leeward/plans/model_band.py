"""The dose band of the monitored release: where the batch path and the sensor path meet.

The release is the first episode of the sensors' site; its variants give every sensor cell and hour a band, which the
readings are made from and judged by. Importing this module gives the independent side its ``v_band``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leeward.config import Limits, Physics, Run
from leeward.functions.numeric import quantize
from leeward.operators import dispersion, dose
from leeward.plans import batch
from leeward.plans.catalog import q6
from leeward.plans.exposure_queries import plume_sql
from leeward.session import staged
from leeward.sources.fixtures import VIEW_SQL, Tables

PHYSICS, RUN, LIMITS = Physics(), Run(), Limits()
SITE = 3
#: P5 and P95 of a detector's lognormal spread (sigma 0.35) around the true dose rate.
LOW, HIGH = 0.56, 1.78
X_M = 512.0
#: Hours from the start of the release to hour 0 of the readings.
LEAD_HOURS = 24
CELL_SQL = "select distinct event_id % 10 as cell_id from events"
HOURS_SQL = "select cast(floor(floor(max(event_id) / 50) / 60) as bigint) + 1 from events"
Y_SQL = "111195.0 * (0.09 * cell_id - 0.01)"


def sensor_cells(t: Tables) -> DataFrame:
    """The cells that hold sensors, in the plane of their site."""
    cells = t.read("events").selectExpr("event_id % 10 as cell_id").distinct()
    return cells.select(F.lit(SITE).cast("long").alias("site_no"), F.col("cell_id").alias("receptor_id"),
                        F.lit(X_M).alias("x_m"), F.expr(Y_SQL).cast("double").alias("y_m"))


def first_episode(t: Tables, receptors: DataFrame, sites: list[int], laid_out: bool = False) -> DataFrame:
    """Hourly deposits of the first episode of each site, a column per nuclide. To receptors that are ``laid_out`` by receptor_id
    the few hours come."""
    clim = batch.climatology(t.weather().where(F.col("site_no").isin(sites)), RUN, PHYSICS, n_episodes=1)
    met = dispersion.release_hours(clim.hours, PHYSICS, RUN.n_variants, RUN.seed)
    return dispersion.with_deposits(dispersion.hits(met, receptors, PHYSICS, few_hours=laid_out, laid_out=laid_out), PHYSICS, RUN.episode_hours)


def model_band(t: Tables) -> DataFrame:
    """(cell_id, hour_no, median, p05, p95) in uSv/h for every sensor cell and hour since the release."""
    cells = sensor_cells(t)
    n_hours = t.read("events").selectExpr("cast(floor(floor(max(event_id) / 50) / 60) as bigint) + 1 as n").scalar() + LEAD_HOURS
    doses = dose.ground_dose_rate(first_episode(t, cells, [SITE]), cells, n_hours, RUN.n_variants, PHYSICS)
    band = dose.with_measurement_spread(dose.hourly_band(doses), LIMITS.background_usv_h, LOW, HIGH)
    seen = band.where(F.col("hour_no") >= LEAD_HOURS).withColumn("hour_no", F.col("hour_no") - LEAD_HOURS)
    return staged(seen.select(F.col("receptor_id").alias("cell_id"), "hour_no", *[quantize(F.col(c)).alias(c) for c in ("median", "p05", "p95")]), "band")


def first_episode_sql(receptors: str, sites: str) -> dict[str, str]:
    """Steps up to ``hourly``, for the first episode of some sites."""
    steps = plume_sql(receptors, False)
    kept = {name: steps[name] for name in ("site_hours", "episodes", "variants", "episode_hours", "receptors", "nuclides", "classed", "placed", "spread", "hourly")}
    kept["classed"] += f" where e.episode_id = 0 and e.site_no in ({sites})"
    return kept


def _band_sql() -> str:
    steps = first_episode_sql(f"select cast({SITE} as bigint) as site_no, cell_id as receptor_id, cast({X_M} as double) as x_m, cast({Y_SQL} as double) as y_m from ({CELL_SQL})", str(SITE))
    # Years of 8,766 hours and the first year's dose, as in the operator, spelled out.
    steps["rates"] = """select nuclide, half_h, msv * 1000.0 / (half_h / ln(2) * (1 - exp(-8766.0 * ln(2) / half_h))) as rate
        from (values ('Cs-137', 30.08 * 365.25 * 24, 0.02), ('I-131', 8.0252 * 24, 0.001)) as r(nuclide, half_h, msv)"""
    steps["spine"] = f"select cell_id, unnest(range(({HOURS_SQL}))) as hour_no from ({CELL_SQL})"
    steps["doses"] = """select s.cell_id, s.hour_no, v.variant_id,
        coalesce(sum(h.dep * r.rate * exp(-0.6931471805599453 * (s.hour_no + {lead} - h.hour_in_episode) / r.half_h)), 0) as dose
        from spine s cross join variants v left join hourly h on h.receptor_id = s.cell_id and h.variant_id = v.variant_id and h.hour_in_episode <= s.hour_no + {lead}
        left join rates r on r.nuclide = h.nuclide group by 1, 2, 3""".replace("{lead}", str(LEAD_HOURS))
    body = f"""select cell_id, hour_no, {q6('quantile_cont(dose, 0.5)')} as median,
        {q6(f'(0.05 + quantile_cont(dose, 0.05)) * {LOW}')} as p05, {q6(f'(0.05 + quantile_cont(dose, 0.95)) * {HIGH}')} as p95 from doses group by 1, 2"""
    return "with " + ", ".join(f"{name} as materialized ({text})" for name, text in steps.items()) + " " + body


VIEW_SQL["v_band"] = (("v_meteo",), _band_sql())
