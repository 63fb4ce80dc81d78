"""Named queries that hold the model against measurements."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from leeward.functions.numeric import quantize
from leeward.operators import dose, validation
from leeward.plans import model_band
from leeward.plans.catalog import q3, q6, query
from leeward.plans.exposure_queries import SITES_TIMES_CELLS, cells
from leeward.sources.fixtures import Tables, with_views

LEVELS = ("median", "p05", "p95")
MODELLED = model_band.first_episode_sql(SITES_TIMES_CELLS, "0, 1, 2, 3") | {
    "totals": "select site_no, receptor_id, variant_id, sum(dep) as dep from hourly where nuclide = 'Cs-137' group by 1, 2, 3",
    "bands": f"""select r.site_no, r.receptor_id, {q3('quantile_cont(coalesce(t.dep, 0), 0.5)')} as median,
        {q3('quantile_cont(coalesce(t.dep, 0), 0.05)')} as p05, {q3('quantile_cont(coalesce(t.dep, 0), 0.95)')} as p95
        from receptors r cross join variants v left join totals t on t.site_no = r.site_no and t.receptor_id = r.receptor_id
          and t.variant_id = v.variant_id group by 1, 2""",
    "snapped": """select m.*, case when ix >= 0 and ix < side and iy >= 0 and iy < side then iy * side + ix end as cell_id from (
        select m.*, side, cast(floor(((m.lon - s.lon) * 111194.92664455873 * cos(radians(s.lat)) + 100000.0) / (200000.0 / side)) as bigint) as ix,
          cast(floor(((m.lat - s.lat) * 111194.92664455873 + 100000.0) / (200000.0 / side)) as bigint) as iy
        from v_measurements m join v_sites s on s.site_no = m.site_no, (select cast(floor(sqrt(count(*))) as bigint) as side from part)) m""",
    "points": """select m.site_no, m.cell_id, m.obs, m.is_wet, g.x_m, g.y_m, b.median as pred, b.p05, b.p95 from snapped m
        left join v_grid g on g.cell_id = m.cell_id left join bands b on b.site_no = m.site_no and b.receptor_id = m.cell_id"""}


#: Measurements of one task.
SAMPLES_PER_TASK = 500_000
#: Numbers that stand in for the cell of measurements off the grid.
OFF_GRID_PLACES = 1 << 20


def tasks_for(n_samples: int, n_cells: int, at_least: int) -> int:
    """Tasks by (site, cell), so many that what one of them sorts does not grow with the tables."""
    return max(at_least, math.ceil(n_samples / SAMPLES_PER_TASK), math.ceil(n_cells / model_band.PHYSICS.receptors_per_task))


def observed(t: Tables) -> DataFrame:
    """Measurements in the cells of their site's grid, with the model's band of the first episode. Both sides lie by cell in equally
    many tasks, so neither the band nor the join shuffles again; measurements pass by a task's cells unsorted. Those off the grid
    meet no cell and are dealt out by their place, below zero."""
    sites = [0, 1, 2, 3]
    tasks = tasks_for(t.read("lineitem").count(), len(sites) * t.read("part").count(), t.spark.sparkContext.defaultParallelism * 3)
    found = validation.obs_to_cells(t.measurements(), t.sites(), t.grid_side().scalar())
    off_grid = F.lit(-1) - F.pmod(F.xxhash64("lat", "lon"), F.lit(OFF_GRID_PLACES))
    found = found.withColumn("cell_id", F.coalesce("cell_id", off_grid)).repartition(tasks, "cell_id")
    deposits = model_band.first_episode(t, cells(t, tasks), sites, laid_out=True)
    band = dose.deposition_band(deposits, "dep0", model_band.RUN.n_variants)
    # A row per cell with a value per site: joined by the one key that the cells lie by, else Spark lays both sides out anew.
    by_site = {c: F.array(*[F.max(F.when(F.col("site_no") == n, F.col(c))) for n in sites]) for c in LEVELS}
    band = band.groupBy(F.col("receptor_id").alias("cell_id")).agg(*[a.alias(c) for c, a in by_site.items()])
    grid = t.grid(tasks).select("cell_id", "x_m", "y_m", F.lit(True).alias("known")).join(band.hint("shuffle_hash"), "cell_id", "left")
    met = found.join(grid.hint("shuffle_hash"), "cell_id", "left")
    own = {c: F.when(F.col("known"), quantize(F.coalesce(F.col(c)[F.col("site_no").cast("int")], F.lit(0.0)), 3)) for c in LEVELS}
    met = met.withColumns(own | {"cell_id": F.when(F.col("cell_id") >= 0, F.col("cell_id"))})
    return met.withColumnRenamed("median", "pred").drop("known")


@query(with_views("v_meteo v_measurements v_grid v_sites", f"""select site_no, count(*) as n_samples, count(cell_id) as n_on_grid, count(*) filter (pred > 0) as n_reached,
    {q3('sum(pred)')} as pred_sum, {q3('sum(p95)')} as p95_sum from points group by 1""", MODELLED))
def measurement_cells(t: Tables) -> DataFrame:
    """How many measurements lie on the grid and in cells that the modelled release reached."""
    return observed(t).groupBy("site_no").agg(
        F.count(F.lit(1)).alias("n_samples"), F.count("cell_id").alias("n_on_grid"), F.count_if(F.col("pred") > 0).alias("n_reached"),
        quantize(F.sum("pred"), 3).alias("pred_sum"), quantize(F.sum("p95"), 3).alias("p95_sum"))


@query(with_views("v_meteo v_measurements v_grid v_sites", f"""select site_no, wet, n_samples, n_zero, {q6('coverage')} as coverage, {q6('fac2')} as fac2,
    {q6('fac5')} as fac5, {q6('abs(case when d > 180 then d - 360 when d < -180 then d + 360 else d end)')} as direction_error_deg from (
    select coalesce(cast(site_no as varchar), 'all') as site_no, coalesce(w, 'all') as wet, count(*) filter (obs > 0) as n_samples,
      count(*) filter (not coalesce(obs > 0, false)) as n_zero,
      avg(case when obs > 0 then cast(obs between p05 and p95 as int) end) as coverage,
      avg(case when obs > 0 then cast(pred / obs between 0.5 and 2 as int) end) as fac2,
      avg(case when obs > 0 then cast(pred / obs between 0.2 and 5 as int) end) as fac5,
      degrees(atan2(sum(case when obs > 0 then pred * x_m end), sum(case when obs > 0 then pred * y_m end)))
        - degrees(atan2(sum(case when obs > 0 then obs * x_m end), sum(case when obs > 0 then obs * y_m end))) as d
    from (select *, case when is_wet then 'wet' else 'dry' end as w from points)
    group by grouping sets ((), (site_no), (site_no, w)))""", MODELLED))
def validation_metrics(t: Tables) -> DataFrame:
    points = observed(t).withColumn("wet", F.when(F.col("is_wet"), "wet").otherwise("dry")).withColumn("site_no", F.col("site_no").cast("string"))
    out = validation.validation_metrics(points, ["site_no", "wet"])
    return out.withColumns({c: quantize(F.col(c)) for c in ("coverage", "fac2", "fac5", "direction_error_deg")})
