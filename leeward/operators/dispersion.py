"""Unit plumes over receptors (grid cells or cities), summed to episodes in the same job.

A receptor meets an hour only if it lies downwind and where the hour's deposit can reach a printed digit: not
further off the axis than ``edge_sigmas`` lateral spreads (see ``Physics``). That turns grid x hours
into an equality join over bins of the plume direction, and the other rows are never built.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from leeward.config import Physics
from leeward.functions import plume
from leeward.functions.geo import sector_of
from leeward.functions.numeric import decay_factor
from leeward.functions.weather import plume_direction, stability_class, wind_at_height
from leeward.operators.scenarios import variants

RECEPTOR = ["site_no", "receptor_id"]
SCENARIO = ["episode_id", "variant_id"]


def release_hours(hours: DataFrame, physics: Physics, n_variants: int, seed: int) -> DataFrame:
    """Hours of episodes with what the plume needs, one row per physical variant."""
    wind = F.greatest(wind_at_height(F.col("wind_speed_10m"), F.col("wind_speed_100m"), physics.release_height_m),
                      F.lit(physics.min_wind))
    toward = plume_direction(F.col("wind_direction_10m"))
    base = hours.select(
        "site_no", "episode_id", F.col("hour_in_episode").cast("long").alias("hour_in_episode"), "hour_no",
        wind.alias("u"), F.col("precipitation").alias("rain"), toward.alias("toward"),
        sector_of(F.col("wind_direction_10m").cast("double"), physics.sectors).alias("sector"),
        stability_class(F.col("wind_speed_10m"), F.col("shortwave_radiation"), F.col("cloud_cover")).alias("base_class"))
    base = base.withColumns({
        "sin_t": F.sin(F.radians("toward")), "cos_t": F.cos(F.radians("toward")),
        "bin": (F.floor(F.col("toward") / physics.bearing_bin_deg) % (360 // physics.bearing_bin_deg)).cast("long")})
    varied = base.select("*", F.inline(variants(n_variants, seed)))
    place = F.least(F.greatest(F.expr("instr('ABCDEF', base_class) - 1") + F.col("class_shift"), F.lit(0)), F.lit(5))
    varied = varied.withColumn("stability", F.substring(F.lit("ABCDEF"), place.cast("int") + 1, F.lit(1)))
    return varied.withColumns(plume.curve_columns(F.col("stability"))).drop("base_class", "class_shift", "toward")


def into_bins(receptors: DataFrame, physics: Physics) -> DataFrame:
    """Receptors entered into every bin of plume direction from which a plume can reach them."""
    bearing = F.pmod(F.degrees(F.atan2("x_m", "y_m")) + F.lit(360.0), F.lit(360.0))
    half = plume.widest_half_angle_deg(physics.edge_sigmas)
    width, n = physics.bearing_bin_deg, 360 // physics.bearing_bin_deg
    first = F.floor((bearing - F.lit(half)) / width).cast("long")
    last = F.floor((bearing + F.lit(half)) / width).cast("long")
    bins = F.transform(F.sequence(first, F.least(last, first + n - 1)), lambda b: F.pmod(b, F.lit(n)).cast("long"))
    away = sector_of(bearing + F.lit(180.0), physics.sectors)
    return receptors.select(*RECEPTOR, "x_m", "y_m", away.alias("upwind_sector"), F.explode(bins).alias("bin"))


def hits(hours: DataFrame, receptors: DataFrame, physics: Physics, partitions: int | None = None, few_hours: bool = False,
         laid_out: bool = False) -> DataFrame:
    """One row per receptor, hour and variant inside the plume, with geometry and unit values.

    Hours are laid out by (site, episode). With a receptor table of checked size, it is
    broadcast and everything up to the episode sum stays in place; a larger one is joined by
    shuffle over (site, bin, salt), the salt spreading the few bins over all tasks. ``few_hours`` (one episode a site)
    sends the hours to the receptors instead: what is grouped by receptor then needs no shuffle of hits. Receptors that are
    ``laid_out`` by receptor_id stay where they lie.
    """
    spark = hours.sparkSession
    partitions = partitions or spark.sparkContext.defaultParallelism * 3
    binned = into_bins(receptors, physics)
    if few_hours:
        if not laid_out:
            tasks = max(partitions, math.ceil(receptors.count() / physics.receptors_per_task))
            binned = into_bins(receptors.repartition(tasks, *RECEPTOR), physics)
        met = binned.join(F.broadcast(hours), ["site_no", "bin"])
    elif receptors.limit(physics.broadcast_receptors + 1).count() <= physics.broadcast_receptors:
        met = hours.repartition(partitions, "site_no", "episode_id").join(F.broadcast(binned), ["site_no", "bin"])
    else:
        salts = max(1, math.ceil(partitions * physics.bearing_bin_deg / 360))
        salted = hours.withColumn("salt", F.pmod(F.xxhash64("episode_id"), F.lit(salts)))
        spread = binned.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        keys = ["site_no", "bin", "salt"]
        met = salted.repartition(partitions, *keys).join(spread.repartition(partitions, *keys), keys).drop("salt")
    x = F.col("x_m") * F.col("sin_t") + F.col("y_m") * F.col("cos_t")
    y = F.col("x_m") * F.col("cos_t") - F.col("y_m") * F.col("sin_t")
    met = met.withColumn("x", x).withColumn("y", y).filter(F.col("x") >= physics.nearest_m)
    met = met.withColumn("s_y", plume.sigma_y_of(F.col("ay"), F.col("x")))
    met = met.filter(F.abs("y") <= F.lit(physics.edge_sigmas) * F.col("s_y"))
    s_z = plume.sigma_z_of(F.col("az"), F.col("fz"), F.col("z_linear"), F.col("x"), physics.mixing_height_m)
    met = met.withColumn("s_z", s_z)
    return met.withColumns({
        "air": plume.ground_concentration(F.col("y"), F.col("u"), F.col("s_y"), F.col("s_z"), physics.release_height_m),
        "load": plume.column_load(F.col("y"), F.col("u"), F.col("s_y")),
        "travel_s": F.col("x") / F.col("u")})


def sector_reach(physics: Physics) -> int:
    """How many sectors a contributing wind can lie off straight upwind: the widest plume's half angle, and one for rounding."""
    reach = int(plume.widest_half_angle_deg(physics.edge_sigmas) // (360.0 / physics.sectors)) + 1
    if 2 * reach + 1 > physics.sectors:
        raise ValueError(f"{physics.sectors} sectors are too few for a plume edge of {physics.edge_sigmas} sigmas")
    return reach


def _deposit(n, episode_hours: int) -> Column:
    """Deposit in kBq/m2 of one hour at one receptor, for the reference release spread evenly over the episode."""
    dry = F.lit(float(n.deposition_velocity)) * F.col("dep_factor") * F.col("air")
    washed = F.lit(float(n.scavenging_a)) * F.pow(F.col("rain"), F.lit(float(n.scavenging_b))) * F.col("load")
    wet = F.when(F.col("rain") > 0, washed).otherwise(0.0)
    return F.lit(n.release_bq / (episode_hours * 1000.0)) * (dry + wet) * decay_factor(F.col("travel_s"), n.half_life_s)


def with_deposits(met: DataFrame, physics: Physics, episode_hours: int = 72) -> DataFrame:
    """One deposit column per nuclide (dep0, dep1, ...): the geometry of a hit is shared."""
    return met.withColumns({f"dep{i}": _deposit(n, episode_hours) for i, n in enumerate(physics.nuclides)})


def by_nuclide(df: DataFrame, physics: Physics, measures: tuple[str, ...] = ("dep",)) -> DataFrame:
    """Rows per nuclide from columns per nuclide."""
    parts = F.array(*[F.struct(F.lit(n.name).alias("nuclide"), *[F.col(f"{m}{i}").alias(m) for m in measures])
                      for i, n in enumerate(physics.nuclides)])
    wide = {f"{m}{i}" for m in measures for i in range(len(physics.nuclides))}
    return df.select(*[c for c in df.columns if c not in wide], F.inline(parts))


def hourly_deposits(met: DataFrame, physics: Physics, episode_hours: int = 72) -> DataFrame:
    """Deposits per hit and nuclide as rows."""
    return by_nuclide(with_deposits(met, physics, episode_hours), physics)


def unit_deposition(met: DataFrame, physics: Physics, episode_hours: int = 72, with_timing: bool = True) -> DataFrame:
    """Per receptor and scenario, columns per nuclide: the deposit summed over the episode and, with
    timing, the first hour above the floor and the deposit by wind sector relative to the sector
    straight upwind (s0_ and on, from -reach to +reach).

    The plume edge keeps every contributing wind within ``sector_reach`` of straight upwind, so these
    sums hold all sectors. Hours lie by (site, episode), so the sum needs no shuffle.
    """
    reach = sector_reach(physics)
    rows = with_deposits(met, physics, episode_hours)
    turn = F.pmod(F.col("sector") - F.col("upwind_sector") + F.lit(reach), F.lit(physics.sectors))   # 0..2 * reach
    figures = []
    for i in range(len(physics.nuclides)):
        dep = F.col(f"dep{i}")
        figures.append(F.sum(dep).alias(f"dep{i}"))
        if with_timing:
            figures.append(F.min(F.when(dep > physics.arrival_floor, F.col("hour_in_episode"))).alias(f"arrival_h{i}"))
            figures += [F.sum(F.when(turn == k, dep).otherwise(0.0)).alias(f"s{k}_{i}") for k in range(2 * reach + 1)]
    if with_timing:
        figures.append(F.min("upwind_sector").alias("upwind_sector"))
    return rows.groupBy("site_no", "episode_id", "variant_id", "receptor_id").agg(*figures)


def scenario_rows(deps: DataFrame, physics: Physics) -> DataFrame:
    """``unit_deposition`` with one row per nuclide."""
    timing = ("arrival_h", *[f"s{k}_" for k in range(2 * sector_reach(physics) + 1)]) if "arrival_h0" in deps.columns else ()
    return by_nuclide(deps, physics, ("dep", *timing))


def concentrations(met: DataFrame) -> DataFrame:
    """Hourly unit concentration per receptor, for a single episode that is kept hour by hour."""
    return met.select(*RECEPTOR, *SCENARIO, "hour_no", F.col("air").alias("concentration"))


def mass_balance(weather: DataFrame, physics: Physics, distance_m: float = 5000.0, half_steps: int = 20) -> DataFrame:
    """Relative error of the plume flux through a plane downwind against the released rate, per hour.

    The flux is summed over a lattice of the plane. The two directions of the sum separate,
    so it is two short sums within the row.
    """
    u = F.greatest(wind_at_height(F.col("wind_speed_10m"), F.col("wind_speed_100m"), physics.release_height_m),
                   F.lit(physics.min_wind))
    cls = stability_class(F.col("wind_speed_10m"), F.col("shortwave_radiation"), F.col("cloud_cover"))
    df = weather.withColumn("u", u).withColumn("stability", cls)
    x, h = F.lit(distance_m), physics.release_height_m
    df = df.withColumn("s_y", plume.sigma_y(F.col("stability"), x)).withColumn(
        "s_z", plume.sigma_z(F.col("stability"), x, physics.mixing_height_m))
    dy, dz = F.col("s_y") * F.lit(5.0 / half_steps), (F.col("s_z") * F.lit(5.0) + F.lit(h)) / F.lit(2.0 * half_steps)

    def across(i: Column) -> Column:
        y = i * dy
        return F.exp(-(y * y) / (F.lit(2.0) * F.col("s_y") * F.col("s_y"))) * dy

    def upward(i: Column) -> Column:
        z = (i + F.lit(0.5)) * dz
        two_s2 = F.lit(2.0) * F.col("s_z") * F.col("s_z")
        return (F.exp(-((z - F.lit(h)) * (z - F.lit(h))) / two_s2)
                + F.exp(-((z + F.lit(h)) * (z + F.lit(h))) / two_s2)) * dz

    def total(values: Column, term) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, i: acc + term(i))

    flux = (total(F.sequence(F.lit(-half_steps), F.lit(half_steps)), across)
            * total(F.sequence(F.lit(0), F.lit(2 * half_steps - 1)), upward)
            / (F.lit(2 * math.pi) * F.col("s_y") * F.col("s_z")))
    return df.withColumn("flux_share", flux).withColumn("balance_error", F.abs(F.col("flux_share") - F.lit(1.0)))
