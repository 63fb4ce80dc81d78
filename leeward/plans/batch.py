"""Batch path: weather to scenarios, plumes, and the gold tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from leeward.config import Physics, Run, Settings
from leeward.operators import at_receptors, dispersion, gold, scenarios as space
from leeward.operators.geometry import site_cities
from leeward.session import staged


@dataclass(frozen=True)
class Climatology:
    """Hours of all drawn episodes, and the number of scenarios per site."""

    hours: DataFrame
    scenarios: DataFrame
    run: Run
    physics: Physics

    def most_scenarios(self) -> int:
        row = self.scenarios.agg(F.max("n_scenarios")).first()   # one row per site goes in
        return row[0] or 0


def climatology(weather: DataFrame, run: Run, physics: Physics, n_episodes: int | Column | None = None) -> Climatology:
    """``n_episodes`` may be a column over ``n_hours``, so that the draw grows with the weather record."""
    sites = space.site_hours(weather)
    n = run.n_episodes if n_episodes is None else n_episodes
    episodes = space.draw_episodes(sites, n, run.seed, run.episode_hours)
    hours = space.episode_weather(episodes, weather, run.episode_hours)
    counts = episodes.groupBy("site_no").agg((F.count(F.lit(1)) * run.n_variants).alias("n_scenarios"))
    return Climatology(hours, counts, run, physics)


def plume_hits(clim: Climatology, receptors: DataFrame, few_hours: bool = False, laid_out: bool = False) -> DataFrame:
    met = dispersion.release_hours(clim.hours, clim.physics, clim.run.n_variants, clim.run.seed)
    return dispersion.hits(met, receptors, clim.physics, few_hours=few_hours, laid_out=laid_out)


def deposits(clim: Climatology, receptors: DataFrame, few_hours: bool = False, laid_out: bool = False) -> DataFrame:
    """Hourly deposits of every plume at the receptors it reaches."""
    return dispersion.hourly_deposits(plume_hits(clim, receptors, few_hours, laid_out), clim.physics, clim.run.episode_hours)


def scenario_deposits(clim: Climatology, receptors: DataFrame, with_timing: bool) -> DataFrame:
    return dispersion.unit_deposition(plume_hits(clim, receptors), clim.physics, clim.run.episode_hours, with_timing)


def as_receptors(cities: DataFrame) -> DataFrame:
    return cities.select("site_no", F.col("city_id").alias("receptor_id"), "x_m", "y_m")


def exposure_of(clim: Climatology, receptors: DataFrame, settings: Settings, with_timing: bool, figures=at_receptors.receptor_figures) -> DataFrame:
    q = space.draw_q(clim.run.n_source_samples, seed=clim.run.seed)
    if clim.most_scenarios() <= clim.physics.ranked_scenarios:
        return gold.exposure_at(clim.hours, receptors, clim.scenarios, q, settings.thresholds, clim.physics, clim.run, with_timing, figures=figures)
    deps = staged(scenario_deposits(clim, receptors, with_timing), "deposition")   # the refinement reads it more than once
    return gold.exposure(deps, clim.scenarios, q, settings.thresholds, clim.physics, with_timing, ranked=False)


def exceedance_of(clim: Climatology, cities: DataFrame, settings: Settings) -> DataFrame:
    """``p_exceed`` of the cities that any hour reached. Counts only, so any number of scenarios will do."""
    q = space.draw_q(clim.run.n_source_samples, seed=clim.run.seed)
    return gold.exposure_at(clim.hours, as_receptors(cities), clim.scenarios, q, settings.thresholds, clim.physics, clim.run, with_timing=False,
                            percentiles={}, figures=at_receptors.shared_figures)


def city_exceedance(clim: Climatology, cities: DataFrame, settings: Settings) -> DataFrame:
    """``p_exceed`` of every city, without percentiles, arrival and sector. ``cities`` comes from site_cities."""
    out = gold.completed(exceedance_of(clim, cities, settings), cities.withColumnRenamed("city_id", "receptor_id"), clim.scenarios, settings.thresholds, clim.physics)
    return out.withColumnRenamed("receptor_id", "city_id")


def city_figures(clim: Climatology, cities: DataFrame) -> DataFrame:
    """``figures`` of cities with timing."""
    return at_receptors.shared_figures(clim.hours, as_receptors(cities), clim.scenarios, clim.physics, clim.run, with_timing=True)


def figures(clim: Climatology, receptors: DataFrame, with_timing: bool = False) -> DataFrame:
    """Sums over the scenarios of each receptor, with timing arrivals and sectors too."""
    return at_receptors.receptor_figures(clim.hours, receptors, clim.scenarios, clim.physics, clim.run, with_timing=with_timing)


def city_exposure(clim: Climatology, sites: DataFrame, cities: DataFrame, settings: Settings) -> DataFrame:
    near = site_cities(sites, cities, clim.run.max_km)
    found = exposure_of(clim, as_receptors(near), settings, with_timing=True, figures=at_receptors.shared_figures)
    return gold.city_exposure(found, near, clim.scenarios, settings.thresholds, clim.physics, clim.run.model_version)


def risk_map(clim: Climatology, cells: DataFrame, settings: Settings) -> DataFrame:
    """``cells`` has (site_no, receptor_id, x_m, y_m)."""
    found = exposure_of(clim, cells, settings, with_timing=False)
    return gold.risk_map(found, cells, clim.scenarios, settings.thresholds, clim.physics)


def run_batch(weather: DataFrame, sites: DataFrame, cities: DataFrame, cells: DataFrame,
              settings: Settings = Settings()) -> dict[str, DataFrame]:
    """The gold tables of the batch path."""
    clim = climatology(weather, settings.run, settings.physics)
    exposed = staged(city_exposure(clim, sites, cities, settings), "city_exposure")
    return {"gold_city_exposure": exposed,
            "gold_risk_map": risk_map(clim, cells, settings),
            "gold_site_ranking": gold.site_ranking(exposed, "contaminated", "Cs-137")}
