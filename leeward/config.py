"""Run, physics, threshold and data-quality settings.

Every operator takes its settings as an argument; nothing reads a global. The numbers the
specification fixes stand here as plain values.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Limits:
    """Data-quality limits of the sensor path (fixed values)."""

    max_lag_minutes: float = 15.0
    dedup_watermark_minutes: int = 15
    wind_min: float = 0.0
    wind_max: float = 45.0
    wind_max_step: float = 25.0
    dose_min: float = 0.0
    dose_max: float = 1000.0
    background_usv_h: float = 0.05
    drift_window_minutes: int = 30
    drift_threshold: float = 0.2
    neighbour_km: float = 5.0
    warmup_minutes: int = 10
    frozen_repeats: int = 10
    stable_repeats: int = 3
    gap_minutes: float = 5.0
    path_tolerance_s: int = 5
    unit_ratio_low: float = 2.5
    unit_ratio_high: float = 5.0
    outlier_sigmas: float = 3.0
    bad_run: int = 3
    good_run: int = 5
    batch_wind_max: float = 120.0
    # Width of the time slices that windowed rules run in. A slice is one window partition, so
    # a device that holds a third of all readings still spreads over (time span / slice) tasks.
    slice_seconds: int = 6 * 3600


@dataclass(frozen=True)
class Nuclide:
    """Transport constants of one nuclide.

    Half-lives are the tabulated physical ones. Deposition velocity, scavenging power law and
    the deposit-to-annual-dose factor are generic screening values, meant to be set per study.
    """

    name: str
    half_life_s: float
    deposition_velocity: float
    scavenging_a: float
    scavenging_b: float
    msv_per_kbq_m2: float
    release_bq: float


@dataclass(frozen=True)
class Threshold:
    threshold_id: str
    measure: str          # "deposition" in kBq/m2, or "annual_dose" in mSv
    value: float
    nuclide: str | None   # None: applies to every nuclide


# Contamination thresholds.
THRESHOLDS = (
    Threshold("contaminated", "deposition", 37.0, "Cs-137"),
    Threshold("strict_control", "deposition", 555.0, "Cs-137"),
    Threshold("public_limit", "annual_dose", 1.0, None),
    Threshold("evacuation", "annual_dose", 20.0, None),
)

NUCLIDES = (
    Nuclide("Cs-137", 30.08 * 365.25 * 86400, 0.002, 8e-5, 0.8, 0.02, 1e16),
    Nuclide("I-131", 8.0252 * 86400, 0.01, 8e-5, 0.8, 0.001, 5e15),
)


@dataclass(frozen=True)
class Run:
    """Size of a scenario run (fixed default values)."""

    mode: str = "climatology"
    episode_hours: int = 72
    n_episodes: int = 200
    n_variants: int = 5
    n_source_samples: int = 200
    grid_size: int = 60
    cell_km: float = 4.0
    max_km: float = 100.0
    seed: int = 42
    model_version: str = "1"


@dataclass(frozen=True)
class Physics:
    release_height_m: float = 20.0
    min_wind: float = 0.5
    mixing_height_m: float = 1500.0
    # Crosswind offsets beyond this many sigma_y are not computed. The factor left there is below 1.3e-14: times the largest
    # axis deposit of an hour (under 2e7 kBq/m2 from 100 m on, in rain), 72 hours and the largest source multiple (3)
    # that is under 6e-5, far less than half of the last printed digit (0.001).
    edge_sigmas: float = 8.0
    bearing_bin_deg: int = 10         # width of the equi-join bins over plume direction
    nearest_m: float = 100.0          # the curves do not hold closer to the source
    arrival_floor: float = 1e-3       # kBq/m2 in one hour
    sectors: int = 16
    nuclides: tuple[Nuclide, ...] = NUCLIDES
    # Largest receptor table that is broadcast; a larger one is joined by shuffle.
    broadcast_receptors: int = 200_000
    # Receptors of one task where the hours of one episode come to them.
    receptors_per_task: int = 20_000
    # Hours of one tile of the block layout beyond which the episodes of a site are cut into more blocks.
    tile_hours: int = 1_000_000
    # Hours of a site beyond which percentiles are narrowed down by counts (two passes), so that no task holds all scenarios of a receptor.
    whole_hours: int = 4_000_000
    # Largest number of scenarios per receptor that one task sorts; above it the
    # histogram-refinement percentile is used.
    ranked_scenarios: int = 1_000_000


@dataclass(frozen=True)
class Settings:
    limits: Limits = field(default_factory=Limits)
    run: Run = field(default_factory=Run)
    physics: Physics = field(default_factory=Physics)
    thresholds: tuple[Threshold, ...] = THRESHOLDS


# The two deployment sizes, which differ in variables only.
DEV = Run(grid_size=50, cell_km=4.0, n_episodes=20, n_variants=3)
PROD = Run(grid_size=100, cell_km=2.0, n_episodes=200, n_variants=5)


def _pick(cls, values: dict):
    known = {f.name for f in fields(cls)}
    unknown = set(values) - known
    if unknown:
        raise ValueError(f"unknown {cls.__name__} settings: {sorted(unknown)}")
    return values


def load_settings(path: str) -> Settings:
    """Settings from a YAML file with optional ``limits``, ``run``, ``physics`` and ``thresholds`` parts."""
    try:
        import yaml
    except ImportError as exc:  # pragma: no cover
        raise RuntimeError("reading settings from YAML needs PyYAML") from exc
    with open(path, encoding="utf-8") as handle:
        raw = yaml.safe_load(handle) or {}
    base = Settings()
    thresholds = tuple(Threshold(**_pick(Threshold, t)) for t in raw.get("thresholds", [])) or base.thresholds
    return Settings(
        limits=replace(base.limits, **_pick(Limits, raw.get("limits", {}))),
        run=replace(base.run, **_pick(Run, raw.get("run", {}))),
        physics=replace(base.physics, **_pick(Physics, raw.get("physics", {}))),
        thresholds=thresholds,
    )
