"""Scenario space: seeded episodes, physical variants and source samples."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from leeward.functions.sampling import lognormal, uniform


def site_hours(weather: DataFrame) -> DataFrame:
    """Hours of weather per site. A merged maximum."""
    return weather.groupBy("site_no").agg((F.max("hour_no") + 1).alias("n_hours"))


def draw_episodes(sites: DataFrame, n: int | Column, seed: int = 42, hours: int = 72) -> DataFrame:
    """Seeded random release starts per site: (site_no, episode_id, start_hour).

    ``sites`` has (site_no, n_hours). Sites with less than one episode of weather get none.
    """
    n = n if isinstance(n, Column) else F.lit(n)
    n = n.cast("long")
    usable = sites.filter((F.col("n_hours") >= hours) & (n > 0))
    rows = usable.withColumn("episode_id", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    u = uniform(seed, F.col("site_no"), F.col("episode_id"))
    start = F.floor(u * (F.col("n_hours") - hours + 1)).cast("long")
    return rows.select("site_no", "episode_id", start.alias("start_hour"))


def consecutive_episodes(sites: DataFrame, hours: int = 72) -> DataFrame:
    """Back-to-back episodes that use every hour once: the exhaustive climatology."""
    n = F.floor(F.col("n_hours") / hours).cast("long")
    rows = sites.filter(n > 0).withColumn("episode_id", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return rows.select("site_no", "episode_id", (F.col("episode_id") * hours).alias("start_hour"))


def variants(n: int, seed: int = 42, sigma: float = 0.5) -> Column:
    """Array of physical variants: (variant_id, class_shift, dep_factor).

    The number of variants is a setting, so the array is bounded; explode it onto hours.
    """
    one = [F.struct(F.lit(i).cast("long").alias("variant_id"),
                    (F.floor(uniform(f"{seed}v", F.lit(i)) * 3) - 1).cast("long").alias("class_shift"),
                    lognormal(f"{seed}d", sigma, F.lit(i)).alias("dep_factor")) for i in range(n)]
    return F.array(*one)


def draw_variants(episodes: DataFrame, n: int, seed: int = 42, sigma: float = 0.5) -> DataFrame:
    """Episodes times variants: the rows of the scenario space."""
    return episodes.select("*", F.inline(variants(n, seed, sigma)))


def draw_q(n: int, low: float = 0.3, high: float = 3.0, seed: int = 42) -> list[float]:
    """Sorted source multipliers, log-uniform between low and high. A setting-sized list.

    Deposition is linear in the released amount, so these multiply results instead of rows.
    """
    def u(i: int) -> float:
        return int(hashlib.md5(f"{seed}q-{i}".encode()).hexdigest()[:8], 16) / 4294967296.0
    return sorted(low * (high / low) ** u(i) for i in range(n))


def episode_weather(episodes: DataFrame, weather: DataFrame, hours: int = 72) -> DataFrame:
    """Hours of each episode.

    The record is cut into blocks of an episode's length, of which an episode touches two at most; both sides meet by block, and only then
    does an episode become hours. Unfolded ahead of the join it would be taken for as small as the draw and be broadcast whole. The touched blocks
    are dealt out first, as the draw stands in as many tasks as there are sites, and so that their size is known.
    """
    first, last = (F.floor(h / hours).cast("long") for h in (F.col("start_hour"), F.col("start_hour") + hours - 1))
    touched = episodes.withColumn("block", F.explode(F.sequence(first, last))).repartition("site_no", "block")
    met = touched.join(weather.withColumn("block", F.floor(F.col("hour_no") / hours).cast("long")), ["site_no", "block"])
    met = met.withColumn("hour_in_episode", (F.col("hour_no") - F.col("start_hour")).cast("int")).filter(F.col("hour_in_episode").between(0, hours - 1))
    rest = [c for c in weather.columns if c not in ("site_no", "hour_no")]
    return met.select("site_no", "hour_no", *[c for c in episodes.columns if c != "site_no"], "hour_in_episode", *rest)
