"""Layouts that keep a task's share of the rows bounded."""

from __future__ import annotations

import math
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leeward.operators import dispersion, gold, scenarios as space
from leeward.plans import batch, exposure_queries as exposure
from leeward.plans import model_band, landing_queries as landing  # noqa: F401 (model_band enters v_band)
from leeward.sources.fixtures import Tables

SMALL = "/root/testdata/sf0.001"


def test_landing_is_written_by_every_task(spark):
    t = Tables(spark, SMALL)
    rows = t.cities().select("city_id", F.col("city_name").alias("name"), "aliases", "lat", "lon", "population").repartition(7)
    path = Path(landing.landed(t, rows, "city_id", "population").removesuffix("/delivery=*").removeprefix("file:"))
    assert sorted(d.name for d in path.glob("delivery=*")) == [f"delivery={n}" for n in range(landing.FILES)]
    assert all(len(list(d.glob("part-*"))) == 7 for d in path.glob("delivery=*"))


def test_samples_are_not_laid_out_by_their_four_sites(spark):
    plan = Tables(spark, SMALL).measurements()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_drawn_episodes_are_unfolded_in_many_tasks(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    episodes = space.draw_episodes(space.site_hours(t.weather()), F.floor(F.col("n_hours") / 72)).coalesce(1)
    plan = space.episode_weather(episodes, t.weather())._jdf.queryExecution().optimizedPlan().toString()
    tree = plan.splitlines()
    unfolded, dealt = (next(i for i, line in enumerate(tree) if word in line) for word in ("hour_in_episode", "RepartitionByExpression"))
    assert unfolded < dealt


def test_scenarios_of_a_receptor_never_become_rows(spark):
    """Sums, arrivals and sectors of the block layout are those of the rows per receptor and scenario, all around the site and next to it."""
    t = Tables(spark, "/root/testdata/sf0.001")
    c = exposure.clim(t)
    at = spark.createDataFrame([(s, 10 * k + s, float(r * math.sin(math.radians(a))), float(r * math.cos(math.radians(a)))) for s in range(4)
                                for k, (r, a) in enumerate([(50, 10), (101, 0), (3000, 0), (9000, 90), (20000, 359.9), (60000, 181), (140000, 270)])],
                               "site_no long, receptor_id long, x_m double, y_m double")
    found = batch.figures(c, at, with_timing=True)
    assert "variant_id" not in found._jdf.queryExecution().optimizedPlan().toString()
    deps = dispersion.scenario_rows(batch.scenario_deposits(c, at, True), c.physics)
    want = {(r.receptor_id, r.nuclide): r for r in deps.groupBy("receptor_id", "nuclide").agg(
        F.sum("dep").alias("total"), F.max("dep").alias("largest"), F.count_if(F.col("dep") > 0.001).alias("n_above"), F.count("arrival_h").alias("n_arrivals"),
        F.min("arrival_h").alias("first_h"), F.percentile("arrival_h", F.lit(0.5)).alias("arrival_h_p50"), gold.worst_sector_of(c.physics).alias("worst")).collect()}
    got = {(r.receptor_id, r.nuclide): r for r in found.withColumn("worst", gold.worst_of_sectors(F.col("by_sector"), c.physics)).collect()}
    assert got.keys() == want.keys() and len(got) > 40
    for key, w in want.items():
        g = got[key]
        assert (g.n_above, g.n_arrivals, g.first_h, g.arrival_h_p50, g.worst) == (w.n_above, w.n_arrivals, w.first_h, w.arrival_h_p50, w.worst)
        assert g.total == pytest.approx(w.total, rel=1e-9) and g.largest == pytest.approx(w.largest, rel=1e-9)
        assert sum(g.by_sector) == pytest.approx(w.total, rel=1e-9)


def test_hours_of_one_episode_come_to_the_receptors(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    c = exposure.clim(t)
    single = replace(c, hours=c.hours.filter("episode_id = 0"))
    at = exposure.cells(t)
    found = gold.risk_map_hourly(batch.deposits(single, at, few_hours=True), c.run.n_variants)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "nuclide" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
    want = gold.risk_map_hourly(batch.deposits(single, at), c.run.n_variants)
    assert found.count() == want.count() and found.exceptAll(want).count() == 0
