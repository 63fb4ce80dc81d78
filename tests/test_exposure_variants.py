from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leeward.operators import scenarios as space
from leeward.operators.dispersion import release_hours
from leeward.plans import exposure_queries as plans
from leeward.plans.catalog import all_queries
from leeward.sources.fixtures import Tables

NAMES = ["city_exposure", "risk_map", "exceedance", "unit_deposition", "arrival", "worst_sector", "site_ranking",
         "top_cities", "risk_rose", "risk_map_hourly"]


def test_plans_run_all_five_variants(spark):
    clim = plans.clim(Tables(spark, "/root/testdata/sf0.001"))
    drawn = clim.hours.groupBy("site_no").agg(F.countDistinct("episode_id").alias("n"))
    found = clim.scenarios.join(drawn, "site_no").collect()
    assert found and all(r.n_scenarios == 5 * r.n for r in found)
    met = release_hours(clim.hours, clim.physics, clim.run.n_variants, clim.run.seed)
    assert {r[0] for r in met.select("variant_id").distinct().collect()} == set(range(5))


@pytest.mark.parametrize("name", NAMES)
def test_sql_twins_state_five_variants(name):
    sql = all_queries()[name].sql
    assert "range(5)" in sql and "count(*) * 5 as n_scenarios" in sql


def _nodes(plan):
    """All nodes of an executed plan, those of adaptive stages too."""
    yield plan
    kind = plan.getClass().getSimpleName()
    children = [plan.finalPhysicalPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [
        plan.children().apply(i) for i in range(plan.children().size())]
    for child in children:
        yield from _nodes(child)


def test_unfolded_episodes_are_never_broadcast(spark):
    weather = spark.range(144_000).selectExpr("id % 2 as site_no", "cast(floor(id / 2) as bigint) as hour_no", "cast(id % 7 as double) as wind")
    episodes = space.draw_episodes(space.site_hours(weather), F.floor(F.col("n_hours") / 72)).localCheckpoint()
    out = space.episode_weather(space.draw_episodes(space.site_hours(weather), F.floor(F.col("n_hours") / 72)), weather)
    kept = out.collect()
    sent = [n.metrics().apply("numOutputRows").value() for n in _nodes(out._jdf.queryExecution().executedPlan()) if n.nodeName().startswith("BroadcastExchange")]
    assert all(rows <= 2 * 2000 for rows in sent)                 # two blocks an episode; unfolded they are 144,000
    starts = {(r.site_no, r.episode_id): r.start_hour for r in episodes.collect()}
    assert len(starts) == 2000 and len(kept) == 144_000
    assert {(r.site_no, r.episode_id, r.hour_no, r.hour_in_episode, r.wind) for r in kept} == {
        (s, e, start + h, h, float((2 * (start + h) + s) % 7)) for (s, e), start in starts.items() for h in range(72)}
