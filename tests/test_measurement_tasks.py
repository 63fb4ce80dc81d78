from __future__ import annotations

import contextlib
import io

from leeward.plans import validation_queries as plans
from leeward.sources.fixtures import Tables


def test_tasks_grow_with_the_tables():
    assert plans.tasks_for(1000, 1000, 24) == 24
    for n in (1, 10):
        assert n * 100_000_000 / plans.tasks_for(n * 100_000_000, 1000, 24) <= plans.SAMPLES_PER_TASK
        assert n * 10_000_000 / plans.tasks_for(1000, n * 10_000_000, 24) <= plans.model_band.PHYSICS.receptors_per_task


def test_hits_of_the_first_episode_are_not_shuffled(spark):
    """More cells than are broadcast: they stay in their tasks, hours come to them. Before, hits were dealt out by bin and salt."""
    physics = plans.model_band.PHYSICS
    plans.model_band.PHYSICS = type(physics)(broadcast_receptors=1)
    try:
        shown = io.StringIO()
        with contextlib.redirect_stdout(shown):
            plans.observed(Tables(spark, "/root/testdata/sf0.001")).explain()
    finally:
        plans.model_band.PHYSICS = physics
    plan = shown.getvalue()
    assert "salt" not in plan and not any("Exchange hashpartitioning" in line and "variant_id" in line for line in plan.splitlines())
