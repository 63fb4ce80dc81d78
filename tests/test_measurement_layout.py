from __future__ import annotations

import contextlib
import io

from pyspark.sql import functions as F

from leeward.plans import exposure_queries, validation_queries as plans
from leeward.sources.fixtures import Tables

SF = "/root/testdata/sf0.001"


def exchanges(df) -> list[str]:
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain()
    return [line for line in shown.getvalue().splitlines() if "Exchange hashpartitioning" in line]


def test_only_keys_of_cells_are_shuffled(spark):
    """Before, a task that reads the parts unfolded them to the sites and held all of that for its shuffle."""
    t = Tables(spark, SF)
    for df in (plans.observed(t), exposure_queries.risk_map_hourly(t)):
        found = exchanges(df)
        assert any("p_partkey" in line for line in found)
        assert not any("receptor_id" in line and "nuclide" not in line for line in found)
    assert not any("site_no" in line and "cell_id" in line for line in exchanges(plans.observed(t)))


class OffGrid(Tables):
    def measurements(self):
        return super().measurements().withColumn("lat", F.col("lat") + F.when(F.col("l_orderkey") % 2 == 0, 10.0).otherwise(0.0))


def test_measurements_off_the_grid_are_dealt_out(spark):
    """Before, those of a site met in one task."""
    points = plans.observed(OffGrid(spark, SF)).withColumn("task", F.spark_partition_id())
    on, off = points.filter("l_orderkey % 2 = 1"), points.filter("l_orderkey % 2 = 0")
    assert on.filter("cell_id is null or pred is null or p05 is null or p95 is null or x_m is null").count() == 0
    assert off.filter("cell_id is not null or pred is not null or x_m is not null").count() == 0
    per_task = [row["count"] for row in off.groupBy("task").count().collect()]
    assert len(per_task) > 12 and max(per_task) < 0.2 * sum(per_task)


def test_cells_that_are_not_there_have_no_band(spark):
    class Fewer(Tables):
        def grid(self, tasks=None):
            return super().grid(tasks).filter("cell_id % 2 = 0")

    points = plans.observed(Fewer(spark, SF))
    assert points.filter("(cell_id % 2 = 0) != (pred is not null)").count() == 0
