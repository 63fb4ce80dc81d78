"""Dose rate from hourly deposits: decay-weighted running sums over slices, zero hours, bands."""

import pytest
from pyspark.sql import functions as F

from leeward.config import NUCLIDES, Physics
from leeward.operators import dose

PHYSICS = Physics()


def plain(fell, n_hours):
    """{(receptor, variant, hour): dose rate} hour by hour."""
    out = {}
    for receptor in (1, 2):
        for variant in range(2):
            held = [0.0, 0.0]
            for h in range(n_hours):
                for i, n in enumerate(NUCLIDES):
                    held[i] = held[i] * dose.hourly_decay(n) + sum(f[3 + i] for f in fell if f[:3] == (receptor, variant, h))
                out[receptor, variant, h] = sum(dose.usv_h_per_kbq_m2(n) * a for n, a in zip(NUCLIDES, held))
    return out


@pytest.mark.parametrize("slice_hours", [1, 5, 24, 200])
def test_running_sum_is_the_same_in_any_slices(spark, slice_hours):
    fell = [(1, 0, 0, 5.0, 1.0), (1, 0, 3, 2.0, 0.5), (1, 0, 47, 9.0, 3.0), (1, 1, 24, 1.0, 1.0), (2, 1, 71, 4.0, 2.0)]
    deposits = spark.createDataFrame([(0, *f) for f in fell], "site_no long, receptor_id long, variant_id long, hour_in_episode long, dep0 double, dep1 double")
    receptors = spark.createDataFrame([(0, 1), (0, 2)], "site_no long, receptor_id long")
    found = dose.ground_dose_rate(deposits, receptors, 100, 2, PHYSICS, slice_hours).collect()
    got = {(r.receptor_id, r.variant_id, r.hour_no): r.dose_usv_h for r in found}
    assert len(found) == len(got) and got == pytest.approx(plain(fell, 100), rel=1e-12)


def test_a_year_of_dose_is_the_annual_factor():
    for n in NUCLIDES:
        total = sum(dose.usv_h_per_kbq_m2(n) * dose.hourly_decay(n) ** (h + 0.5) for h in range(8766))
        assert total == pytest.approx(n.msv_per_kbq_m2 * 1000.0, rel=1e-3)


def test_band_counts_variants_without_deposit(spark):
    deposits = spark.createDataFrame([(0, 1, 0, 5, 2.0), (0, 1, 0, 6, 1.0), (0, 1, 1, 5, 1.0)], "site_no long, receptor_id long, variant_id long, hour_in_episode long, dep0 double")
    row = dose.deposition_band(deposits, "dep0", 5).first()
    assert (row.median, row.p05) == (0.0, 0.0) and row.p95 == pytest.approx(1.0 + 0.8 * 2.0)
    band = spark.createDataFrame([(1.0, 0.0, 2.0)], "median double, p05 double, p95 double")
    wide = dose.with_measurement_spread(band, 0.05, 0.5, 2.0).first()
    assert (wide.median, wide.p05, wide.p95) == (1.0, 0.025, 4.1)


def test_no_deposits_give_a_band_of_zeros(spark):
    none = spark.createDataFrame([], "site_no long, receptor_id long, variant_id long, hour_in_episode long, dep0 double, dep1 double")
    receptors = spark.createDataFrame([(0, 1)], "site_no long, receptor_id long")
    band = dose.hourly_band(dose.ground_dose_rate(none, receptors, 30, 3, PHYSICS))
    assert band.count() == 30 and band.where("median = 0 and p05 = 0 and p95 = 0").count() == 30
    assert band.agg(F.max("hour_no")).first()[0] == 29
