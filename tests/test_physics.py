"""Plume, weather and scenario operators against analytic values and brute force."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from support import rows
from dataclasses import replace

from leeward.config import THRESHOLDS, Physics, Run, Settings
from leeward.functions import geo, plume, weather
from leeward.operators import dispersion, geometry, gold, quantiles, scenarios as space
from leeward.plans import batch


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_axis_and_lateral_value(spark):
    args = dict(wind=F.lit(4.0), s_y=F.lit(100.0), s_z=F.lit(50.0), height=20.0)
    axis = value(spark, plume.ground_concentration(F.lit(0.0), **args))
    assert math.isclose(axis, math.exp(-400 / 5000) / (math.pi * 4 * 100 * 50), rel_tol=1e-12)
    side = value(spark, plume.ground_concentration(F.lit(150.0), **args))
    assert math.isclose(side / axis, math.exp(-150 ** 2 / 20000), rel_tol=1e-12)


def test_spread_curves(spark):
    assert math.isclose(value(spark, plume.sigma_y(F.lit("D"), F.lit(1000.0))), 80 / math.sqrt(1.1), rel_tol=1e-12)
    assert math.isclose(value(spark, plume.sigma_z(F.lit("F"), F.lit(1000.0), 1500)), 16 / 1.3, rel_tol=1e-12)
    assert value(spark, plume.sigma_z(F.lit("A"), F.lit(50000.0), 1500)) == 1500
    for c in "ABCDEF":
        cols = plume.curve_columns(F.lit(c))
        z = plume.sigma_z_of(cols["az"], cols["fz"], cols["z_linear"], F.lit(7000.0), 1500)
        assert math.isclose(value(spark, z), value(spark, plume.sigma_z(F.lit(c), F.lit(7000.0), 1500)), rel_tol=1e-12)
        assert math.isclose(value(spark, plume.sigma_y_of(cols["ay"], F.lit(7000.0))),
                            value(spark, plume.sigma_y(F.lit(c), F.lit(7000.0))), rel_tol=1e-12)


def hours(spark, n=400, sites=2):
    return spark.range(n * sites).select(
        (F.col("id") % sites).alias("site_no"), F.floor(F.col("id") / sites).alias("hour_no"),
        (1.0 + F.col("id") * 37 % 90 / 10).alias("wind_speed_10m"), (F.col("id") * 53 % 360).alias("wind_direction_10m"),
        (1.4 + F.col("id") * 37 % 90 / 9).alias("wind_speed_100m"), (F.col("id") * 53 % 360).alias("wind_direction_100m"),
        F.when(F.col("id") % 5 == 0, 1.5).otherwise(0.0).alias("precipitation"), (F.col("id") * 7 % 101).alias("cloud_cover"),
        F.greatest(F.lit(0), 900 - 150 * F.abs(F.floor(F.col("id") / sites) % 24 - 12)).alias("shortwave_radiation"))


def test_mass_balance(spark):
    out = dispersion.mass_balance(hours(spark), Physics())
    assert out.agg(F.max("balance_error")).first()[0] < 0.05


def test_wind_direction(spark):
    u = lambda d: value(spark, weather.wind_u(F.lit(3.0), F.lit(d)))
    v = lambda d: value(spark, weather.wind_v(F.lit(3.0), F.lit(d)))
    assert u(270) > 2.99 and abs(v(270)) < 1e-9          # west wind: plume goes east
    assert v(0) < -2.99 and abs(u(0)) < 1e-9             # north wind: plume goes south
    assert value(spark, weather.plume_direction(F.lit(311))) == 131


def test_stability_by_day_and_night(spark):
    def cls(u, r, c):
        return value(spark, weather.stability_class(F.lit(u), F.lit(r), F.lit(c)))
    assert [cls(1.5, 950.0, 0), cls(2.5, 700.0, 0), cls(4.0, 200.0, 0), cls(6.0, 700.0, 0)] == ["A", "B", "C", "D"]
    assert [cls(1.5, 0.0, 80), cls(1.5, 0.0, 10), cls(4.0, 0.0, 10), cls(7.0, 0.0, 10)] == ["E", "F", "E", "D"]


def test_wind_profile_hits_both_heights(spark):
    for height, want in ((10.0, 4.0), (100.0, 7.0)):
        assert math.isclose(value(spark, weather.wind_at_height(F.lit(4.0), F.lit(7.0), height)), want)
    assert value(spark, weather.wind_at_height(F.lit(0.0), F.lit(7.0), 50.0)) == 0.0


def test_geodesy(spark):
    assert math.isclose(value(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))), 111.19492664, rel_tol=1e-9)
    assert math.isclose(value(spark, geo.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))), 90.0)
    assert value(spark, geo.sector_of(F.lit(354.0))) == 0 and value(spark, geo.sector_of(F.lit(11.3))) == 1
    lon, lat = geo.mollweide_to_lonlat(F.lit(0.0), F.lit(0.0))
    assert value(spark, lon) == 0 and value(spark, lat) == 0


def test_radius_join_wraps_and_matches_brute_force(spark):
    a = spark.createDataFrame([(1, 10.0, 179.9), (2, 84.0, -30.0), (3, -45.0, 0.0), (4, 10.5, -179.5)], "a long, lat double, lon double")
    b = spark.createDataFrame([(i, -60 + (i * 37 % 1480) / 10.0, -180 + (i * 91 % 3600) / 10.0) for i in range(4000)],
                              "b long, lat2 double, lon2 double")
    got = rows(geometry.within_radius(a, b, ("lat", "lon"), ("lat2", "lon2"), 400.0), "a", "b")
    far = a.join(b, geo.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= 400.0)
    want = rows(far, "a", "b")
    assert got == want and len(want) > 10 and len({r[0] for r in want}) == 4


def test_draws_do_not_depend_on_layout(spark):
    sites = spark.createDataFrame([(0, 1000), (1, 5000), (2, 10)], "site_no long, n_hours long")
    one = rows(space.draw_episodes(sites, 50, 7), "site_no", "episode_id", "start_hour")
    two = rows(space.draw_episodes(sites.repartition(7), 50, 7), "site_no", "episode_id", "start_hour")
    assert one == two and len(one) == 100
    assert all(0 <= r[2] <= (1000 if r[0] == 0 else 5000) - 72 for r in one)
    assert one != rows(space.draw_episodes(sites, 50, 8), "site_no", "episode_id", "start_hour")
    q = space.draw_q(200)
    assert q == sorted(q) and q == space.draw_q(200) and 0.3 <= q[0] and q[-1] <= 3.0
    assert rows(space.consecutive_episodes(sites), "site_no", "episode_id", "start_hour")[1] == (0, 1, 72)


def receptors(spark, n=60):
    return spark.range(n).select((F.col("id") % 2).alias("site_no"), F.col("id").alias("receptor_id"),
                                 (F.sin(F.col("id") * 1.7) * (2000 + F.col("id") * 900)).alias("x_m"),
                                 (F.cos(F.col("id") * 1.7) * (2000 + F.col("id") * 900)).alias("y_m"))


RUN = Run(n_episodes=12, n_variants=2)


def climate(spark, physics=Physics()):
    return batch.climatology(hours(spark), RUN, physics)


def test_shuffled_join_equals_broadcast_and_brute_force(spark):
    c, rec = climate(spark), receptors(spark)
    met = dispersion.release_hours(c.hours, c.physics, 2, 42)
    small = dispersion.hits(met, rec, c.physics)
    large = dispersion.hits(met, rec, replace(c.physics, broadcast_receptors=0))
    key = ["site_no", "receptor_id", "episode_id", "variant_id", "hour_in_episode"]
    assert rows(small, *key) == rows(large, *key)
    pairs = met.join(rec, "site_no")
    x = F.col("x_m") * F.col("sin_t") + F.col("y_m") * F.col("cos_t")
    y = F.col("x_m") * F.col("cos_t") - F.col("y_m") * F.col("sin_t")
    brute = pairs.withColumn("x", x).withColumn("y", y).filter("x >= 100").withColumn("s", plume.sigma_y(F.col("stability"), F.col("x")))
    assert rows(brute.filter(f"abs(y) <= {c.physics.edge_sigmas} * s"), *key) == rows(small, *key)


def test_edge_of_the_plume_changes_no_printed_digit(spark):
    c, rec = climate(spark), receptors(spark)
    met = dispersion.release_hours(c.hours, c.physics, 2, 42)
    key = ["site_no", "receptor_id", "episode_id", "variant_id"]

    def totals(sigmas):
        physics = replace(c.physics, edge_sigmas=sigmas)
        deps = dispersion.unit_deposition(dispersion.hits(met, rec, physics), physics, with_timing=False)
        return {tuple(r[k] for k in key): (r.dep0, r.dep1) for r in deps.collect()}
    near, far = totals(c.physics.edge_sigmas), totals(13.0)
    assert set(near) <= set(far)
    for k, (a, b) in far.items():
        x, y = near.get(k, (0.0, 0.0))
        assert abs(a - x) < 2e-5 and abs(b - y) < 2e-5


def test_episode_sum_needs_no_shuffle_after_the_layout(spark):
    c, rec = climate(spark), receptors(spark)
    deps = dispersion.unit_deposition(dispersion.hits(dispersion.release_hours(c.hours, c.physics, 2, 42), rec, c.physics), c.physics)
    plan = deps._jdf.queryExecution().optimizedPlan().toString()
    physical = deps._jdf.queryExecution().executedPlan().toString()
    first = physical.index("REPARTITION_BY_NUM")
    assert "Repartition" in plan and "ENSURE_REQUIREMENTS" not in physical[:first]
    assert "Python" not in physical


def test_percentile_ways_agree(spark):
    data = [(k, float((i * 7919 + k) % 50) / 7 + (0.001 if i % 3 else 0), 300) for k in range(3) for i in range(1, 40 + 80 * k)]
    df = staged_df(spark.createDataFrame(data, "k long, v double, total long").filter("v > 0"))
    ps = {"a": 0.05, "b": 0.5, "c": 0.95, "d": 0.999}
    one = {r[0]: r[1:] for r in quantiles.percentiles_ranked(df, ["k"], "v", "total", ps).collect()}
    two = {r[0]: r[1:] for r in quantiles.percentiles_by_refinement(df, ["k"], "v", "total", ps, bins_per_e_fold=4).collect()}
    for k in range(3):
        values = sorted([r.v for r in df.filter(F.col("k") == k).collect()])
        full = [0.0] * (300 - len(values)) + values
        for i, p in enumerate(ps.values()):
            rank = p * 299
            low, high = full[math.floor(rank)], full[math.ceil(rank)]
            want = low + (high - low) * (rank - math.floor(rank))
            assert math.isclose(one[k][i], want, abs_tol=1e-12) and math.isclose(two[k][i], want, abs_tol=1e-12)


def staged_df(df):
    from leeward.session import staged
    return staged(df, "t")


def test_share_above_matches_counting(spark):
    for q in (space.draw_q(37), space.draw_q(200), [1.0], [1.0, 1.0, 1.0, 2.0], [0.5, 0.5000000001, 3.0]):
        deps = [0.0, 1e-300, 1.0, 12.4, 37.0, 80.0, 123.4, 1e6] + [37.0 / x * f for x in q for f in (1, 1 + 1e-15, 1 - 1e-15, 1.01)]
        deps += [37.0 / 3.5 * 1.013 ** i for i in range(200)]
        df = spark.createDataFrame([(d,) for d in deps], "d double")
        got = [r[1] for r in df.select("d", gold.share_above(F.col("d"), q, F.lit(37.0))).collect()]
        assert got == [sum(x * d > 37.0 for x in q) / len(q) for d in deps]


def test_exposure_ways_agree(spark):
    rec = receptors(spark)
    settings = Settings(run=RUN)
    a = batch.exposure_of(climate(spark), rec, settings, with_timing=True)
    b = batch.exposure_of(climate(spark, replace(Physics(), ranked_scenarios=1)), rec, settings, with_timing=True)
    cols = ["site_no", "receptor_id", "nuclide", "threshold_id", "p_exceed", "dep_p05", "dep_p50", "dep_p95", "arrival_h_p50", "worst_wind_sector"]
    fix = lambda df: rows(df.withColumns({c: F.round(c, 9) for c in cols[4:8]}), *cols)
    assert fix(a) == fix(b) and len(fix(a)) > 100


def test_thresholds_apply_to_their_nuclide(spark):
    df = spark.createDataFrame([("Cs-137",), ("I-131",)], "nuclide string")
    got = rows(gold.with_thresholds(df, THRESHOLDS, Physics()), "nuclide", "threshold_id")
    assert len(got) == 6 and ("I-131", "contaminated") not in got


def test_new_site_by_settings_only(spark):
    sites = spark.createDataFrame([(0, "S0", "X", 54.81, 17.83), (1, "S1", "X", 54.0, 18.0)],
                                  "site_no long, site_id string, jurisdiction_code string, lat double, lon double")
    cities = spark.createDataFrame([(1, "T", 54.7, 18.2, 1000), (2, "U", 56.9, 18.2, 9)], "city_id long, city_name string, lat double, lon double, population long")
    cells = geometry.grid(sites, 6, 20.0).withColumnRenamed("cell_id", "receptor_id")
    out = batch.run_batch(hours(spark), sites, cities, cells, Settings(run=RUN))
    exposed = out["gold_city_exposure"]
    from leeward import schemas
    assert [(f.name, f.dataType) for f in exposed.schema] == [(f.name, f.dataType) for f in schemas.CITY_EXPOSURE]
    assert rows(exposed.select("site_no", "city_id").distinct(), "site_no", "city_id") == [(0, 1), (1, 1)]
    assert exposed.filter("p_exceed < 0 or p_exceed > 1").count() == 0
    assert out["gold_site_ranking"].count() == 2
    assert out["gold_risk_map"].count() == 2 * 36 * 6


def test_grid_carries_its_crs(spark):
    sites = spark.createDataFrame([(0, 54.81, 17.83)], "site_no long, lat double, lon double")
    g = geometry.grid(sites, 10, 4.0)
    assert "crs" in g.schema["x_m"].metadata and g.count() == 100
    back = geometry.snap_to_cells(g.select("site_no", "lat", "lon", F.col("cell_id").alias("own")), sites, 10, 40000.0)
    assert back.filter("own <> cell_id or cell_id is null").count() == 0
