"""The specified sensor cases as literal frames, plus their boundaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from support import rows
from leeward.config import Limits
from leeward.operators import alerts, late, neighbours, quality, rules
from leeward.operators.health import device_health, health_events
from leeward.plans import monitoring
from leeward.session import staged

T0 = 1_300_060_800
COLS = "device_id string, cell_id long, ingestion_path string, e double, s double, dose_rate_usv_h double, wind_speed_ms double, battery double"


def frame(spark, data):
    df = spark.createDataFrame(data, COLS)
    stamp = lambda c: F.timestamp_micros((F.col(c) * 1_000_000).cast("long") + F.lit(T0 * 1_000_000))
    return df.withColumn("event_time", stamp("e")).withColumn("sent_at", stamp("s")).drop("e", "s").withColumn(
        "event_id", F.monotonically_increasing_id())


def reading(device="d1", at=0.0, lag=0.0, dose=0.1, wind=5.0, battery=80.0, path="wifi", cell=1):
    return (device, cell, path, float(at), float(at) + float(lag), dose, wind, battery)


def test_lag_limits(spark):
    df = frame(spark, [reading(lag=600), reading(lag=1200, at=1), reading(lag=899.999, at=2), reading(lag=900, at=3),
                       reading(lag=900.001, at=4)])
    on_time, behind = late.split_late(df)
    assert on_time.count() == 3 and behind.count() == 2


def test_every_row_gets_a_route(spark):
    df = frame(spark, [reading(), reading(lag=2000, at=1), reading(at=2)])
    df = df.withColumn("sent_at", F.when(F.unix_seconds("event_time") != T0 + 2, F.col("sent_at")))
    assert rows(late.with_route(df).groupBy("route").count(), "route", "count") == [
        ("bad_timestamp", 1), ("late", 1), ("on_time", 1)]
    on_time, behind = late.split_late(df)
    assert on_time.count() + behind.count() == 2


def test_exact_duplicate_stays_once(spark):
    df = frame(spark, [reading(), reading(), reading(lag=60), reading(at=60)])
    once = late.dedup_exact(df)
    assert once.count() == 2 and once.filter("sent_at = event_time").count() == 2


def test_near_copies_keep_the_smaller_lag(spark):
    df = frame(spark, [reading(at=0, lag=120), reading(at=2, lag=0, path="lte"), reading(at=60), reading(at=63, lag=9, path="lte"),
                       reading(at=66, path="lte")])
    kept = late.dedup_paths(late.with_lag(df), 5, slice_seconds=30)
    assert rows(kept, "group_s", "copies", "ingestion_path") == [(T0, 2, "lte"), (T0 + 60, 3, "lte")]


def test_hard_rules_are_total(spark):
    df = frame(spark, [reading(), reading(wind=80.0), reading(dose=5000.0), reading(dose=None), reading(dose=None, battery=0.0),
                       reading(wind=None), reading(wind=80.0, dose=-1.0), reading(wind=45.0, dose=1000.0)])
    ok, bad = rules.quarantine(rules.apply_rules(df, rules.reading_rules()))
    assert ok.count() == 2 and bad.count() == 6
    reasons = {tuple(r[0]) for r in bad.select("reasons").collect()}
    assert ("wind_physical", "dose_in_detector_range") in reasons and ("no_null_when_powered",) in reasons


def test_expectation_levels(spark):
    import pytest
    from pyspark.sql import Observation
    df = spark.createDataFrame([(1.0,), (-1.0,), (None,)], "concentration double")
    seen = Observation("o")
    assert rules.expect(df, "positive", F.col("concentration") >= 0, "warn", seen).count() == 3
    assert seen.get["positive"] == 2
    assert rules.expect(df, "positive", F.col("concentration") >= 0, "drop").count() == 1
    with pytest.raises(Exception, match="expectation failed: positive"):
        rules.expect(df, "positive", F.col("concentration") >= 0, "fail").collect()


def devices_of(spark, names):
    return spark.createDataFrame([(n, 54.8, 17.83 + 0.004 * i) for i, n in enumerate(names)], "device_id string, lat double, lon double")


def judged(spark, data, names, limits=Limits()):
    band = spark.createDataFrame([(1, h, 0.02, 0.03, 0.12) for h in range(-1, 8)],
                                 "cell_id long, hour_no long, median double, p05 double, p95 double")
    marked = staged(quality.history(frame(spark, data), band, T0, limits), "t")
    points = neighbours.station_points(devices_of(spark, names))
    return quality.quality_status(marked, points, neighbours.neighbour_pairs(points), limits).withColumn(
        "minute_no", (F.unix_seconds("event_time") - T0) / 60)


def noise(i, m):
    return 0.07 * (1 + 0.01 * ((i * 7 + m * 13) % 11 - 5))


def test_drift_of_one_device(spark):
    names = ["d1", "d2", "d3"]
    data = [reading(n, m * 60, dose=noise(i, m) * (1 + 0.01 * m if n == "d1" else 1)) for i, n in enumerate(names) for m in range(120)]
    out = judged(spark, data, names)
    flagged = out.filter("quality_status = 'drift_suspect'").agg(F.min("minute_no"), F.count_distinct("device_id")).first()
    assert 30 <= flagged[0] <= 45 and flagged[1] == 1
    assert out.count() == 360   # nothing is dropped
    kinds = rows(alerts.alerts(out).select("alert_type").distinct(), "alert_type")
    assert kinds == [("sensor_fault",)] or ("sensor_fault",) in kinds


def test_rise_over_an_area_is_a_signal(spark):
    names = ["d1", "d2", "d3"]
    data = [reading(n, m * 60, dose=noise(i, m) * (5 if m >= 30 else 1)) for i, n in enumerate(names) for m in range(60)]
    out = judged(spark, data, names)
    late_part = out.filter("minute_no >= 34")
    assert rows(late_part.select("quality_status").distinct(), "quality_status") == [("clean",)]
    assert late_part.filter("plume_signal").count() == late_part.count()
    assert rows(alerts.alerts(late_part).select("alert_type").distinct(), "alert_type") == [("outside_model_band",)]


def test_lone_device_is_not_confirmed(spark):
    data = [reading("d1", m * 60, dose=noise(0, m) * (5 if m >= 15 else 1)) for m in range(60)]
    out = judged(spark, data, ["d1"])
    assert out.filter("minute_no > 30").filter("quality_status <> 'drift_suspect'").count() == 0


def test_frozen_quiet_and_warmup(spark):
    def dose(m):
        return 0.07 if 20 <= m < 32 else noise(0, m) + m * 1e-6
    out = judged(spark, [reading("d1", m * 60, dose=dose(m)) for m in range(60)], ["d1"])
    assert [r[0] for r in out.filter("quality_status = 'frozen'").orderBy("minute_no").select("minute_no").collect()] == [29.0, 30.0, 31.0]
    assert out.filter("quality_status = 'warmup'").count() == 10
    assert out.filter("minute_no < 20 or minute_no >= 32").filter("quality_status = 'frozen'").count() == 0


def test_frozen_boundary_across_slices(spark):
    for n, expected in ((9, 0), (10, 1), (11, 2)):
        data = [reading("d1", m * 60, dose=0.5 if 5 <= m < 5 + n else 0.1 + m * 1e-3) for m in range(40)]
        marked = quality.frozen_run(frame(spark, data), Limits(slice_seconds=240))
        assert marked.filter("is_frozen").count() == expected


def test_neighbour_median_leaves_the_device_out(spark):
    values = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0), ("c", 1, 10.0), ("d", 1, 4.0), ("e", 2, 3.0)],
                                   "device_id string, minute long, value double")
    points = neighbours.station_points(devices_of(spark, ["a", "b", "c", "d", "e"]))
    out = neighbours.neighbour_median(values, points, neighbours.neighbour_pairs(points))
    assert rows(out, "device_id", "n_neighbours", "neighbour_median") == [
        ("a", 3, 4.0), ("b", 3, 4.0), ("c", 3, 2.0), ("d", 3, 2.0), ("e", 0, None)]


def scattered(spark, n=60, seed=3):
    """Devices off any lattice, some at one position, some near the date line and the pole, some without a position."""
    import random
    rng = random.Random(seed)
    at = [(f"d{i:02d}", 54.8 + rng.gauss(0, 0.03), 17.83 + rng.gauss(0, 0.05)) for i in range(n)]
    at += [("twin", at[0][1], at[0][2]), ("east", 10.0, 179.99), ("west", 10.01, -179.99), ("pole", 89.99, 0.0), ("over", 89.99, 180.0)]
    return at, spark.createDataFrame([*at, ("lost", None, 17.8), ("odd", float("nan"), 17.8)], "device_id string, lat double, lon double")


def near_by(at, radius):
    from math import asin, cos, radians, sin, sqrt

    def km(a, b):
        h = sin(radians(b[1] - a[1]) / 2) ** 2 + cos(radians(a[1])) * cos(radians(b[1])) * sin(radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371 * asin(sqrt(min(1.0, h)))
    return {a[0]: {b[0] for b in at if b[0] != a[0] and km(a, b) <= radius} for a in at}


def test_disc_is_exact_and_its_groups_do_not_overlap(spark):
    at, places = scattered(spark)
    for cells in (neighbours.CELLS_DEG, (0.04, 0.01)):
        points = staged(neighbours.station_points(places, cells), "t")
        pairs = staged(neighbours.neighbour_pairs(points, 5.0, cells), "t")
        met = points.select("device_id", "point").join(pairs, "point").join(
            neighbours.members(points, pairs).withColumnRenamed("device_id", "other"), "near")
        found = [tuple(r) for r in met.select("device_id", "other").collect()]
        wanted = near_by(at, 5.0)
        assert len(found) == len(set(found))
        assert set(found) == {(a, b) for a, others in wanted.items() for b in others | {a}}
        assert pairs.filter("near like '0:%' or near like '1:%'").count() > 0      # some cells were taken whole


def test_neighbour_median_matches_brute_force(spark):
    import random
    import statistics
    rng = random.Random(5)
    at, places = scattered(spark)
    data = [(n, m, round(rng.gauss(0, 0.1), 2)) for n, _, _ in at for m in range(6) if rng.random() < 0.8]
    values = spark.createDataFrame([*data, ("lost", 1, 0.5)], "device_id string, minute long, value double")
    wanted = near_by(at, 5.0)
    expected = {}
    for name, minute, _ in data:
        others = [v for n, m, v in data if m == minute and n in wanted[name]]
        expected[(name, minute)] = (len(others), statistics.median(others) if others else None)
    for widths in ((0.05,), (10.0, 0.1), (0.001,)):
        out = neighbours.neighbour_median(values, *neighbours.neighbourhood(places, 5.0), widths=widths)
        got = {(r[0], r[1]): (r[2], r[3]) for r in out.collect()}
        assert set(got) == set(expected)
        for key, (n, median) in expected.items():
            assert got[key][0] == n and (got[key][1] == median if median is None else abs(got[key][1] - median) < 1e-12), key


def test_neighbour_decision_matches_brute_force(spark):
    import random
    import statistics
    rng = random.Random(7)
    names = [f"d{i}" for i in range(9)]
    data = [(n, T0 + 60 * m, round(rng.uniform(0.0, 0.4), 2)) for n in names for m in range(40) if rng.random() < 0.8]
    df = spark.createDataFrame(data, "device_id string, s long, r double").withColumn("event_time", F.timestamp_seconds("s"))
    places = spark.createDataFrame([(n, 54.8, 17.8 if i < 5 else 17.83 + 0.02 * i) for i, n in enumerate(names)],
                                   "device_id string, lat double, lon double")   # five devices share one point
    points = neighbours.station_points(places)
    got = {(r[0], r[1]): r[2] for r in neighbours.confirmed_by_neighbours(
        df, "r", points, neighbours.neighbour_pairs(points, 3.0), 0.2).collect()}
    from math import asin, cos, radians, sin, sqrt

    def km(a, b):
        h = (cos(radians(54.8)) ** 2) * sin(radians(b - a) / 2) ** 2
        return 2 * 6371 * asin(sqrt(h))
    lon = {r[0]: r[2] for r in places.collect()}
    for name, s, value in data:
        if value <= 0.2:
            continue
        other = [v for n, t, v in data if t == s and n != name and km(lon[n], lon[name]) <= 3.0]
        assert got[(name, s // 60)] == (bool(other) and statistics.median(other) > 0.2)


def test_health_needs_five_good(spark):
    pattern = [0] * 3 + [1] * 3 + [0] * 4 + [1] + [0] * 5 + [1] * 2
    df = spark.createDataFrame([("d", i, bool(b)) for i, b in enumerate(pattern)], "device_id string, i long, bad boolean")
    df = df.withColumn("event_time", F.timestamp_seconds("i")).withColumn("ingestion_path", F.lit("wifi"))
    limits = Limits(slice_seconds=4)
    assert rows(health_events(df, limits), "at_s", "state") == [(15, "healthy"), (5, "quarantined")]
    assert rows(device_health(df, limits), "state", "since_s", "n_quarantined", "n_bad") == [("healthy", 15, 1, 6)]


def test_clock_disorder(spark):
    df = frame(spark, [reading(at=0, lag=100), reading(at=60, lag=40), reading(at=30, lag=70), reading(at=120)]).coalesce(1)
    df = df.withColumn("event_id", F.expr("cast(element_at(map(0, 0, 60, 1, 30, 2, 120, 3), cast(unix_seconds(event_time) - 1300060800 as int)) as bigint)"))
    assert rows(late.clock_disorder(df).filter("is_disordered"), "event_id") == [(2,)]


def test_unit_shift(spark):
    data = [reading("d1", m * 60, wind=(5.0 + m % 3) * (3.6 if m >= 60 else 1)) for m in range(120)]
    data += [reading("d2", m * 60, wind=80.0 if m == 70 else 5.0) for m in range(120)]
    out = quality.unit_shift(frame(spark, data))
    assert rows(out.filter("unit_suspect"), "device_id", "block") == [("d1", (T0 + 3600) // 1800)]


def test_gap_is_filled_from_neighbours_and_marked(spark):
    data = [reading("d1", m * 60, dose=0.1) for m in range(20) if not 5 <= m < 13]
    data += [reading("d2", m * 60, dose=0.2) for m in range(20)] + [reading("d3", m * 60, dose=0.4) for m in range(20)]
    out = quality.impute_gaps(frame(spark, data), devices_of(spark, ["d1", "d2", "d3"]), 5.0)
    got = out.collect()
    assert len(got) == 8 and all(r.is_imputed and r.device_id == "d1" and abs(r.dose_rate_usv_h - 0.3) < 1e-12 for r in got)


def test_union_of_paths(spark):
    a = spark.createDataFrame([(1, 2.0)], "id long, temp double")
    b = spark.createDataFrame([(2,)], "id long")
    assert rows(late.union_paths(a, b), "id", "temp") == [(1, 2.0), (2, None)]


def test_split_is_whole(spark):
    df = frame(spark, [reading(at=i, lag=(i * 97) % 1500, wind=5.0 if i % 7 else 70.0) for i in range(200)])
    parts = monitoring.split_readings(df)
    assert parts.clean.count() + parts.late.count() + parts.refused.count() + parts.untimed.count() == 200


def test_equal_neighbours_are_no_outliers_of_each_other(spark):
    points, pairs = neighbours.neighbourhood(devices_of(spark, ["d0", "d1", "d2", "d3"]))
    winds = spark.range(500, 1000).selectExpr("id as minute", "id / 100 as value").crossJoin(
        spark.range(4).selectExpr("concat('d', id) as device_id")).select("device_id", "minute", "value")
    out = neighbours.neighbour_outlier(winds, points, pairs)
    assert out.filter("is_outlier or neighbour_mean <> value").count() == 0
    odd = spark.createDataFrame([(f"d{i}", 1, v) for i, v in enumerate((float("nan"), 1e30, 2.0, 1e-30))], "device_id string, minute long, value double")
    assert neighbours.neighbour_sums(odd, points, pairs).count() == 4


def test_value_at_the_limit_is_judged_as_sql_judges_it(spark):
    # exactly three standard deviations away; the plain sums give these answers in any order of the neighbours
    cases = [((8.6, 8.13, 7.87), 9.31, True), ((6.99, 6.13, 7.85), 9.57, False), ((6.24, 6.51, 5.97), 5.43, False), ((6.73, 6.57, 5.69), 8.01, True)]
    points, pairs = neighbours.neighbourhood(devices_of(spark, ["d0", "d1", "d2", "d3"]))
    data = [(f"d{i}", minute, v) for minute, (others, own, _) in enumerate(cases) for i, v in enumerate((own, *others))]
    out = neighbours.neighbour_outlier(spark.createDataFrame(data, "device_id string, minute long, value double"), points, pairs)
    assert rows(out.filter("device_id = 'd0'"), "minute", "is_outlier") == [(m, c[2]) for m, c in enumerate(cases)]
    assert out.count() == len(data)
