"""Sliced windows against the plain ones, with one key that holds most rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window, functions as F

from leeward.config import Limits
from leeward.operators import quality, slices
from leeward.session import staged


@pytest.fixture(scope="module")
def readings(spark):
    rng = random.Random(3)
    data = []
    for key, n in (("hot", 400), ("a", 30), ("b", 1)):
        at = 0
        for _ in range(n):
            at += rng.choice([0, 60, 60, 60, 60, 300, 5000])
            data.append((key, at, rng.choice(["lte", "wifi"]) + str(len(data)), rng.choice([1.0, 1.0, 1.0, 2.0, None])))
    df = spark.createDataFrame(data, "device_id string, t long, ingestion_path string, v double")
    return df.withColumn("event_time", F.timestamp_seconds("t")).withColumn("residual", F.col("v") * F.col("t"))


KEY = ["device_id"]


def order():
    return [F.col("t"), F.col("ingestion_path")]


def plain():
    return Window.partitionBy("device_id").orderBy("t", "ingestion_path")


def check(df, ours, theirs):
    wrong = df.filter(~F.col(ours).eqNullSafe(F.col(theirs)))
    assert wrong.count() == 0, wrong.limit(5).collect()


@pytest.mark.parametrize("width", [200, 4000, 10**7])
def test_previous(readings, width):
    df = slices.with_previous(readings, KEY, order(), {"before": F.col("v"), "t_before": F.col("t")}, width)
    df = df.withColumn("e1", F.lag("v").over(plain())).withColumn("e2", F.lag("t").over(plain()))
    assert df.count() == readings.count()
    check(df, "before", "e1")
    check(df, "t_before", "e2")


def expected_runs(df):
    df = df.withColumn("x", F.coalesce(F.col("v") != F.lag("v").over(plain()), F.lit(True)).cast("int"))
    df = df.withColumn("g", F.sum("x").over(plain()))
    per = Window.partitionBy("device_id", "g")
    return df.withColumn("e_len", F.row_number().over(per.orderBy("t", "ingestion_path")).cast("long")).withColumn(
        "e_start", F.min("t").over(per))


@pytest.mark.parametrize("width", [200, 4000, 10**7])
def test_runs(readings, width):
    df = expected_runs(slices.runs_of_value(readings, KEY, order(), F.col("v"), width))
    assert df.count() == readings.count()
    check(df, "run_len", "e_len")
    check(df, "run_start", "e_start")


@pytest.mark.parametrize("width", [700, 5000, 10**7])
def test_trailing(readings, width):
    df = slices.trailing(readings, KEY, F.col("t"), 1800, width, {"mean": F.avg("residual"), "n": F.count(F.lit(1))})
    frame = Window.partitionBy("device_id").orderBy("t").rangeBetween(-1800, 0)
    df = df.withColumn("e", F.count(F.lit(1)).over(frame)).withColumn("em", F.avg("residual").over(frame))
    assert df.count() == readings.count()
    check(df, "n", "e")
    assert df.filter(F.abs(F.col("mean") - F.col("em")) > 1e-6).count() == 0


@pytest.mark.parametrize("width", [1800, 3600, 10**7])
def test_fused_history(readings, width):
    limits = Limits(slice_seconds=width)
    df = readings.withColumnRenamed("v", "dose_rate_usv_h")
    marked = staged(quality.mark_history(df, limits), "marked")
    out = quality.resolve_runs(marked, limits).withColumnRenamed("dose_rate_usv_h", "v")
    assert out.count() == readings.count()
    check(expected_runs(out), "run_len", "e_len")


def test_trailing_frame_holds_31_minutes(spark):
    df = spark.createDataFrame([("d", 60 * i) for i in range(60)], "device_id string, t long")
    out = slices.trailing(df, KEY, F.col("t"), 1800, 3600, {"n": F.count(F.lit(1))})
    assert out.agg(F.max("n")).first()[0] == 31


def test_latest_and_first(readings):
    rows = readings.select("device_id", "t", "ingestion_path", "v")
    last = {r[0]: r[1] for r in slices.latest(rows, KEY, ["t", "ingestion_path"]).collect()}
    first = {r[0]: r[1] for r in slices.first_arrival(rows, KEY, ["t", "ingestion_path"]).collect()}
    for key, low, high in readings.groupBy("device_id").agg(F.min("t"), F.max("t")).collect():
        assert (first[key], last[key]) == (low, high)
