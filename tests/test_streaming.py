from __future__ import annotations

import pandas as pd
from pyspark.sql import Window, functions as F

from support import rows
from leeward import schemas
from leeward.config import Limits
from leeward.operators.health import device_health
from leeward.operators.registry import scd2
from leeward.plans.monitoring import split_readings
from leeward.session import fresh_path, make_folder
from leeward.sources.fixtures import Tables
from leeward.streaming import health, ingest, state
from leeward.streaming.metrics import BatchMetrics
from test_sensor_dq import T0, frame, reading

SCHEMA = schemas._s(("ingestion_path", schemas.S), ("cell_id", schemas.L), *[(f.name, f.dataType) for f in schemas.READING])


def land(df, folder):
    df.select(*SCHEMA.fieldNames()).coalesce(1).write.mode("append").json(folder)


def started(spark, max_files=1):
    root = fresh_path(spark, "stream")
    make_folder(spark, f"{root}/landing")
    stream = ingest.routed(ingest.stream_readings(spark, f"{root}/landing", SCHEMA, max_files)).drop("is_late")
    return root, ingest.write_routed(stream, f"{root}/routed", f"{root}/checkpoint")


def test_boundary_lag_survives_the_watermark(spark):
    root, writer = started(spark)
    land(frame(spark, [reading("a", at=3600)]), f"{root}/landing")
    ingest.run_available(writer)
    land(frame(spark, [reading("b", at=2700, lag=900), reading("b", at=2700, lag=900), reading("c", at=2600, lag=1000)]), f"{root}/landing")
    figures = BatchMetrics(spark, f"{root}/metrics")
    figures.finished(ingest.run_available(writer))
    figures.close()
    assert figures.table().agg(F.sum("dropped_rows")).first()[0] == 0
    assert rows(spark.read.parquet(f"{root}/routed"), "device_id", "route") == [("a", "clean"), ("b", "clean"), ("c", "late")]


def test_replay_equals_batch_and_restart_adds_nothing(spark):
    root, writer = started(spark, None)
    sent = Tables(spark, "/root/testdata/sf0.001").readings()
    cut = F.unix_seconds("sent_at") < 1_300_060_800 + 600
    for part in (cut, ~cut):
        land(sent.filter(part), f"{root}/landing")
        ingest.run_available(writer)
    ingest.run_available(writer)
    streamed = spark.read.parquet(f"{root}/routed")
    parts = split_readings(sent)
    key = ["device_id", "event_time", "sent_at"]
    for route, df in (("clean", parts.clean), ("refused", parts.refused), ("late", parts.late)):
        assert rows(streamed.filter(F.col("route") == route), *key) == rows(df, *key)


def test_tables_by_batch_overwrite_a_retried_batch(spark):
    root = fresh_path(spark, "tables")
    write = ingest.tables_by_batch(root, ("clean", "late"))
    df = spark.createDataFrame([(1, "clean"), (2, "late"), (3, "clean")], "id long, route string")
    for batch_id in (0, 0, 1):
        write(df, batch_id)
    assert spark.read.parquet(f"{root}/clean").count() == 4 and spark.read.parquet(f"{root}/late").count() == 2


def test_new_field_stops_nothing(spark):
    root = fresh_path(spark, "evolve")
    make_folder(spark, f"{root}/landing")
    lines = ['{"device_id":"a","dose_rate_usv_h":0.1}', '{"device_id":"b","dose_rate_usv_h":0.2,"detector_temp_c":18.5}', 'not json']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(f"{root}/landing")
    out = ingest.evolve(ingest.stream_lines(spark, f"{root}/landing"), schemas._s(("device_id", schemas.S), ("dose_rate_usv_h", schemas.D)))
    out = out.withColumn("temp", F.try_variant_get("payload", "$.detector_temp_c", "double")).drop("payload")
    ingest.run_available(ingest.write_bronze(out, f"{root}/out", f"{root}/ck"))
    assert rows(spark.read.parquet(f"{root}/out"), "device_id", "dose_rate_usv_h", "temp") == [
        ("a", 0.1, None), ("b", 0.2, 18.5), (None, None, None)]


def test_registry_batches_out_of_order_and_retried(spark):
    write, table = state.registry_writer(spark, fresh_path(spark, "reg"))
    feed = spark.createDataFrame([("d%d" % (i % 4), i, "DELETE" if i % 9 == 0 else "UPDATE", "v%d" % (i % 3)) for i in range(60)],
                                 "device_id string, seq long, op string, firmware string")
    for batch_id, part in ((0, F.col("seq") % 2 == 1), (1, F.col("seq") % 4 == 0), (1, F.col("seq") % 4 == 0), (2, F.col("seq") % 4 >= 2)):
        write(feed.filter(part), batch_id)
    cols = ["device_id", "start_seq", "end_seq", "firmware", "is_current"]
    assert rows(table.read(), *cols) == rows(scd2(feed), *cols)


def test_overlapping_health_batches_equal_one_batch(spark):
    """Outcomes land up to a quarter of an hour late, in batches that overlap in event time; the state is that of the ordered series."""
    data = [(f"d{d}", 60 * i, (i * (d + 3) // 5) % 4 == 0 or (i // (7 + d)) % 3 == 1, 60 * i + (i * 7919 % 16) * 60) for d in range(4) for i in range(90)]
    df = spark.createDataFrame(data, "device_id string, s long, bad boolean, sent long").withColumn(
        "event_time", F.timestamp_seconds("s")).withColumn("ingestion_path", F.lit("wifi"))
    root = fresh_path(spark, "health")
    make_folder(spark, f"{root}/landing")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", health.ROCKSDB)
    try:
        columns = ["device_id", "event_time", "ingestion_path", "bad"]
        emitted = health.health_stream(spark.readStream.schema(df.select(*columns).schema).json(f"{root}/landing"))
        writer = ingest.write_bronze(emitted, f"{root}/health", f"{root}/checkpoint")
        for low, high in ((0, 2000), (2000, 4000), (4000, 99999)):
            df.where((F.col("sent") >= low) & (F.col("sent") < high)).select(*columns).write.mode("append").json(f"{root}/landing")
            ingest.run_available(writer)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    seen = df.where(F.col("s") <= 60 * 89 - 901)
    whole = device_health(seen, Limits(slice_seconds=600))
    got = health.current_health(spark.read.parquet(f"{root}/health"))
    assert rows(got, "device_id", "state", "since_s") == rows(whole, "device_id", "state", "since_s")
    assert {r.last_s for r in got.collect()} == {seen.agg(F.max("s")).first()[0]} and whole.filter("n_quarantined > 0").count() > 0


def test_every_batch_has_a_row(spark):
    root, writer = started(spark)
    figures = BatchMetrics(spark, f"{root}/metrics")
    try:
        for at in (3600, 7200, 100):                    # the last file lands behind the watermark
            land(frame(spark, [reading("a", at=at), reading("b", at=at)]), f"{root}/landing")
            figures.finished(ingest.run_available(writer))
            figures.finished(ingest.run_available(writer))          # nothing new: no row, or the same batch again
    finally:
        figures.close()
    table = figures.table()
    assert table.where("input_rows > 0").count() == 3 and table.groupBy("query_id", "batch_id").count().where("count > 1").count() == 0
    assert table.agg(F.sum("input_rows"), F.sum("dropped_rows")).first() == (12, 2)      # both branches of the routed stream read the file


def test_accounts_hold_every_row_once(spark):
    """Files out of order, copies, a missing time: every landed row has one route, and readings behind the watermark are told as such."""
    root = fresh_path(spark, "accounts")
    for folder in ("landing", "bronze"):
        make_folder(spark, f"{root}/{folder}")
    landed = ingest.stream_bronze(ingest.stream_readings(spark, f"{root}/landing", SCHEMA, None))
    to_bronze = ingest.write_bronze(landed, f"{root}/bronze", f"{root}/c1")
    stream = ingest.routed(spark.readStream.schema(landed.schema).parquet(f"{root}/bronze")).drop("is_late")
    to_routes = ingest.write_routed(stream, f"{root}/routed", f"{root}/c2")
    slices = ([reading("a", at=600), reading("a", at=600)], [reading("a", at=7200), reading("b", at=7200, lag=1000)],
              [reading("a", at=3600, lag=60), reading("a", at=3600), reading("c", at=3600, wind=99.0), reading("d", at=7000), reading("a", at=7200, lag=120)])
    for part in slices:
        land(frame(spark, part), f"{root}/landing")
        ingest.run_available(to_bronze)
        ingest.run_available(to_routes)
    land(frame(spark, [reading("e", at=7100)]).withColumn("sent_at", F.lit(None).cast("timestamp")), f"{root}/landing")
    ingest.run_available(to_bronze)
    ingest.run_available(to_routes)
    found = ingest.account(spark.read.parquet(f"{root}/bronze"), spark.read.parquet(f"{root}/routed"))
    got = rows(found, "device_id", F.unix_seconds("event_time") - T0, F.unix_seconds("sent_at") - T0, "route")
    assert got == sorted([("a", 600, 600, "clean"), ("a", 600, 600, "duplicate"), ("a", 7200, 7200, "clean"), ("b", 7200, 8200, "late"),
                          ("a", 3600, 3660, "duplicate"), ("a", 3600, 3600, "behind_watermark"), ("c", 3600, 3600, "behind_watermark"),
                          ("d", 7000, 7000, "clean"), ("a", 7200, 7320, "duplicate"), ("e", 7100, None, "bad_timestamp")], key=str)
    assert [r.reasons for r in found.where("device_id = 'c'").collect()] == [["wind_physical"]]


def test_hour_of_late_resends_is_counted_whole(spark):
    root = fresh_path(spark, "share")
    first = [(f"2011-03-14 00:{m:02d}:00", "clean") for m in (0, 10, 59)] + [("2011-03-14 01:40:00", "clean")]
    later = [("2011-03-14 00:50:00", "late"), ("2011-03-14 04:00:00", "clean")]
    make_folder(spark, f"{root}/in")
    stream = spark.readStream.schema("event_time timestamp, route string").parquet(f"{root}/in")
    writer = ingest.write_bronze(ingest.clean_share_stream(stream), f"{root}/out", f"{root}/checkpoint")
    for part in (first, later):
        rows_ = spark.createDataFrame(part, "t string, route string").select(F.to_timestamp("t").alias("event_time"), "route")
        rows_.coalesce(1).write.mode("append").parquet(f"{root}/in")
        ingest.run_available(writer)
    shares = spark.read.parquet(f"{root}/out").orderBy("window_s").collect()
    assert [(r.n_readings, r.n_clean) for r in shares] == [(4, 3), (1, 1)]


def test_reading_without_any_time_lands_in_the_growing_table(spark, tmp_path):
    """Event 510,559 is the first that says neither when it was taken nor when it was sent."""
    from leeward.plans.catalog import all_queries
    small = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{small}/events.parquet").limit(100)
    events.withColumn("event_id", F.lit(510_500) + F.row_number().over(Window.orderBy("event_id"))).write.parquet(f"{tmp_path}/events.parquet")
    spark.read.parquet(f"{small}/orders.parquet").write.parquet(f"{tmp_path}/orders.parquet")
    sent = Tables(spark, str(tmp_path)).readings()
    assert sent.filter("event_time is null and sent_at is null").count() == 1
    assert all_queries()["schema_evolution"](spark, str(tmp_path)).agg(F.sum("n_readings")).first()[0] == sent.count()


def test_waiting_outcomes_take_few_rows_of_state():
    """A batch of a device was a row of state per outcome, each a round trip; it is one per ``PACK`` of them, in order and without loss."""
    n = 250
    times, ways = [(i * 7) % 50 for i in range(n)], ["wifi" if i % 3 else "lte" for i in range(n)]
    bad = [i % 2 == 0 for i in range(n)]

    class Kept:
        def __init__(self):
            self.rows, self.writes = [], 0

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows, self.writes = list(rows), self.writes + len(rows)

        def appendList(self, rows):
            self.rows, self.writes = self.rows + list(rows), self.writes + len(rows)

        def clear(self):
            self.rows = []

    class Single(Kept):
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    class Clock:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

        def registerTimer(self, ms):
            self.asked = ms

    processor = health.Health(3, 5)
    processor.waiting, processor.state, processor.handle = Kept(), Single(), Clock(0)
    frames = [pd.DataFrame({"at_s": times[i::2], "ingestion_path": ways[i::2], "bad": bad[i::2]}) for i in range(2)]
    frames = [f.assign(at_s=f["at_s"] + 1) for f in frames]
    assert not list(processor.handleInputRows(("d",), iter(frames), Clock(0)))
    assert processor.waiting.writes <= 2 and processor.handle.asked == 1000
    expected = ("healthy", None, None, 0, None)
    series = sorted(zip([t + 1 for t in times], ways, bad))
    for watermark in (20_500, 60_000):
        told = list(processor.handleExpiredTimer(("d",), Clock(watermark), None))
        ripe, series = [r for r in series if r[0] * 1000 <= watermark], [r for r in series if r[0] * 1000 > watermark]
        for at_s, _, is_bad in ripe:
            expected = health.step(expected, at_s, is_bad, 3, 5)
        assert processor.state.value == expected and len(told) == 1
    assert not processor.waiting.rows
