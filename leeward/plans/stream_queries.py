"""Named queries that land the derived inputs as files and run the streaming forms over them.

Inputs land in slices of time and each slice is processed before the next one lands, as a
bounded run of the stream would meet them. State carries over from run to run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from leeward import schemas
from leeward.config import Limits
from leeward.functions.numeric import epoch_s, quantize
from leeward.plans.catalog import q6, query
from leeward.plans.registry_queries import VERSIONS
from leeward.plans.sensor_queries import HEALTH, HISTORY, LIMITS, STEPS, outcomes
from leeward.session import fresh_path, make_folder, staged
from leeward.sources.fixtures import ORIGIN_S, Tables, with_views
from leeward.streaming import health, ingest, metrics, state

SENT = StructType([StructField("event_id", LongType()), StructField("cell_id", LongType()),
                   StructField("ingestion_path", StringType()), *schemas.READING.fields])
SENT_V2 = StructType([*SENT.fields, StructField("detector_temp_c", DoubleType())])
SLICES = 3


def landing_root(spark, name: str) -> str:
    root = fresh_path(spark, name)
    make_folder(spark, f"{root}/landing")
    return root


def landed_s() -> Column:
    """When a reading lands: as it is sent, or about its own time where it does not say."""
    return F.coalesce(epoch_s(F.col("sent_at")), epoch_s(F.col("event_time")))


def in_slices(rows: DataFrame, position: Column, folder: str, run: Callable[[], object], order: tuple[int, ...] = tuple(range(SLICES))) -> None:
    """Land ``rows`` in slices by ``position`` (seconds), in ``order``, calling ``run`` after each. Rows without a position do not land."""
    bounds = rows.agg(F.min(position).alias("a"), F.max(position).alias("b")).first()
    step = (bounds["b"] - bounds["a"]) // SLICES + 1
    for i in order:
        low = bounds["a"] + i * step
        rows.filter((position >= low) & (position < low + step)).write.mode("append").json(folder)
        run()


#: Files land out of order: the last third before the middle one.
OUT_OF_ORDER = (0, 2, 1)


def accounted(t: Tables) -> DataFrame:
    """Every landed reading with its one destination: bronze first, then the routed stream over it, then the accounts of both."""
    spark = t.spark
    root = landing_root(spark, "stream")
    landed = ingest.stream_bronze(ingest.stream_readings(spark, f"{root}/landing", SENT, None))
    to_bronze = ingest.write_bronze(landed, f"{root}/bronze", f"{root}/bronze_checkpoint")
    make_folder(spark, f"{root}/bronze")
    stream = ingest.routed(spark.readStream.schema(landed.schema).parquet(f"{root}/bronze"), LIMITS)
    to_routes = ingest.write_routed(stream.drop("is_late"), f"{root}/routed", f"{root}/routed_checkpoint")

    def run() -> None:
        ingest.run_available(to_bronze)
        ingest.run_available(to_routes)
    in_slices(t.readings(), landed_s(), f"{root}/landing", run, OUT_OF_ORDER)
    return staged(ingest.account(spark.read.parquet(f"{root}/bronze"), spark.read.parquet(f"{root}/routed"), LIMITS), "accounts")


# When each row lands, and the watermark its batch meets: the latest on-time event of earlier batches less the limit and a second.
ACCOUNTS = STEPS | {
    "arrived": "select *, coalesce(sent_s, event_s) as at_s from routed",
    "bounds": f"select min(at_s) as a, (max(at_s) - min(at_s)) // {SLICES} + 1 as step from arrived",
    "landed": """select r.*, list_position([0, 2, 1], cast((at_s - a) // step as integer)) as batch from arrived r, bounds""",
    "marks": """select b.batch, max(l.event_s) - 901 as mark from (values (1), (2), (3)) as b(batch)
        left join landed l on l.batch < b.batch and l.route = 'on_time' group by 1""",
    "told": """select l.* exclude (route), case when route <> 'on_time' then route
        when row_number() over (partition by route, device_id, event_time order by sent_at, ingestion_path) > 1 then 'duplicate'
        when coalesce(event_s <= mark, false) then 'behind_watermark' when reasons = '' then 'clean' else 'refused' end as route
        from landed l join marks m on m.batch = l.batch"""}


@query(with_views("v_readings", "select device_id, event_id, ingestion_path, event_s, sent_s, route from told", ACCOUNTS))
def stream_late_split(t: Tables) -> DataFrame:
    return accounted(t).select("device_id", "event_id", "ingestion_path", epoch_s(F.col("event_time")).alias("event_s"),
                               epoch_s(F.col("sent_at")).alias("sent_s"), "route")


@query(with_views("v_readings", f"""select device_id, count(*) as n_clean, count(distinct event_s) as n_times, {q6('sum(dose_rate_usv_h)')} as total_dose
    from once where reasons = '' group by 1""", STEPS))
def stream_dedup(t: Tables) -> DataFrame:
    """Clean readings of the stream, those behind the watermark among them: the same as in batch, whatever the files' order."""
    clean = accounted(t).filter(F.col("route").isin("clean", "behind_watermark") & (F.size("reasons") == 0))
    return clean.groupBy("device_id").agg(F.count(F.lit(1)).alias("n_clean"), F.count_distinct("event_time").alias("n_times"),
                                          quantize(F.sum("dose_rate_usv_h")).alias("total_dose"))


N_FILES = 105


@query(with_views("v_readings", f"""select count(distinct (at_s - a) // step) as n_batches, count(*) as input_rows, count(*) as accounted_rows,
    cast(1 as bigint) as drops_cover_behind from (select *, coalesce(sent_s, event_s) as at_s from routed),
    (select min(coalesce(sent_s, event_s)) as a, (max(coalesce(sent_s, event_s)) - min(coalesce(sent_s, event_s))) // {N_FILES} + 1 as step from routed)""", STEPS))
def stream_metrics(t: Tables) -> DataFrame:
    """A file per batch, more batches than a query remembers: the written figures count every row, dropped ones too, and the accounts hold them all."""
    spark = t.spark
    root = landing_root(spark, "metered")
    rows = staged(ingest.stream_bronze(t.readings().withColumn("at_s", landed_s())), "landed")
    bounds = rows.agg(F.min("at_s").alias("a"), F.max("at_s").alias("b")).first()
    file = F.floor((F.col("at_s") - bounds["a"]) / ((bounds["b"] - bounds["a"]) // N_FILES + 1)).cast("int")
    rows = rows.withColumn("file", file)
    rows.repartitionById(N_FILES, F.col("file")).drop("file", "at_s").write.mode("append").json(f"{root}/landing")
    schema = StructType([*SENT.fields, StructField("bronze_id", StringType())])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")                   # small batches: one state store
    figures = metrics.BatchMetrics(spark, f"{root}/metrics")
    try:
        stream = ingest.on_time_once(ingest.stream_readings(spark, f"{root}/landing", schema, 1), LIMITS)
        writer = ingest.write_routed(stream.drop("is_late"), f"{root}/routed", f"{root}/checkpoint")
        figures.finished(ingest.run_available(writer))
    finally:
        figures.close()
        spark.conf.set("spark.sql.shuffle.partitions", before)
    told = figures.table().agg(F.count_if(F.col("input_rows") > 0).alias("n_batches"), F.sum("input_rows").alias("input_rows"), F.sum("dropped_rows").alias("dropped"))
    accounts = ingest.account(rows.drop("file", "at_s"), spark.read.parquet(f"{root}/routed"), LIMITS).agg(
        F.count(F.col("route")).alias("accounted_rows"), F.count_if(F.col("route") == "behind_watermark").alias("behind"))
    both = told.withColumn("k", F.lit(1)).join(accounts.withColumn("k", F.lit(1)), "k")          # one row each
    return both.select("n_batches", "input_rows", "accounted_rows", (F.col("behind") <= F.col("dropped")).cast("bigint").alias("drops_cover_behind"))


@query(with_views("v_readings", f"""select device_id, count(*) as n_readings, count(detector_temp_c) as n_with_temp,
    {q6('sum(detector_temp_c)')} as total_temp, cast(sum(case when detector_temp_c is null then 0 else 1 end) as bigint) as n_grown from v_readings group by 1"""))
def schema_evolution(t: Tables) -> DataFrame:
    """Readings land as text; the field of newer firmware is read from the same stream."""
    spark = t.spark
    root = landing_root(spark, "evolving")
    old = SENT     # what the table knew before; the new field stays in the payload
    landed = ingest.evolve(ingest.stream_lines(spark, f"{root}/landing"), old)
    with_new = landed.withColumn("detector_temp_c", F.try_variant_get("payload", "$.detector_temp_c", "double"))
    grown = with_new.withColumn("fields", F.schema_of_variant("payload")).drop("payload")
    writer = ingest.write_bronze(grown, f"{root}/bronze", f"{root}/checkpoint")
    # a reading that says neither when it was taken nor when it was sent lands with the first ones
    in_slices(t.readings(), F.coalesce(landed_s(), F.lit(ORIGIN_S)), f"{root}/landing", lambda: ingest.run_available(writer))
    bronze = spark.read.parquet(f"{root}/bronze")
    return bronze.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("n_readings"), F.count("detector_temp_c").alias("n_with_temp"),
        quantize(F.sum("detector_temp_c")).alias("total_temp"),
        F.count_if(F.contains("fields", F.lit("detector_temp_c"))).alias("n_grown"))


@query(with_views("v_device_cdc", "select device_id, start_seq, end_seq, firmware, jurisdiction_code from versions", VERSIONS))
def stream_scd2(t: Tables) -> DataFrame:
    """The change feed lands in an order unrelated to its sequence; the versions come out the same."""
    spark = t.spark
    root = landing_root(spark, "registry")
    feed = t.device_cdc()
    write, table = state.registry_writer(spark, root)
    stream = spark.readStream.schema(feed.schema).json(f"{root}/landing")
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint")
    arrival = F.pmod(F.col("seq") * 7919, F.lit(1000))
    in_slices(feed, arrival, f"{root}/landing", lambda: ingest.run_available(writer))
    return table.read().select("device_id", "start_seq", "end_seq", "firmware", "jurisdiction_code")


# The state machine has taken what the last watermark passed: all but the last quarter of an hour and a second.
HEALTH_STEPS = HEALTH | {
    "all_outcomes": HEALTH["outcomes"],
    "outcomes": "select * from all_outcomes where event_s <= (select max(event_s) - 901 from all_outcomes)"}
HEALTH_STEPS = {name: HEALTH_STEPS[name] for name in [*[n for n in HEALTH if n in HISTORY], "all_outcomes", "outcomes", *[n for n in HEALTH if n not in HISTORY and n != "outcomes"]]}


@query(with_views("v_readings v_device_pos", """select d.device_id, coalesce(c.state, 'healthy') as state, c.since_s, d.last_s, d.run_n from
    (select device_id, max(event_s) as last_s, arg_max(n, event_s) as run_n from counted group by 1) d left join
    (select device_id, arg_max(state, at_s) as state, max(at_s) as since_s from changes group by 1) c on c.device_id = d.device_id""", HEALTH_STEPS))
def stream_health(t: Tables) -> DataFrame:
    """Outcomes of the quality rules land as their readings were sent, so that batches overlap in event time."""
    spark = t.spark
    root = landing_root(spark, "health")
    rows = outcomes(t)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", health.ROCKSDB)
    try:
        emitted = health.health_stream(spark.readStream.schema(rows.schema).json(f"{root}/landing"), LIMITS)
        writer = ingest.write_bronze(emitted, f"{root}/health", f"{root}/checkpoint")
        in_slices(rows, epoch_s(F.col("sent_at")), f"{root}/landing", lambda: ingest.run_available(writer))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return health.current_health(spark.read.schema(emitted.schema).parquet(f"{root}/health"))


@query(with_views("v_readings", f"""select event_s // 3600 * 3600 as window_s, count(*) as n_readings, count(*) filter (route = 'on_time' and reasons = '') as n_clean,
    {q6("cast(count(*) filter (route = 'on_time' and reasons = '') as double) / count(*)")} as clean_share from routed
    group by 1 having event_s // 3600 * 3600 + 3600 <= (select max(event_s) from routed) - 3600""", STEPS))
def stream_clean_share(t: Tables) -> DataFrame:
    spark = t.spark
    root = landing_root(spark, "share")
    from leeward.operators.late import with_route
    from leeward.operators.rules import apply_rules, reading_rules
    df = apply_rules(with_route(ingest.stream_readings(spark, f"{root}/landing", SENT, None), LIMITS.max_lag_minutes),
                     reading_rules(Limits()))
    df = df.withColumn("route", F.when((F.col("route") == "on_time") & (F.size("reasons") == 0), "clean").otherwise("other"))
    shares = ingest.clean_share_stream(df)
    writer = ingest.write_bronze(shares, f"{root}/shares", f"{root}/checkpoint")
    in_slices(t.readings(), landed_s(), f"{root}/landing", lambda: ingest.run_available(writer))
    out = spark.read.schema(shares.schema).parquet(f"{root}/shares")
    return out.withColumn("clean_share", quantize(F.col("clean_share")))
