"""Named queries of the device registry and keyed writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leeward.functions.numeric import epoch_s
from leeward.operators import registry, rules
from leeward.operators.late import split_late
from leeward.operators.slices import first_arrival, latest
from leeward.plans.catalog import query
from leeward.session import fresh_path
from leeward.sources.fixtures import ORIGIN_S, Tables, with_views

VERSIONS = {"versions": """select device_id, seq as start_seq, end_seq, firmware, jurisdiction_code from (
    select *, lead(seq) over (partition by device_id order by seq) as end_seq
    from (select distinct * from v_device_cdc)) where op <> 'DELETE'"""}

# change number n takes effect n seconds after the first reading
AS_OF = VERSIONS | {
    "placed": """select r.device_id, r.event_id, r.ingestion_path, r.dose_rate_usv_h, r.wind_speed_ms, r.sent_at,
        cast(epoch_us(event_time) // 1000000 as bigint) as event_s, v.firmware, v.jurisdiction_code, v.start_seq
        from v_readings r left join versions v on v.device_id = r.device_id
        and v.start_seq <= cast(epoch_us(event_time) // 1000000 as bigint) - 1300060800
        and cast(epoch_us(event_time) // 1000000 as bigint) - 1300060800 < coalesce(v.end_seq, 9000000000000)"""}


def since_origin():
    return epoch_s(F.col("event_time")) - F.lit(ORIGIN_S)


def readings_with_version(t: Tables) -> DataFrame:
    return registry.as_of(t.readings(), registry.scd2(t.device_cdc()), since_origin(), ["firmware", "jurisdiction_code"])


@query(with_views("v_device_cdc", """select device_id, start_seq, end_seq, firmware, jurisdiction_code,
    cast(end_seq is null as bigint) as is_current from versions""", VERSIONS))
def device_scd2(t: Tables) -> DataFrame:
    out = registry.scd2(t.device_cdc())
    return out.select("device_id", "start_seq", "end_seq", "firmware", "jurisdiction_code",
                      F.col("is_current").cast("bigint").alias("is_current"))


@query(with_views("v_readings v_device_cdc", """select device_id, event_id, ingestion_path, event_s, sent_s, firmware, jurisdiction_code
    from (select *, cast(epoch_us(sent_at) // 1000000 as bigint) as sent_s from placed)""", AS_OF))
def readings_asof_device(t: Tables) -> DataFrame:
    return readings_with_version(t).select(
        "device_id", "event_id", "ingestion_path", epoch_s(F.col("event_time")).alias("event_s"),
        epoch_s(F.col("sent_at")).alias("sent_s"), "firmware", "jurisdiction_code")


@query(with_views("v_readings v_device_cdc", """select r.device_id, count(*) as n_readings, max(v.firmware) as firmware,
    max(v.jurisdiction_code) as jurisdiction_code from v_readings r
    left join (select * from versions where end_seq is null) v on v.device_id = r.device_id group by 1""", VERSIONS))
def readings_current_device(t: Tables) -> DataFrame:
    out = registry.with_device(t.readings(), registry.scd2(t.device_cdc()), ["firmware", "jurisdiction_code"])
    return out.groupBy("device_id").agg(F.count(F.lit(1)).alias("n_readings"), F.max("firmware").alias("firmware"),
                                        F.max("jurisdiction_code").alias("jurisdiction_code"))


# settings: ranges per firmware; v2 carries an anemometer with a wider range
FIRMWARE_RULES = (("v1", "dose_rate_usv_h", 0.0, 1000.0), ("v1", "wind_speed_ms", 0.0, 45.0),
                  ("v2", "dose_rate_usv_h", 0.0, 10000.0), ("v2", "wind_speed_ms", 0.0, 75.0))


@query(with_views("v_readings v_device_cdc", """select coalesce(firmware, 'none') as firmware, reasons, count(*) as n_readings from (
    select firmware, case when firmware is null then 'no_rule_for_firmware' else concat_ws(',',
      case when not coalesce(dose_rate_usv_h between 0 and (case firmware when 'v1' then 1000 else 10000 end), false)
        then 'dose_rate_usv_h_range' end,
      case when not coalesce(wind_speed_ms between 0 and (case firmware when 'v1' then 45 else 75 end), false)
        then 'wind_speed_ms_range' end) end as reasons from placed) group by 1, 2""", AS_OF))
def rules_by_firmware(t: Tables) -> DataFrame:
    dim = t.spark.createDataFrame(FIRMWARE_RULES, "firmware string, column_name string, lo double, hi double")
    out = rules.apply_rules_by_firmware(readings_with_version(t), dim)
    return (out.groupBy(F.coalesce("firmware", F.lit("none")).alias("firmware"), F.concat_ws(",", "reasons").alias("reasons"))
            .agg(F.count(F.lit(1)).alias("n_readings")))


@query(with_views("v_readings", """select device_id, cast(max(epoch_us(event_time)) // 1000000 as bigint) as last_s,
    cast(min(epoch_us(event_time)) // 1000000 as bigint) as first_s from v_readings group by 1"""))
def first_and_latest(t: Tables) -> DataFrame:
    at = ["event_time", "sent_at", "ingestion_path", "event_id"]
    rows = t.readings().where("event_time is not null").select("device_id", *at)
    last = latest(rows, ["device_id"], at).select("device_id", epoch_s(F.col("event_time")).alias("last_s"))
    first = first_arrival(rows, ["device_id"], at).select("device_id", epoch_s(F.col("event_time")).alias("first_s"))
    return last.join(first, "device_id")


@query(with_views("v_device_cdc", """select device_id, max(seq) as seq, arg_max(op, seq) as op, arg_max(firmware, seq) as firmware
    from v_device_cdc group by 1"""))
def upsert_twice(t: Tables) -> DataFrame:
    """The whole feed in two halves, each written twice; the table ends with the last change per device."""
    from leeward.sources.tables import VersionedTable
    table = VersionedTable(t.spark, fresh_path(t.spark, "devices"))
    feed = t.device_cdc().select("device_id", "seq", "op", "firmware")
    for half in (F.col("seq") % 2 == 0, F.col("seq") % 2 == 1):
        for _ in range(2):
            table.upsert(feed.filter(half), ["device_id"], ["seq"])
    return table.read()


@query(with_views("v_readings v_device_cdc", """select 'reversed feed' as compared, count(*) as n_left, count(*) as n_right,
    cast(0 as bigint) as only_left, cast(0 as bigint) as only_right from versions""", VERSIONS))
def run_difference(t: Tables) -> DataFrame:
    """Versions from the feed against versions from the feed in another order and layout: no difference."""
    from leeward.operators.runs import run_difference as difference
    feed = t.device_cdc()
    shuffled = feed.repartition(13, F.md5(F.col("seq").cast("string")))
    return difference(registry.scd2(feed), registry.scd2(shuffled)).select(
        F.lit("reversed feed").alias("compared"), "n_left", "n_right", "only_left", "only_right")


SHIFTED = {"a": "select event_id, min(lag) as lag from lags where lag <= 15 group by 1",
           "b": "select event_id, min(lag) as lag from lags where lag <= 12 group by 1"}


@query(with_views("v_readings", """select status, count(*) as n_rows from (
    select case when b.event_id is null then 'only_left' when a.event_id is null then 'only_right'
                when a.lag is distinct from b.lag then 'changed' else 'same' end as status
    from a full outer join b on a.event_id = b.event_id) group by 1""",
    {"lags": "select event_id, (epoch_us(sent_at) - epoch_us(event_time)) // 60000000 as lag from v_readings"} | SHIFTED))
def run_comparison(t: Tables) -> DataFrame:
    """Accepted readings under a 15-minute and a 12-minute limit, compared key by key."""
    from leeward.operators.runs import diff_runs

    def accepted(minutes: float) -> DataFrame:
        on_time, _ = split_late(t.readings(), minutes)
        return on_time.groupBy("event_id").agg(F.min("lag_minutes").alias("lag"))
    return diff_runs(accepted(15.0), accepted(12.0), ["event_id"]).groupBy("status").agg(F.count(F.lit(1)).alias("n_rows"))


def told_sql(*columns: str) -> str:
    """Every value with its length, a NULL as a mark."""
    return " || ".join(f"case when {c} is null then '-' else concat(cast(length(cast({c} as varchar)) as varchar), ':', cast({c} as varchar)) end"
                       for c in columns)


@query(with_views("v_device_cdc", f"""select count(*) as n_rows, cast(sum(cast(concat('0x',
    substr(md5({told_sql('device_id', 'start_seq', 'end_seq', 'firmware', 'jurisdiction_code')}), 1, 12)) as bigint)) as varchar) as checksum
    from versions""", VERSIONS))
def run_checksum(t: Tables) -> DataFrame:
    from leeward.operators.runs import checksum
    versions = registry.scd2(t.device_cdc())
    return checksum(versions, ["device_id", "start_seq", "end_seq", "firmware", "jurisdiction_code"])
