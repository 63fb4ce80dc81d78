"""Named queries of landed weather documents, row filters and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leeward import schemas
from leeward.functions.numeric import quantize
from leeward.operators import alerts as board
from leeward.operators import governance, registry
from leeward.operators.rules import expect
from leeward.plans import monitoring
from leeward.plans.catalog import q6, query
from leeward.plans.registry_queries import VERSIONS, since_origin
from leeward.plans.sensor_queries import ALERTED, LIMITS, refreshed
from leeward.session import staged
from leeward.sources import files
from leeward.sources.fixtures import Tables, with_views

UNIT = "case when (hour_no // 24) % 11 = 5 then 'km/h' else 'm/s' end"


def documents(t: Tables) -> DataFrame:
    """Weather as it lands: one nested document per site and day. Some days carry the wrong unit."""
    hourly = t.weather().withColumn("day", F.floor(F.col("hour_no") / 24).cast("long"))
    fields = [F.col(name).cast("double").alias(name) for name in schemas.HOURLY]
    start = F.lit("2011-03-14 00:00:00").cast("timestamp_ntz")
    local = (start + F.make_dt_interval(hours=F.col("hour_no").cast("int"))).cast("string")
    when = F.translate(F.substring(local, 1, 16), " ", "T")
    rows = hourly.select("site_no", "day", F.struct("hour_no", when.alias("time"), *fields).alias("h"))
    days = rows.groupBy("site_no", "day").agg(F.array_sort(F.collect_list("h")).alias("hs"))   # 24 hours at most
    arrays = [F.col(f"hs.{name}").alias(name) for name in ("time", *schemas.HOURLY)]
    unit = F.when(F.col("day") % 11 == 5, "km/h").otherwise("m/s")
    units = [(unit if name.startswith("wind_speed") else F.lit("1")).alias(name) for name in schemas.HOURLY]
    site = t.sites().select("site_no", "lat", "lon")
    body = F.to_json(F.struct(
        (F.col("lat") + 0.01).alias("latitude"), (F.col("lon") - 0.01).alias("longitude"),
        F.when(F.col("site_no") == 3, 0.0).otherwise(12.0).alias("elevation"), F.col("lat").alias("req_lat"),
        F.col("lon").alias("req_lon"), F.struct(*units).alias("hourly_units"), F.struct(*arrays).alias("hourly")))
    parsed = F.from_json(body, schemas.WEATHER_FILE)
    return days.join(site, "site_no").select("site_no", parsed.alias("d")).select("site_no", "d.*")


@query(with_views("v_meteo", f"""select site_no, unit as wind_unit, count(distinct hour_no // 24) as n_documents, count(*) as n_hours,
    cast(unit = 'm/s' as bigint) as accepted from (select *, {UNIT} as unit from v_meteo) group by 1, 2"""))
def unit_gate(t: Tables) -> DataFrame:
    accepted, rejected = files.gate_units(documents(t))
    both = accepted.withColumn("accepted", F.lit(1).cast("bigint")).unionByName(
        rejected.withColumn("accepted", F.lit(0).cast("bigint")))
    return both.groupBy("site_no", F.col("hourly_units.wind_speed_10m").alias("wind_unit"), "accepted").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum(F.size("hourly.time")).alias("n_hours"))


@query(with_views("v_meteo v_sites", f"""select m.site_no, 1300060800 + hour_no * 3600 as hour_s, {q6('wind_speed_10m')} as wind_speed_10m,
    cast(wind_direction_10m as double) as wind_direction_10m, {q6('wind_speed_100m')} as wind_speed_100m, {q6('precipitation')} as precipitation,
    cast(cloud_cover as double) as cloud_cover, cast(shortwave_radiation as double) as shortwave_radiation,
    {q6('s.lat')} as req_lat, {q6('s.lat + 0.01')} as grid_lat, case when m.site_no = 3 then cast(0 as double) else cast(12 as double) end as grid_elevation
    from v_meteo m join v_sites s on s.site_no = m.site_no where {UNIT} = 'm/s'"""))
def bronze_meteo(t: Tables) -> DataFrame:
    accepted, _ = files.gate_units(documents(t))
    hours = files.explode_hours(accepted)
    return hours.select(
        "site_no", F.unix_seconds("hour").alias("hour_s"), quantize(F.col("wind_speed_10m")).alias("wind_speed_10m"),
        "wind_direction_10m", quantize(F.col("wind_speed_100m")).alias("wind_speed_100m"),
        quantize(F.col("precipitation")).alias("precipitation"), "cloud_cover", "shortwave_radiation",
        quantize(F.col("req_lat")).alias("req_lat"), quantize(F.col("grid_lat")).alias("grid_lat"), "grid_elevation")


@query(with_views("v_meteo", """select site_no, count(distinct hour_no // 24) as n_documents,
    count(distinct case when site_no = 3 then hour_no // 24 end) as n_warned from v_meteo group by 1"""))
def elevation_warning(t: Tables) -> DataFrame:
    """Documents whose land site comes back at sea level: warned about, kept."""
    docs = documents(t)
    kept = expect(docs, "land_has_elevation", F.col("elevation") > 0, "warn")
    return kept.groupBy("site_no").agg(F.count(F.lit(1)).alias("n_documents"),
                                       F.count_if(~(F.col("elevation") > 0)).alias("n_warned"))


# who asks, and the groups they are in
CALLERS = {"japan_7": ["jur_JP-07"], "japan": ["jur_JP-07", "jur_JP-08"], "poland": ["jur_PL-22"],
           "national": [governance.NATIONAL], "nobody": []}
SEES = """(caller = 'national' or (caller = 'japan_7' and jurisdiction_code = 'JP-07')
    or (caller = 'japan' and jurisdiction_code in ('JP-07', 'JP-08')) or (caller = 'poland' and jurisdiction_code = 'PL-22'))"""
WHO = "(select unnest(['japan_7', 'japan', 'poland', 'national', 'nobody']) as caller)"


@query(with_views("v_device_cdc", f"""select caller, device_id, start_seq, jurisdiction_code from versions, {WHO} where {SEES}""", {
    "versions": """select device_id, seq as start_seq, jurisdiction_code from (select *, lead(seq) over (partition by device_id order by seq) as nxt
        from (select distinct * from v_device_cdc)) where op <> 'DELETE'"""}))
def rls_visible(t: Tables) -> DataFrame:
    versions = staged(registry.scd2(t.device_cdc()), "versions")
    policy = governance.default_policy(t.spark, ["JP-07", "JP-08", "PL-22"])
    out = None
    for caller, groups in CALLERS.items():
        part = governance.visible_rows(versions, policy, groups).select(
            F.lit(caller).alias("caller"), "device_id", "start_seq", "jurisdiction_code")
        out = part if out is None else out.unionByName(part)
    return out


@query(with_views("v_cities v_sites", f"""select caller, s.jurisdiction_code, c.site_no, count(*) as n_cities, cast(sum(population) as bigint) as population
    from v_cities c join v_sites s on s.site_no = c.site_no, {WHO} where {SEES.replace('jurisdiction_code', 's.jurisdiction_code')} group by 1, 2, 3"""))
def rls_by_site(t: Tables) -> DataFrame:
    """Gold rows are filtered by the jurisdiction of the release site, not of the place."""
    placed = t.cities().join(t.sites().select("site_no", "jurisdiction_code"), "site_no")
    policy = governance.default_policy(t.spark, ["JP-07", "JP-08", "PL-22"])
    out = None
    for caller, groups in CALLERS.items():
        part = governance.visible_rows(placed, policy, groups).withColumn("caller", F.lit(caller))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("caller", "jurisdiction_code", "site_no").agg(
        F.count(F.lit(1)).alias("n_cities"), F.sum("population").alias("population"))


# Alerts and clean readings with the jurisdiction their device was in at the time.
PLACED = ALERTED | VERSIONS | {
    "raised": """select 'alert' as kind, alert_type, device_id, event_s from alerts where alert_type is not null
        union all select 'alert', 'sensor_fault', device_id, event_s from once where reasons <> ''
        union all select 'clean', null, device_id, event_s from judged where quality_status = 'clean'""",
    "owned": """select r.*, v.jurisdiction_code from raised r left join versions v on v.device_id = r.device_id
        and v.start_seq <= event_s - 1300060800 and event_s - 1300060800 < coalesce(v.end_seq, 9000000000000)"""}


def owned(t: Tables) -> DataFrame:
    """(kind, alert_type, device_id, event_time, jurisdiction_code) of alerts, faults and clean readings, by the registry as of each reading."""
    judged = staged(refreshed(t), "quality")
    faults = board.fault_alerts(monitoring.split_readings(t.readings(), LIMITS).refused)
    columns = ["kind", "alert_type", "device_id", "event_time"]
    rows = (board.alerts(judged).withColumn("kind", F.lit("alert")).select(*columns)
            .unionByName(faults.withColumn("kind", F.lit("alert")).select(*columns))
            .unionByName(judged.where("quality_status = 'clean'").withColumn("kind", F.lit("clean")).withColumn("alert_type", F.lit(None).cast("string")).select(*columns)))
    return registry.as_of(staged(rows, "raised"), registry.scd2(t.device_cdc()), since_origin(), ["jurisdiction_code"])


@query(with_views("v_readings v_device_pos v_device_cdc", """select alert_type, coalesce(jurisdiction_code, 'none') as jurisdiction_code, count(*) as n_alerts,
    count(distinct device_id) as n_devices from owned where kind = 'alert' group by 1, 2""", PLACED))
def alerts_by_jurisdiction(t: Tables) -> DataFrame:
    """What each authority has before it."""
    found = owned(t).where("kind = 'alert'").withColumn("jurisdiction_code", F.coalesce("jurisdiction_code", F.lit("none")))
    return board.active_alerts(found, ["jurisdiction_code"])


@query(with_views("v_readings v_device_pos v_device_cdc", f"""select caller, kind, coalesce(jurisdiction_code, 'none') as jurisdiction_code, count(*) as n_rows
    from owned, {WHO} where {SEES} group by 1, 2, 3""", PLACED))
def rls_sensor_rows(t: Tables) -> DataFrame:
    """Alerts and clean readings as every caller sees them: by the jurisdiction of the device at the time."""
    rows = staged(owned(t), "owned")
    policy = governance.default_policy(t.spark, ["JP-07", "JP-08", "PL-22"])
    out = None
    for caller, groups in CALLERS.items():
        part = governance.visible_rows(rows, policy, groups).withColumn("caller", F.lit(caller))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("caller", "kind", F.coalesce("jurisdiction_code", F.lit("none")).alias("jurisdiction_code")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(with_views("v_readings v_device_pos", f"""select sha256(concat('salt', r.device_id)) as device_id, {q6('(floor(p.lat / 0.05) + 0.5) * 0.05')} as lat,
    {q6('(floor(p.lon / 0.05) + 0.5) * 0.05')} as lon, count(*) as n_readings, cast(null as double) as source_term_bq
    from v_readings r join v_device_pos p on p.device_id = r.device_id group by r.device_id, p.lat, p.lon"""))
def masked_view(t: Tables) -> DataFrame:
    counted = t.readings().groupBy("device_id").agg(F.count(F.lit(1)).alias("n_readings"))
    rows = counted.join(t.device_pos().select("device_id", "lat", "lon"), "device_id").withColumn(
        "source_term_bq", F.col("n_readings") * F.lit(1e15))
    out = governance.mask(rows, "public_analyst", "salt")
    return out.select("device_id", quantize(F.col("lat")).alias("lat"), quantize(F.col("lon")).alias("lon"),
                      "n_readings", "source_term_bq")
