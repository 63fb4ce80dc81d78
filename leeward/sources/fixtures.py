"""Derived inputs: sensor readings, device feed, weather, grid, cities and measurements.

The driver tables hold none of these, so they are derived from them by rule. Each view exists
as SQL text for the independent engine and as a DataFrame here; both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ORIGIN_S = 1_300_060_800          # 2011-03-14T00:00:00Z
SITES = ((0, "SITE-A", "JP-07", 37.42, 141.03), (1, "SITE-B", "JP-07", 37.32, 141.03),
         (2, "SITE-C", "JP-08", 36.47, 140.61), (3, "SITE-D", "PL-22", 54.81, 17.83))


class Tables:
    """The parquet tables of one folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._band: DataFrame | None = None

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sites(self) -> DataFrame:
        """Four rows, marked as such: the optimizer knows no size of local rows and would lay the other side out by their four keys."""
        return F.broadcast(self.spark.createDataFrame(
            SITES, "site_no long, site_id string, jurisdiction_code string, lat double, lon double"))

    def band(self) -> DataFrame:
        """The model's dose band per sensor cell and hour, worked out once per query."""
        if self._band is None:
            from leeward.plans.model_band import model_band
            self._band = model_band(self)
        return self._band

    def readings(self) -> DataFrame:
        """One row per sent reading. One scan: copies are made by exploding, not by a union of scans."""
        base = self.read("events").selectExpr(
            "event_id", "event_id % 50 as dev", "event_id % 10 as cell_id",
            "cast(floor(event_id / 50) as bigint) as m", "cast(floor(floor(event_id / 50) / 60) as bigint) as hour_no",
            "cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k", "event_type", "value")
        base = base.join(self.band().select("cell_id", "hour_no", "median"), ["cell_id", "hour_no"], "left")
        dose = base.selectExpr("*", f"{DOSE} as dose")
        rows = dose.selectExpr(
            "event_id", "concat('dev-', lpad(cast(dev as string), 3, '0')) as device_id", "cell_id", "m",
            f"{LAG} as lag_min",
            """case when event_type = 'error' and k < 5 then null
                    when event_type = 'click' and k = 99 then cast(5000 as double)
                    when dev = 11 and m between 30 and 44 then cast(0.1234 as double)
                    else floor(dose * 10000 + 0.5) / 10000 end as dose_rate_usv_h""",
            """case when value > 300 then floor((60 + value / 20) * 100 + 0.5) / 100
                    else floor((5 + value % 5) * 100 + 0.5) / 100 end as wind_speed_ms""",
            "cast(k as double) as battery",
            "cast(case when dev % 2 = 1 then (130 + k) / 10 end as double) as detector_temp_c",
            """array_compact(array(struct('wifi' as path, 0 as shift_s, 0 as more),
                 case when event_id % 37 = 0 then struct('wifi' as path, 0 as shift_s, 0 as more) end,
                 case when event_id % 41 = 0 then struct('lte' as path, 2 as shift_s, 1 as more) end)) as copies""")
        sent = rows.withColumn("copy", F.explode("copies"))
        return sent.selectExpr(
            "event_id", "device_id", "cell_id", "copy.path as ingestion_path", "dose_rate_usv_h", "wind_speed_ms",
            "battery", "detector_temp_c",
            f"case when {NO_EVENT_TIME} then null else timestamp_seconds({ORIGIN_S} + 60 * m + copy.shift_s) end as event_time",
            f"case when {NO_SENT_AT} then null else timestamp_seconds({ORIGIN_S} + 60 * (m + lag_min + copy.more) + copy.shift_s) end as sent_at")

    def device_cdc(self) -> DataFrame:
        orders = self.read("orders").selectExpr(
            "concat('dev-', lpad(cast(o_custkey % 500 as string), 3, '0')) as device_id", "o_orderkey as seq",
            "case when o_orderstatus = 'F' and o_orderpriority = '5-LOW' then 'DELETE' else 'UPDATE' end as op",
            "case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'v2' else 'v1' end as firmware",
            "case o_custkey % 3 when 0 then 'JP-07' when 1 then 'JP-08' else 'PL-22' end as jurisdiction_code",
            "explode(sequence(1, case when o_orderkey % 10 = 0 then 2 else 1 end)) as copy")
        return orders.drop("copy")

    def device_pos(self) -> DataFrame:
        return self.read("events").selectExpr("event_id % 50 as dev").distinct().selectExpr(
            "concat('dev-', lpad(cast(dev as string), 3, '0')) as device_id", "dev % 10 as cell_id",
            "cast(54.80 + 0.09 * (dev % 10) + 0.00213 * (dev % 7) as double) as lat",
            "cast(17.83 + 0.01937 * floor(dev / 10) as double) as lon")

    def weather(self) -> DataFrame:
        return self.read("orders").selectExpr(
            "o_orderkey % 4 as site_no", "cast(floor(o_orderkey / 4) as bigint) as hour_no",
            "floor(50 + o_totalprice % 1200 + 0.5) / 100 as wind_speed_10m",
            "(o_custkey * 37) % 360 as wind_direction_10m",
            "floor(65 + 1.3 * (o_totalprice % 1200) + 0.5) / 100 as wind_speed_100m",
            "(o_custkey * 37 + 10) % 360 as wind_direction_100m",
            """case when o_orderstatus = 'P' then floor((o_totalprice % 70) * 5 + 0.5) / 100
                    else cast(0 as double) end as precipitation""",
            "o_custkey % 101 as cloud_cover",
            """greatest(0, 900 - 150 * abs(cast(floor(o_orderkey / 4) as bigint) % 24 - 12)) as shortwave_radiation""")

    def grid_side(self) -> DataFrame:
        """One row: cells per grid side."""
        return self.read("part").selectExpr("cast(floor(sqrt(count(*))) as bigint) as side")

    def grid(self, tasks: int | None = None) -> DataFrame:
        """Cells of a site's grid. With ``tasks``, they lie by cell in so many tasks; only their keys are shuffled, the rest is worked out there."""
        side = F.broadcast(self.grid_side())   # exactly one row
        keys = self.read("part").select("p_partkey")
        cells = (keys if tasks is None else keys.repartition(tasks, "p_partkey")).join(side, F.col("p_partkey") < F.col("side") * F.col("side"))
        return cells.selectExpr(
            "p_partkey as cell_id", "p_partkey % side as ix", "cast(floor(p_partkey / side) as bigint) as iy",
            "cast(((p_partkey % side) + 0.5) * (200000.0 / side) - 100000 as double) as x_m",
            "cast((floor(p_partkey / side) + 0.5) * (200000.0 / side) - 100000 as double) as y_m")

    def cities(self) -> DataFrame:
        return self.read("customer").withColumn("site_no", F.expr("c_custkey % 4")).join(
            self.sites(), "site_no").selectExpr(
            "c_custkey as city_id", "c_name as city_name", "concat('GDANSK-', cast(c_custkey % 900 as string)) as aliases", "site_no",
            "cast(lat + 1.1 * ((c_custkey * 7919) % 2001 - 1000) / 1000.0 as double) as lat",
            "cast(lon + 1.4 * ((c_custkey * 104729) % 2001 - 1000) / 1000.0 as double) as lon",
            "1000 + 10 * cast(floor(abs(c_acctbal)) as bigint) as population")

    def population(self) -> DataFrame:
        return self.read("part").selectExpr(
            "p_partkey as pop_id", "cast(1200000 + (p_partkey * 7919) % 200000 as double) as x_moll",
            "cast(6300000 + (p_partkey * 104729) % 200000 as double) as y_moll", "cast(p_size * 10 as bigint) as people")

    def measurements(self) -> DataFrame:
        samples = self.read("lineitem").withColumn("site_no", F.expr("l_suppkey % 4")).join(self.sites(), "site_no")
        return samples.selectExpr(
            "l_orderkey", "l_linenumber", "site_no", "floor(l_extendedprice * 10 + 0.5) / 10000 as obs",
            "cast(lat + 0.8 * ((l_partkey * 7919) % 2001 - 1000) / 1000.0 as double) as lat",
            "cast(lon + 1.0 * ((l_partkey * 104729 + l_suppkey) % 2001 - 1000) / 1000.0 as double) as lon",
            "l_discount > 0.05 as is_wet", "l_shipdate as obs_time")

    def requests(self) -> DataFrame:
        return self.read("conversations").filter("role = 'user'").selectExpr(
            "conv_id * 1000 + turn as request_id", "conv_id % 6 as site_no", f"{ALIAS} as city_alias",
            "cast(37 as double) as threshold_kbq_m2")


# A device of five loses its connection every four hours for 5 to 45 minutes, and resends what it kept at one moment.
LAG = """case when dev % 5 = 4 and m % 240 >= 60 and m % 240 < 65 + (dev * 7) % 41 then 65 + (dev * 7) % 41 - m % 240
         when k < 80 then 0 else k - 80 end"""
NO_EVENT_TIME, NO_SENT_AT = "event_id % 1013 = 7", "event_id % 1009 = 5"
DOSE = """(cast(0.05 as double) + median) * (0.75 + 0.005 * k)
          * (case when dev = 7 and m between 60 and 180 then 1 + 0.01 * (m - 60) else 1 end)
          * (case when cell_id = 3 and m between 90 and 120 then 5 else 1 end)"""

# how a user turn spells a city: by its name in capitals, or by an alias with an accent that two cities may share
ALIAS = """case when conv_id % 3 = 0 then concat('CUSTOMER#', lpad(cast((conv_id * 31 + turn) % 200 as string), 9, '0'))
    else concat(' Gdańsk-', cast((conv_id * 7 + turn) % 1200 as string)) end"""

#: ``v_band``, the model's band, is entered by ``plans.model_band``.
VIEW_SQL = {
    "v_sites": ((), "select site_no, site_id, jurisdiction_code, cast(lat as double) as lat, cast(lon as double) as lon "
                    "from (values " + ", ".join(f"({n}, '{i}', '{j}', {la}, {lo})" for n, i, j, la, lo in SITES)
                + ") as t(site_no, site_id, jurisdiction_code, lat, lon)"),
    "v_readings": (("v_band",), f"""
        with b as (
          select event_id, event_id % 50 as dev, event_id % 10 as cell_id, cast(floor(event_id / 50) as bigint) as m,
                 cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k, event_type, value from events),
        d as (
          select b.*, {DOSE.replace("cell_id", "b.cell_id").replace("median", "v.median")} as dose
          from b join v_band v on v.cell_id = b.cell_id and v.hour_no = cast(floor(m / 60) as bigint)),
        r as (
          select event_id, concat('dev-', lpad(cast(dev as string), 3, '0')) as device_id, cell_id, m, k,
                 {LAG} as lag_min,
                 case when event_type = 'error' and k < 5 then null
                      when event_type = 'click' and k = 99 then cast(5000 as double)
                      when dev = 11 and m between 30 and 44 then cast(0.1234 as double)
                      else floor(dose * 10000 + 0.5) / 10000 end as dose_rate_usv_h,
                 case when value > 300 then floor((60 + value / 20) * 100 + 0.5) / 100
                      else floor((5 + value % 5) * 100 + 0.5) / 100 end as wind_speed_ms,
                 cast(k as double) as battery,
                 cast(case when dev % 2 = 1 then (130 + k) / 10 end as double) as detector_temp_c
          from d)
        select * replace (case when {NO_EVENT_TIME} then null else event_time end as event_time,
            case when {NO_SENT_AT} then null else sent_at end as sent_at) from (
        select event_id, device_id, cell_id, 'wifi' as ingestion_path, dose_rate_usv_h, wind_speed_ms, battery,
               detector_temp_c, timestamp '2011-03-14 00:00:00' + interval '1' minute * m as event_time,
               timestamp '2011-03-14 00:00:00' + interval '1' minute * (m + lag_min) as sent_at from r
        union all
        select event_id, device_id, cell_id, 'wifi', dose_rate_usv_h, wind_speed_ms, battery, detector_temp_c,
               timestamp '2011-03-14 00:00:00' + interval '1' minute * m,
               timestamp '2011-03-14 00:00:00' + interval '1' minute * (m + lag_min) from r where event_id % 37 = 0
        union all
        select event_id, device_id, cell_id, 'lte', dose_rate_usv_h, wind_speed_ms, battery, detector_temp_c,
               timestamp '2011-03-14 00:00:02' + interval '1' minute * m,
               timestamp '2011-03-14 00:00:02' + interval '1' minute * (m + lag_min + 1) from r where event_id % 41 = 0)"""),
    "v_device_cdc": ((), " union all ".join(f"""
        select concat('dev-', lpad(cast(o_custkey % 500 as string), 3, '0')) as device_id, o_orderkey as seq,
               case when o_orderstatus = 'F' and o_orderpriority = '5-LOW' then 'DELETE' else 'UPDATE' end as op,
               case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'v2' else 'v1' end as firmware,
               case o_custkey % 3 when 0 then 'JP-07' when 1 then 'JP-08' else 'PL-22' end as jurisdiction_code
        from orders{where}""" for where in ("", " where o_orderkey % 10 = 0"))),
    "v_device_pos": ((), """select concat('dev-', lpad(cast(dev as string), 3, '0')) as device_id, dev % 10 as cell_id,
               cast(54.80 + 0.09 * (dev % 10) + 0.00213 * (dev % 7) as double) as lat,
               cast(17.83 + 0.01937 * floor(dev / 10) as double) as lon
        from (select distinct event_id % 50 as dev from events) x"""),
    "v_meteo": ((), """select o_orderkey % 4 as site_no, cast(floor(o_orderkey / 4) as bigint) as hour_no,
               floor(50 + o_totalprice % 1200 + 0.5) / 100 as wind_speed_10m,
               (o_custkey * 37) % 360 as wind_direction_10m,
               floor(65 + 1.3 * (o_totalprice % 1200) + 0.5) / 100 as wind_speed_100m,
               (o_custkey * 37 + 10) % 360 as wind_direction_100m,
               case when o_orderstatus = 'P' then floor((o_totalprice % 70) * 5 + 0.5) / 100
                    else cast(0 as double) end as precipitation,
               o_custkey % 101 as cloud_cover,
               greatest(0, 900 - 150 * abs(cast(floor(o_orderkey / 4) as bigint) % 24 - 12)) as shortwave_radiation
        from orders"""),
    "v_grid": ((), """select p_partkey as cell_id, p_partkey % side as ix, cast(floor(p_partkey / side) as bigint) as iy,
               cast(((p_partkey % side) + 0.5) * (200000.0 / side) - 100000 as double) as x_m,
               cast((floor(p_partkey / side) + 0.5) * (200000.0 / side) - 100000 as double) as y_m
        from part cross join (select cast(floor(sqrt(count(*))) as bigint) as side from part) s
        where p_partkey < side * side"""),
    "v_cities": (("v_sites",), """select c_custkey as city_id, c_name as city_name, s.site_no,
               cast(s.lat + 1.1 * ((c_custkey * 7919) % 2001 - 1000) / 1000.0 as double) as lat,
               cast(s.lon + 1.4 * ((c_custkey * 104729) % 2001 - 1000) / 1000.0 as double) as lon,
               1000 + 10 * cast(floor(abs(c_acctbal)) as bigint) as population
        from customer join v_sites s on s.site_no = c_custkey % 4"""),
    "v_pop": ((), """select p_partkey as pop_id, cast(1200000 + (p_partkey * 7919) % 200000 as double) as x_moll,
               cast(6300000 + (p_partkey * 104729) % 200000 as double) as y_moll, cast(p_size * 10 as bigint) as people
        from part"""),
    "v_measurements": (("v_sites",), """select l_orderkey, l_linenumber, s.site_no, floor(l_extendedprice * 10 + 0.5) / 10000 as obs,
               cast(s.lat + 0.8 * ((l_partkey * 7919) % 2001 - 1000) / 1000.0 as double) as lat,
               cast(s.lon + 1.0 * ((l_partkey * 104729 + l_suppkey) % 2001 - 1000) / 1000.0 as double) as lon,
               l_discount > 0.05 as is_wet, l_shipdate as obs_time from lineitem join v_sites s on s.site_no = l_suppkey % 4"""),
    "v_requests": ((), f"""select conv_id * 1000 + turn as request_id, conv_id % 6 as site_no, {ALIAS} as city_alias,
               cast(37 as double) as threshold_kbq_m2 from conversations where role = 'user'"""),
}


def with_views(names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """SQL text that opens with the named views, those they need, and further named steps."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in VIEW_SQL[name][0]:
            add(needed)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    parts = [f"{name} as ({VIEW_SQL[name][1]})" for name in order]
    parts += [f"{name} as ({text})" for name, text in (extra or {}).items()]
    return "with " + ",\n".join(parts) + "\n" + body
