"""Named queries over weather, geometry and the scenario space."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leeward.config import Physics
from leeward.functions import weather as wx
from leeward.functions.numeric import decay_factor, quantize
from leeward.operators import geometry, scenarios as space
from leeward.operators.dispersion import mass_balance as balance_of
from leeward.operators.rules import batch_rules, expect
from leeward.plans.catalog import q6, query
from leeward.sources.fixtures import Tables, with_views

PHYSICS = Physics()

CLASS = """case when shortwave_radiation > 0 then
    case when shortwave_radiation >= 925 then case when wind_speed_10m < 3 then 'A' when wind_speed_10m < 5 then 'B' else 'C' end
         when shortwave_radiation >= 675 then case when wind_speed_10m < 2 then 'A' when wind_speed_10m < 5 then 'B'
              when wind_speed_10m < 6 then 'C' else 'D' end
         when shortwave_radiation >= 175 then case when wind_speed_10m < 2 then 'B' when wind_speed_10m < 5 then 'C' else 'D' end
         else 'D' end
    when cloud_cover >= 50 then case when wind_speed_10m < 3 then 'E' else 'D' end
    else case when wind_speed_10m < 3 then 'F' when wind_speed_10m < 5 then 'E' else 'D' end end"""
HEIGHT = """case when wind_speed_10m > 0 and wind_speed_100m > 0
    then wind_speed_10m * pow({h} / 10.0, ln(wind_speed_100m / wind_speed_10m) / ln(10)) else wind_speed_10m end"""


def haversine(a: str, b: str) -> str:
    return (f"(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat))"
            f" * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))))")


def bearing(a: str, b: str) -> str:
    return (f"fmod(degrees(atan2(sin(radians({b}.lon - {a}.lon)) * cos(radians({b}.lat)), cos(radians({a}.lat)) * sin(radians({b}.lat))"
            f" - sin(radians({a}.lat)) * cos(radians({b}.lat)) * cos(radians({b}.lon - {a}.lon)))) + 360, 360)")


@query(with_views("v_meteo", f"""select site_no, hour_no,
    {q6('-wind_speed_10m * sin(radians(cast(wind_direction_10m as double)))')} as u,
    {q6('-wind_speed_10m * cos(radians(cast(wind_direction_10m as double)))')} as v,
    cast((wind_direction_10m + 180) % 360 as double) as plume_direction from v_meteo"""))
def meteo_uv(t: Tables) -> DataFrame:
    speed, came = F.col("wind_speed_10m"), F.col("wind_direction_10m")
    return t.weather().select("site_no", "hour_no", quantize(wx.wind_u(speed, came)).alias("u"),
                              quantize(wx.wind_v(speed, came)).alias("v"), wx.plume_direction(came).alias("plume_direction"))


@query(with_views("v_meteo", f"""select site_no, stability_class, is_day, count(*) as n_hours from (
    select site_no, {CLASS} as stability_class, cast(shortwave_radiation > 0 as bigint) as is_day from v_meteo) group by 1, 2, 3"""))
def stability_classes(t: Tables) -> DataFrame:
    cls = wx.stability_class(F.col("wind_speed_10m"), F.col("shortwave_radiation"), F.col("cloud_cover"))
    return (t.weather().select("site_no", cls.alias("stability_class"),
                               (F.col("shortwave_radiation") > 0).cast("bigint").alias("is_day"))
            .groupBy("site_no", "stability_class", "is_day").agg(F.count(F.lit(1)).alias("n_hours")))


@query(with_views("v_meteo", f"""select site_no, hour_no, {q6(HEIGHT.format(h=20.0))} as wind_20m,
    {q6(HEIGHT.format(h=60.0))} as wind_60m from v_meteo"""))
def wind_at_height(t: Tables) -> DataFrame:
    low, high = F.col("wind_speed_10m"), F.col("wind_speed_100m")
    return t.weather().select("site_no", "hour_no", quantize(wx.wind_at_height(low, high, 20.0)).alias("wind_20m"),
                              quantize(wx.wind_at_height(low, high, 60.0)).alias("wind_60m"))


@query(with_views("v_meteo", """select site_no, count(*) as n_hours, count(*) filter (wind_speed_10m * 12 between 0 and 120)
    as n_kept from v_meteo group by 1"""))
def batch_wind_rule(t: Tables) -> DataFrame:
    """The batch wind expectation, on speeds scaled so that some hours break it."""
    df = t.weather().withColumn("wind_speed_10m", F.col("wind_speed_10m") * 12)
    condition, level = batch_rules()["wind_physical"]
    kept = expect(df, "wind_physical", condition, level).groupBy("site_no").agg(F.count(F.lit(1)).alias("n_kept"))
    return df.groupBy("site_no").agg(F.count(F.lit(1)).alias("n_hours")).join(kept, "site_no")


@query(with_views("v_meteo", f"""select stability, count(*) as n_hours, {q6('max(err)')} as worst_error,
    count(*) filter (err < 0.05) as n_within from (select stability, abs(
      list_sum(list_transform(range(-20, 21), lambda i: exp(-0.5 * pow(i * 0.25, 2)) * 0.25 * s_y))
      * list_sum(list_transform(range(0, 40), lambda i: (exp(-pow((i + 0.5) * dz - 20, 2) / (2 * s_z * s_z))
          + exp(-pow((i + 0.5) * dz + 20, 2) / (2 * s_z * s_z))) * dz)) / (2 * pi() * s_y * s_z) - 1) as err
      from (select *, (s_z * 5 + 20) / 40.0 as dz from (select stability,
        case stability when 'A' then 0.22 when 'B' then 0.16 when 'C' then 0.11 when 'D' then 0.08 when 'E' then 0.06 else 0.04 end
          * 5000.0 / sqrt(1 + 0.0001 * 5000) as s_y,
        least(1500.0, case stability when 'A' then 0.2 * 5000 when 'B' then 0.12 * 5000 when 'C' then 0.08 * 5000 / sqrt(1 + 0.0002 * 5000)
          when 'D' then 0.06 * 5000 / sqrt(1 + 0.0015 * 5000) when 'E' then 0.03 * 5000 / (1 + 0.0003 * 5000)
          else 0.016 * 5000 / (1 + 0.0003 * 5000) end) as s_z
        from (select {CLASS} as stability from v_meteo)))) group by 1"""))
def mass_balance(t: Tables) -> DataFrame:
    out = balance_of(t.weather(), PHYSICS, 5000.0)
    return out.groupBy("stability").agg(
        F.count(F.lit(1)).alias("n_hours"), quantize(F.max("balance_error")).alias("worst_error"),
        F.count_if(F.col("balance_error") < 0.05).alias("n_within"))


CITY_PAIRS = f"""select s.site_no, c.city_id, c.population, {haversine('s', 'c')} as distance_km, {bearing('s', 'c')} as bearing_deg,
    (c.lon - s.lon) * 111194.92664455873 * cos(radians(s.lat)) as x_m, (c.lat - s.lat) * 111194.92664455873 as y_m
    from v_sites s, v_cities c where {haversine('s', 'c')} <= 100"""


@query(with_views("v_sites v_cities", f"""select site_no, city_id, {q6('distance_km')} as distance_km, {q6('bearing_deg')} as bearing_deg,
    cast(floor(fmod(bearing_deg + 11.25, 360) / 22.5) as bigint) as sector from near""", {"near": CITY_PAIRS}))
def city_geo(t: Tables) -> DataFrame:
    from leeward.functions.geo import sector_of
    out = geometry.site_cities(t.sites(), t.cities(), 100.0)
    return out.select("site_no", "city_id", quantize(F.col("distance_km")).alias("distance_km"),
                      quantize(F.col("bearing_deg")).alias("bearing_deg"), sector_of(F.col("bearing_deg")).alias("sector"))


@query(with_views("v_sites v_cities", """select site_no, city_id,
    case when ix >= 0 and ix < side and iy >= 0 and iy < side then iy * side + ix end as cell_id from (
    select c.site_no, c.city_id, side,
      cast(floor(((c.lon - s.lon) * 111194.92664455873 * cos(radians(s.lat)) + 100000.0) / (200000.0 / side)) as bigint) as ix,
      cast(floor(((c.lat - s.lat) * 111194.92664455873 + 100000.0) / (200000.0 / side)) as bigint) as iy
    from v_cities c join v_sites s on s.site_no = c.site_no,
      (select cast(floor(sqrt(count(*))) as bigint) as side from part))"""))
def city_cells(t: Tables) -> DataFrame:
    side = t.grid_side().scalar()
    out = geometry.snap_to_cells(t.cities(), t.sites(), side)
    return out.select("site_no", "city_id", "cell_id")


@query(with_views("v_pop", f"""select pop_id, {q6('degrees(lon)')} as lon, {q6('degrees(lat)')} as lat from projected""", {
    "turned": "select *, asin(y_moll / (6378137.0 * sqrt(2))) as theta from v_pop",
    "projected": """select pop_id, people, asin((2 * theta + sin(2 * theta)) / pi()) as lat,
        pi() * x_moll / (2 * sqrt(2) * 6378137.0 * cos(theta)) as lon from turned"""}))
def mollweide(t: Tables) -> DataFrame:
    out = geometry.population_points(t.population(), "x_moll", "y_moll")
    return out.select("pop_id", quantize(F.col("lon")).alias("lon"), quantize(F.col("lat")).alias("lat"))


@query(with_views("v_pop v_sites", """select cast(3 as bigint) as site_no, iy * side + ix as cell_id, cast(sum(people) as bigint) as people, count(*) as n_points
    from (select people, side, cast(floor(((degrees(lon) - 17.83) * 111194.92664455873 * cos(radians(54.81)) + 100000.0) / (200000.0 / side)) as bigint) as ix,
      cast(floor(((degrees(lat) - 54.81) * 111194.92664455873 + 100000.0) / (200000.0 / side)) as bigint) as iy
    from projected, (select cast(floor(sqrt(count(*))) as bigint) as side from part))
    where ix >= 0 and ix < side and iy >= 0 and iy < side group by 1, 2""", {
    "turned": "select *, asin(y_moll / (6378137.0 * sqrt(2))) as theta from v_pop",
    "projected": """select pop_id, people, asin((2 * theta + sin(2 * theta)) / pi()) as lat,
        pi() * x_moll / (2 * sqrt(2) * 6378137.0 * cos(theta)) as lon from turned"""}))
def cell_population(t: Tables) -> DataFrame:
    points = geometry.population_points(t.population(), "x_moll", "y_moll").withColumn("site_no", F.lit(3).cast("long"))
    return geometry.population_to_cells(points, t.sites(), t.grid_side().scalar())


def u_sql(seed: str, *key: str) -> str:
    text = ", ".join(f"cast({k} as varchar)" for k in key)
    return f"(cast(concat('0x', substr(md5(concat_ws('-', '{seed}', {text})), 1, 8)) as bigint) / 4294967296.0)"


SPACE = {
    "site_hours": "select site_no, max(hour_no) + 1 as n_hours from v_meteo group by 1",
    "episodes": f"""select site_no, episode_id, cast(floor({u_sql('42', 'site_no', 'episode_id')} * (n_hours - 72 + 1)) as bigint)
        as start_hour from (select site_no, n_hours, unnest(range(n_hours // 72)) as episode_id from site_hours)""",
    "variants": f"""select i as variant_id, cast(floor({u_sql('42v', 'i')} * 3) - 1 as bigint) as class_shift,
        exp(0.5 * sqrt(-2.0 * ln(greatest({u_sql('42da', 'i')}, 1e-12))) * cos(6.283185307179586 * {u_sql('42db', 'i')})) as dep_factor
        from (select unnest(range({{n}})) as i)""",
    "episode_hours": """select e.site_no, e.episode_id, h as hour_in_episode, m.* exclude (site_no)
        from (select *, unnest(range(72)) as h from episodes) e
        join v_meteo m on m.site_no = e.site_no and m.hour_no = e.start_hour + h"""}


def space_sql(n_variants: int) -> dict[str, str]:
    return {name: text.replace("{n}", str(n_variants)) for name, text in SPACE.items()}


def grown_draw():
    """As many episodes as fit into the record end to end, so the draw grows with the weather."""
    return F.floor(F.col("n_hours") / 72)


@query(with_views("v_meteo", f"""select site_no, episode_id, start_hour, variant_id, class_shift, {q6('dep_factor')} as dep_factor
    from episodes, variants""", space_sql(5)))
def draw_scenarios(t: Tables) -> DataFrame:
    episodes = space.draw_episodes(space.site_hours(t.weather()), grown_draw(), 42)
    out = space.draw_variants(episodes, 5, 42)
    return out.withColumn("dep_factor", quantize(F.col("dep_factor")))


@query(with_views("v_meteo", f"""select site_no, episode_id, count(*) as n_hours, {q6('sum(precipitation)')} as rain,
    {q6('avg(wind_speed_10m)')} as mean_wind, min(hour_no) as first_hour from episode_hours group by 1, 2""", space_sql(5)))
def episode_meteo(t: Tables) -> DataFrame:
    weather = t.weather()
    episodes = space.draw_episodes(space.site_hours(weather), grown_draw(), 42)
    out = space.episode_weather(episodes, weather)
    return out.groupBy("site_no", "episode_id").agg(
        F.count(F.lit(1)).alias("n_hours"), quantize(F.sum("precipitation")).alias("rain"),
        quantize(F.avg("wind_speed_10m")).alias("mean_wind"), F.min("hour_no").alias("first_hour"))


@query(with_views("v_measurements", f"""select site_no, nuclide, count(*) as n_samples, {q6('sum(left_over)')} as decayed,
    count(*) filter (left_over > obs) as n_risen from (
    select m.site_no, n.nuclide, m.obs, m.obs * exp(-0.6931471805599453 * date_diff('day', cast(obs_time as date), date '2002-01-01') / n.days) as left_over
    from v_measurements m, (values ('Cs-137', 30.08 * 365.25), ('I-131', 8.0252)) as n(nuclide, days)) group by 1, 2"""))
def decay(t: Tables) -> DataFrame:
    """Samples brought to a common date; a later date never holds more."""
    parts = F.array(*[F.struct(F.lit(n.name).alias("nuclide"), F.lit(n.half_life_s).alias("half_life_s"))
                      for n in PHYSICS.nuclides])
    rows = t.measurements().select("site_no", "obs", "obs_time", F.inline(parts))
    age = F.datediff(F.lit("2002-01-01").cast("date"), F.col("obs_time").cast("date")) * F.lit(86400.0)
    rows = rows.withColumn("left_over", F.col("obs") * decay_factor(age, F.col("half_life_s")))
    return rows.groupBy("site_no", "nuclide").agg(
        F.count(F.lit(1)).alias("n_samples"), quantize(F.sum("left_over")).alias("decayed"),
        F.count_if(F.col("left_over") > F.col("obs")).alias("n_risen"))


@query(with_views("v_meteo", """select site_no, cast(cast(utc + interval '1' hour * (case when site_no < 3 then 9
      when utc >= spring and utc < autumn then 2 else 1 end) as date) as varchar) as local_date, count(*) as n_hours from (
    select *, last_day(make_date(year(utc), 3, 1)) - cast(dayofweek(last_day(make_date(year(utc), 3, 1))) as integer) + interval '1' hour as spring,
      last_day(make_date(year(utc), 10, 1)) - cast(dayofweek(last_day(make_date(year(utc), 10, 1))) as integer) + interval '1' hour as autumn
    from (select site_no, timestamp '2011-03-14 00:00:00' + interval '1' hour * hour_no as utc from v_meteo)) group by 1, 2"""))
def local_time(t: Tables) -> DataFrame:
    """Hours per local calendar day; stored times stay UTC."""
    zone = F.when(F.col("site_no") == 3, "Europe/Warsaw").otherwise("Asia/Tokyo")
    start = F.lit("2011-03-14 00:00:00").cast("timestamp_ntz")
    utc = start + F.make_dt_interval(hours=F.col("hour_no").cast("int"))
    local = F.convert_timezone(F.lit("UTC"), zone, utc)
    return (t.weather().select("site_no", local.cast("date").cast("string").alias("local_date"))
            .groupBy("site_no", "local_date").agg(F.count(F.lit(1)).alias("n_hours")))
