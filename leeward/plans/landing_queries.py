"""Named queries that land a derived input as files, some lines damaged, read it back and account for every line."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leeward import schemas
from leeward.functions.numeric import quantize
from leeward.operators import alerts, late
from leeward.plans.catalog import q3, query
from leeward.session import fresh_path
from leeward.sources import files
from leeward.sources.fixtures import ORIGIN_S, Tables, with_views

FILES = 3
EVERY = 97          # of so many lines, one is damaged


def dealt(rows: DataFrame) -> DataFrame:
    """Rows with the delivery they land in. Each task deals its own, so no task takes a whole delivery."""
    return rows.withColumn("delivery", F.monotonically_increasing_id() % FILES)


def landed(t: Tables, rows: DataFrame, number: str, damaged: str, sep: str = ",") -> str:
    """``rows`` as deliveries of delimited text, in as many parts as there are tasks; where ``number`` is divisible by ``EVERY``, the value of ``damaged`` is no number."""
    path = fresh_path(t.spark, "landed")
    text = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])
    text = text.withColumn(damaged, F.when(F.col(number).cast("long") % EVERY == 0, "n/a").otherwise(F.col(damaged)))
    text = text.drop(*[c for c in (number,) if c.startswith("k_")])
    dealt(text).write.partitionBy("delivery").option("header", True).option("sep", sep).csv(path)
    return f"{path}/delivery=*"


def told(parts: tuple[DataFrame, DataFrame], value: str) -> DataFrame:
    """Lines read, lines rejected, deliveries they came from, and a sum over what was read."""
    rows, rejects = parts
    source = F.regexp_extract("source_file", "delivery=[0-9]+", 0).alias("source")
    good = rows.select(F.lit(0).alias("bad"), source, F.col(value).cast("double").alias("value"))
    bad = rejects.select(F.lit(1).alias("bad"), source, F.lit(None).cast("double").alias("value"))
    return good.unionByName(bad).agg(
        F.count_if(F.col("bad") == 0).alias("n_rows"), F.count_if(F.col("bad") == 1).alias("n_rejects"),
        F.count_distinct("source").alias("n_files"), quantize(F.sum("value"), 3).alias("total"))


def told_sql(view: str, number: str, value: str) -> str:
    sound = f"{number} % {EVERY} <> 0"
    return with_views(view, f"""select count(*) filter ({sound}) as n_rows, count(*) filter (not {sound}) as n_rejects, cast({FILES} as bigint) as n_files,
        {q3(f'sum(case when {sound} then cast({value} as double) end)')} as total from {view}""")


@query(told_sql("v_measurements", "l_orderkey", "obs"))
def landed_measurements(t: Tables) -> DataFrame:
    rows = t.measurements().select("lat", "lon", F.lit("2011-03-15T00:00:00Z").alias("measured_at"), F.col("obs").alias("dose_rate_usv_h"), F.col("l_orderkey").alias("k_no"))
    return told(files.with_rejects(t.spark, landed(t, rows, "k_no", "dose_rate_usv_h"), schemas.DOSE_POINT), "dose_rate_usv_h")


@query(told_sql("v_measurements", "l_orderkey", "obs"))
def landed_deposition(t: Tables) -> DataFrame:
    medium = F.when(F.col("is_wet"), "soil").otherwise("airborne")
    rows = t.measurements().select("lat", "lon", F.lit("2011-03-15T00:00:00Z").alias("sampled_at"), medium.alias("medium"), F.lit("Cs-137").alias("nuclide"),
                                   F.col("obs").alias("kbq_m2"), F.col("l_orderkey").alias("k_no"))
    return told(files.with_rejects(t.spark, landed(t, rows, "k_no", "lat"), schemas.DEPOSIT_SAMPLE), "kbq_m2")


@query(told_sql("v_meteo", "(site_no + 4 * hour_no)", "wind_speed_10m"))
def landed_source_term(t: Tables) -> DataFrame:
    hour = F.date_format(F.timestamp_seconds(F.lit(ORIGIN_S) + F.col("hour_no") * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = t.weather().select(F.lit("I-131").alias("nuclide"), hour.alias("hour"), F.col("wind_speed_10m").alias("source_term_bq"),
                              (F.col("site_no") + 4 * F.col("hour_no")).alias("k_no"))
    return told(files.with_rejects(t.spark, landed(t, rows, "k_no", "source_term_bq"), schemas.SOURCE_TERM), "source_term_bq")


@query(told_sql("v_cities", "city_id", "population"))
def landed_cities(t: Tables) -> DataFrame:
    rows = t.cities().select("city_id", F.col("city_name").alias("name"), "aliases", "lat", "lon", "population")
    return told(files.with_rejects(t.spark, landed(t, rows, "city_id", "population", "\t"), schemas.CITY, "\t"), "population")


@query(told_sql("v_pop", "pop_id", "people"))
def landed_population(t: Tables) -> DataFrame:
    rows = t.population().select(F.col("x_moll").alias("x"), F.col("y_moll").alias("y"), F.col("people").cast("double").alias("people"), F.col("pop_id").alias("k_no"))
    return told(files.with_rejects(t.spark, landed(t, rows, "k_no", "x"), schemas.POPULATION_POINT), "people")


@query(told_sql("v_device_cdc", "seq", "seq"))
def landed_device_feed(t: Tables) -> DataFrame:
    """JSON lines; a damaged one breaks off in the middle."""
    path = fresh_path(t.spark, "landed")
    line = F.to_json(F.struct("device_id", "seq", "op", "firmware", "jurisdiction_code"))
    lines = t.device_cdc().select(F.when(F.col("seq") % EVERY == 0, F.substring(line, 1, 30)).otherwise(line).alias("value"))
    dealt(lines).write.partitionBy("delivery").text(path)
    return told(files.with_rejects(t.spark, f"{path}/delivery=*", schemas.DEVICE_CHANGE, None), "seq")


@query(with_views("v_readings", """select ingestion_path, count(*) as n_readings, count(detector_temp_c) as n_with_temp from (
    select ingestion_path, detector_temp_c from v_readings where ingestion_path = 'wifi'
    union all select 'direct', null from v_readings where ingestion_path = 'lte') group by 1"""))
def strict_paths(t: Tables) -> DataFrame:
    """The file path with its newer field, and a direct path that takes the fixed schema only, in one table."""
    readings = t.readings()
    fixed = readings.where("ingestion_path = 'lte'").select(*schemas.READING.fieldNames())
    direct = files.strict_ingest(fixed, schemas.READING, "direct")
    both = late.union_paths(readings.where("ingestion_path = 'wifi'"), direct)
    return both.groupBy("ingestion_path").agg(F.count(F.lit(1)).alias("n_readings"), F.count("detector_temp_c").alias("n_with_temp"))


@query(with_views("v_readings", """select cell_id, n_readings, cast(1 as bigint) as within_bound from (
    select cell_id, count(*) as n_readings from v_readings where event_time is not null group by 1)"""))
def device_sketches(t: Tables) -> DataFrame:
    """Hourly sketches, stored and united over all hours: within 5 percent of the exact count (three standard errors at this size)."""
    path = fresh_path(t.spark, "sketches")
    alerts.hourly_sketches(t.readings()).write.parquet(path)
    united = alerts.distinct_devices(t.spark.read.parquet(path), ["cell_id"])
    exact = t.readings().where("event_time is not null").groupBy("cell_id").agg(F.count_distinct("device_id").alias("exact"))
    near = F.abs(F.col("n_devices") - F.col("exact")) <= F.greatest(F.lit(0.05) * F.col("exact"), F.lit(0.5))
    return united.join(exact, "cell_id").select("cell_id", "n_readings", near.cast("bigint").alias("within_bound"))
