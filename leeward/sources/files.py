"""Readers of landed files. All schemas are explicit; nothing is inferred."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from leeward import schemas
from leeward.config import Settings
from leeward.functions.numeric import holds
from leeward.session import staged


def with_provenance(df: DataFrame) -> DataFrame:
    """Adds the file a row came from and the time it was read."""
    return df.withColumn("source_file", F.col("_metadata.file_path")).withColumn("ingest_timestamp", F.current_timestamp())


def read_weather_files(spark: SparkSession, path: str) -> DataFrame:
    """Hourly weather as landed: one document per file, one array per variable."""
    return with_provenance(spark.read.schema(schemas.WEATHER_FILE).option("multiLine", True).json(path))


def gate_units(documents: DataFrame, unit: str = "m/s") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) documents by the unit of the wind speed. Nothing is converted."""
    good = holds(F.col("hourly_units.wind_speed_10m") == unit)
    return documents.filter(good), documents.filter(~good)


def explode_hours(documents: DataFrame) -> DataFrame:
    """One row per hour, with requested and returned coordinates. Landed times are UTC in any session."""
    rows = documents.select(
        "*", F.inline(F.arrays_zip(*[F.col(f"hourly.{name}").alias(name) for name in ("time", *schemas.HOURLY)])))
    kept = [c for c in ("source_file", "ingest_timestamp", "site_no") if c in documents.columns]
    return rows.select("req_lat", "req_lon", F.col("latitude").alias("grid_lat"), F.col("longitude").alias("grid_lon"),
                       F.col("elevation").alias("grid_elevation"), F.to_timestamp(F.concat("time", F.lit("Z")), "yyyy-MM-dd'T'HH:mm[:ss]X").alias("hour"),
                       *schemas.HOURLY, *kept)


def read_meteo(spark: SparkSession, path: str) -> DataFrame:
    """Hourly rows of the files that pass the unit gate."""
    accepted, _ = gate_units(read_weather_files(spark, path))
    return explode_hours(accepted)


def _csv(spark: SparkSession, path: str, schema: StructType, sep: str = ",") -> DataFrame:
    """Text with a header line that names the schema's columns in order; another header is an error, not shifted values."""
    return with_provenance(spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("sep", sep)
                           .option("mode", "PERMISSIVE").csv(path))


BAD = "_bad_line"


def with_rejects(spark: SparkSession, path: str, schema: StructType, sep: str | None = ",") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of delimited text with a header line, or of JSON lines where ``sep`` is None.

    A line whose values do not fit the schema, or that has too few or too many of them, is a reject: (source_file, line, ingest_timestamp). A
    file whose header names other columns is an error. Every line is in one of the two.
    """
    wide = StructType([*schema.fields, StructField(BAD, StringType())])
    reader = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
    found = reader.json(path) if sep is None else reader.option("header", True).option("enforceSchema", False).option("sep", sep).csv(path)
    # Parsed once, whole, into the landing table: a scan of fewer columns would not see every fault.
    found = staged(with_provenance(found), "landed")
    rejects = found.where(F.col(BAD).isNotNull()).select("source_file", F.col(BAD).alias("line"), "ingest_timestamp")
    return found.where(F.col(BAD).isNull()).drop(BAD), rejects


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.DOSE_POINT)


def read_deposition(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.DEPOSIT_SAMPLE)


def read_source_term(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.SOURCE_TERM)


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.CITY, sep="\t")


def read_population(spark: SparkSession, path: str, file_format: str = "csv") -> DataFrame:
    if file_format == "parquet":
        return with_provenance(spark.read.schema(schemas.POPULATION_POINT).parquet(path))
    return _csv(spark, path, schemas.POPULATION_POINT)


def read_device_cdc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DEVICE_CHANGE).json(path)


def site_dim(spark: SparkSession, sites: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(sites), "site_no long, site_id string, jurisdiction_code string, lat double, lon double")


def threshold_dim(spark: SparkSession, settings: Settings) -> DataFrame:
    rows = [(t.threshold_id, t.measure, float(t.value), t.nuclide) for t in settings.thresholds]
    return spark.createDataFrame(rows, "threshold_id string, measure string, value double, nuclide string")


def strict_ingest(df: DataFrame, schema: StructType, path_name: str) -> DataFrame:
    """Second ingest path with a fixed schema: any other column or type stops it."""
    have = {f.name: f.dataType for f in df.schema}
    want = {f.name: f.dataType for f in schema}
    if have != want:
        wrong = sorted(set(have.items()) ^ set(want.items()), key=str)
        raise ValueError(f"schema differs: {wrong}")
    return df.withColumn("ingestion_path", F.lit(path_name))
