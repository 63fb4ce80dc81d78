"""Streaming sensor path: file source, additive schemas, routing, sinks, metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from leeward import schemas
from leeward.config import Limits
from leeward.functions.numeric import holds
from leeward.operators.late import dedup_exact, with_route
from leeward.operators.rules import apply_rules, reading_rules


def stream_readings(spark: SparkSession, folder: str, schema: StructType = schemas.READING,
                    max_files: int | None = 1) -> DataFrame:
    """Landed JSON lines with an explicit schema."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(folder)


def stream_lines(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Landed lines as text, for feeds whose fields may grow."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(folder)


def evolve(lines: DataFrame, known: StructType, column: str = "value") -> DataFrame:
    """Typed columns for the known fields, and the whole record as a variant in ``payload``.

    A field that newer firmware adds is kept in the payload from its first day, and becomes a
    column once the schema names it; neither stops the stream. Lines that are no JSON have a
    NULL payload.
    """
    parsed = lines.withColumn("payload", F.try_parse_json(F.col(column)))
    typed = [F.try_variant_get("payload", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in known]
    return parsed.select(*typed, "payload")


def write_bronze(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append-only raw table."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def stream_bronze(stream: DataFrame) -> DataFrame:
    """What the raw table keeps of each landed row: all of it, and a number of its own by which later tables are held against it.

    The number is drawn when the row is written; the sink commits a batch once, so a row has one number however often its batch is tried.
    """
    return stream.withColumn("bronze_id", F.expr("uuid()"))


def account(bronze: DataFrame, routed: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Every row of ``bronze`` with exactly one ``route``, by holding it against what the stream ``routed``.

    clean, refused, late, bad_timestamp: as routed. duplicate: another copy of the reading stands for it, the one that was sent first as
    in batch. behind_watermark: on time by its own lag, but its file landed after the deduplication had moved on, so no copy
    of it came through; it is a reading like any other and carries its ``reasons``. The choice per reading is a merged minimum.
    """
    key = ["device_id", "event_time"]
    came = routed.select("bronze_id", F.lit(True).alias("came"))
    rows = apply_rules(with_route(bronze.join(came, "bronze_id", "left"), limits.max_lag_minutes), reading_rules(limits))
    chosen = rows.filter("route = 'on_time'").groupBy(*key).agg(
        F.min(F.struct("sent_at", "ingestion_path", "bronze_id")).alias("first"), F.bool_or(holds(F.col("came"))).alias("through"))
    rows = rows.join(chosen.select(F.col("first.bronze_id").alias("bronze_id"), "through"), "bronze_id", "left")
    passed = F.when(F.size("reasons") == 0, "clean").otherwise("refused")
    route = (F.when(F.col("route") != "on_time", F.col("route")).when(F.col("through").isNull(), "duplicate")
             .when(~F.col("through"), "behind_watermark").otherwise(passed))
    return rows.withColumn("route", route).drop("came", "through")


def routed(stream: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Every reading with its destination in ``route``: clean, refused, late or bad_timestamp.

    Lateness is decided row by row before the deduplication, whose state then holds on-time
    readings only and is bounded by the watermark.
    """
    df = apply_rules(with_route(stream, limits.max_lag_minutes), reading_rules(limits))
    return _once(df, limits).unionByName(df.filter("route <> 'on_time'"))


def on_time_once(stream: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The part of ``routed`` that keeps state: one row per on-time reading, clean or refused."""
    return _once(apply_rules(with_route(stream, limits.max_lag_minutes), reading_rules(limits)), limits)


def _once(df: DataFrame, limits: Limits) -> DataFrame:
    once = dedup_exact(df.filter("route = 'on_time'"), watermark_minutes=limits.dedup_watermark_minutes)
    return once.withColumn("route", F.when(F.size("reasons") == 0, "clean").otherwise("refused"))


def write_routed(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """One file sink, partitioned by route: each destination is a folder, written exactly once.

    The sink's commit log takes care of retried batches; no batch is computed more than once.
    """
    return (df.writeStream.format("parquet").partitionBy("route").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append"))


def tables_by_batch(root: str, routes: tuple[str, ...] = ("clean", "refused", "late", "bad_timestamp")) -> Callable:
    """``foreachBatch`` writer into one table per route, each batch in a folder of its own number.

    A retried batch overwrites its own folder. For sinks that need separate tables.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for route in routes:
                batch.filter(F.col("route") == route).write.mode("overwrite").parquet(f"{root}/{route}/batch={batch_id}")
        finally:
            batch.unpersist()
    return write


def run_available(writer: DataStreamWriter) -> StreamingQuery:
    """Process what is there and stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def clean_share_stream(df: DataFrame, window_minutes: int = 60, delay_minutes: int = 60) -> DataFrame:
    """Share of clean readings per tumbling window, emitted once the watermark has passed it.

    A device resends up to 45 minutes after an outage, and each reading may lag 15 more: an hour loses none of them.
    """
    window = F.window("event_time", f"{window_minutes} minutes")
    out = df.withWatermark("event_time", f"{delay_minutes} minutes").groupBy(window).agg(
        F.count(F.lit(1)).alias("n_readings"), F.count_if(F.col("route") == "clean").alias("n_clean"))
    return out.select(F.unix_seconds("window.start").alias("window_s"), "n_readings", "n_clean",
                      (F.col("n_clean") / F.col("n_readings")).alias("clean_share"))
