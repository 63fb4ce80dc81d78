"""Two-pass external shuffle into shards whose row counts differ by one at most.

Pass one scatters the rows by a seeded hash into so many buckets that each fits into a task's memory.
Pass two reads one bucket per task, puts it into a fixed order and Fisher-Yates shuffles it
(Spark's ``shuffle`` of an array). A bucket's start, the count of rows in the buckets before it, turns a
place in a bucket into a place in the whole order, and rows are dealt to the shards in that order.

Nulls: a null text has no bytes and crc32 0; a null in any other column is just a value. Copies of a text
scatter by their ids; rows that agree in id and text as well share a bucket. No rows give an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leeward.llm.shared import ident, staged, unused

OVERHEAD = 16
BROADCAST_BUCKETS = 1_000_000


def size_of(text: Column) -> Column:
    """Bytes of a text (none for null) and of what is stored beside it."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(OVERHEAD)


def shuffled(docs: DataFrame, *, shards: int = 40, seed: int = 17, text_column: str = "text",
             id_column: str = "doc_id", bucket_bytes: int = 16 << 20) -> DataFrame:
    """Rows of ``docs`` as struct ``r``, with ``shard`` and ``slot`` (gapless from 0 in each shard); reruns agree.

    ``bucket_bytes`` is what one task holds in memory. The rows travel once.
    """
    bytes_total = docs.agg(F.sum(size_of(ident(docs, text_column))).alias("n")).first()["n"] or 0
    buckets = max(1, math.ceil(bytes_total / bucket_bytes))
    row, key, bucket = unused(docs, "row"), unused(docs, "key"), unused(docs, "bucket")
    columns = [ident(docs, c) for c in docs.columns]
    keyed = docs.select(F.struct(*columns).alias(row),
                        F.xxhash64(F.lit(seed), ident(docs, id_column), ident(docs, text_column)).alias(key))
    keyed = keyed.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), F.lit(buckets)).cast("int"))
    mixed = (keyed.repartitionById(buckets, bucket).groupBy(bucket)
             .agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(row).alias("r"))).alias("rows"),
                  F.count(F.lit(1)).alias("n")))
    ordered = F.array_sort("rows", lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
    mixed = mixed.select(bucket, "n", F.shuffle(ordered, seed).alias("rows"))
    written = staged(mixed.select(bucket, "n", F.posexplode("rows").alias("place", "item")), "shuffled")
    starts = (written.where("place = 0").select(F.col(bucket).alias("b"), "n")
              .withColumn("start", F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)))
              .select("b", F.coalesce("start", F.lit(0)).alias("start")))
    if buckets <= BROADCAST_BUCKETS:                    # one row of two numbers per bucket; beyond that, the join shuffles
        starts = F.broadcast(starts)
    placed = written.join(starts, written[bucket] == starts["b"])
    order = F.col("start") + F.col("place")
    shard = F.pmod(order, F.lit(shards))
    return placed.select(F.col("item.r").alias("r"), shard.cast("int").alias("shard"),
                         ((order - shard) / shards).cast("long").alias("slot"))


def write_shards(frame: DataFrame, path: str) -> None:
    """One folder per shard; a reader that sorts a shard by ``slot`` has the shuffled order."""
    frame.select("r.*", "shard", "slot").write.partitionBy("shard").parquet(path)
