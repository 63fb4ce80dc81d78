"""The table a stream keeps up to date batch by batch: device versions.

Version ``batch_id + 1`` of a table is always computed from the newest older version, so a batch
that is retried after a failure starts from the same state and replaces its own result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leeward.operators.registry import scd2
from leeward.sources.tables import VersionedTable


def registry_writer(spark: SparkSession, root: str, key: str = "device_id", seq: str = "seq"):
    """``foreachBatch`` writer that keeps SCD2 versions from a change feed in any order.

    Changes are logged by batch; the versions of the devices a batch touches are rebuilt from their
    logged changes, all others are carried over. Late, repeated and reordered changes come out right.
    """
    table = VersionedTable(spark, f"{root}/versions")
    log = f"{root}/changes"

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{log}/batch={batch_id:09d}")
        changes = session.read.schema(batch.schema).parquet(f"{log}/batch=*")
        touched = session.read.schema(batch.schema).parquet(f"{log}/batch={batch_id:09d}").select(key).distinct()
        rebuilt = scd2(changes.join(touched, key, "left_semi"), key, seq)
        before = table.before(batch_id + 1)
        if before is not None:
            rebuilt = before.join(touched, key, "left_anti").unionByName(rebuilt)
        table.overwrite(rebuilt, batch_id + 1)
    return write, table
