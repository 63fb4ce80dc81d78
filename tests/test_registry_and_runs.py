from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from support import rows
from leeward.operators import registry, runs
from leeward.session import fresh_path
from leeward.sources.tables import VersionedTable, write_partitioned

FEED = "device_id string, seq long, op string, firmware string"
CHANGES = [("a", 1, "INSERT", "v1"), ("a", 5, "UPDATE", "v2"), ("a", 9, "DELETE", "v2"), ("a", 12, "INSERT", "v3"),
           ("b", 2, "INSERT", "v1"), ("b", 2, "INSERT", "v1")]
WANT = [("a", 1, 5, "v1", False), ("a", 12, None, "v3", True), ("a", 5, 9, "v2", False), ("b", 2, None, "v1", True)]


def test_scd2_any_order_any_slice(spark):
    for width in (1, 4, 1000):
        for data in (CHANGES, CHANGES[::-1]):
            out = registry.scd2(spark.createDataFrame(data, FEED), seq_width=width)
            assert rows(out, "device_id", "start_seq", "end_seq", "firmware", "is_current") == WANT


def test_as_of_matches_interval_join(spark):
    versions = registry.scd2(spark.createDataFrame(CHANGES, FEED))
    reads = spark.createDataFrame([(d, t) for d in ("a", "b", "c") for t in range(0, 20)] * 2, "device_id string, t long")
    want = reads.join(versions.select("device_id", "firmware", "start_seq", "end_seq"),
                      (reads.device_id == versions.device_id) & (F.col("t") >= F.col("start_seq"))
                      & (F.col("end_seq").isNull() | (F.col("t") < F.col("end_seq"))), "left").select(reads.device_id, "t", "firmware")
    for width in (1, 3, 1000):
        got = registry.as_of(reads, versions, F.col("t"), ["firmware"], width=width)
        assert rows(got, "device_id", "t", "firmware") == rows(want, "device_id", "t", "firmware")


def test_upsert_is_repeatable(spark):
    table = VersionedTable(spark, fresh_path(spark, "u"))
    first = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("b", 2, "z")], "k string, seq long, v string")
    second = spark.createDataFrame([("b", 3, "w"), ("c", 1, "q"), ("a", 0, "old")], "k string, seq long, v string")
    for update in (first, second, second):
        table.upsert(update, ["k"], ["seq"])
    assert rows(table.read(), "k", "seq", "v") == [("a", 1, "x"), ("b", 3, "w"), ("c", 1, "q")]
    assert table.versions() == [2, 3]


def test_unfinished_write_is_invisible(spark):
    table = VersionedTable(spark, fresh_path(spark, "u"))
    df = spark.range(3)
    table.overwrite(df)
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(table.folder(2))
    assert table.versions() == [1] and table.read().count() == 3


def test_repeated_writes_of_one_version_keep_what_they_start_from(spark):
    table = VersionedTable(spark, fresh_path(spark, "u"))
    for version in (1, 2):
        table.overwrite(spark.range(version), version)
    for _ in range(4):
        assert table.before(3).count() == 2
        table.overwrite(table.before(3).union(spark.range(1)), 3)
    assert table.versions() == [2, 3] and table.read().count() == 3


def test_shared_folder_is_asked_for_on_a_cluster():
    from leeward.session import require_single_process
    for master in ("local", "local[8]", "local[*]"):
        require_single_process(master)
    for master in ("local-cluster[2,1,1024]", "yarn", "spark://host:7077", "k8s://host"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            require_single_process(master)


def test_checksum_tells_rows_apart(spark):
    def sums(*pairs):
        return runs.checksum(spark.createDataFrame(list(pairs), "a string, b string")).first()["checksum"]
    rows_ = [("a|b", "c"), ("a", "b|c"), (None, ""), ("", None), ("", ""), (None, None), ("-", ""), ("1:a", "")]
    assert len({sums(r) for r in rows_}) == len(rows_)


def test_checksum_and_difference(spark):
    a = spark.range(1000).select("id", (F.col("id") % 7).cast("string").alias("s"))
    b = a.repartition(13).orderBy(F.desc("id"))
    assert runs.checksum(a).first() == runs.checksum(b).first() and runs.fast_checksum(a).first() == runs.fast_checksum(b).first()
    assert rows(runs.run_difference(a, b), "only_left", "only_right") == [(0, 0)]
    c = a.filter("id > 2").unionByName(a.filter("id = 5")).unionByName(a.limit(0))
    assert rows(runs.run_difference(a, c), "n_left", "n_right", "only_left", "only_right") == [(1000, 998, 3, 1)]
    d = a.withColumn("s", F.when(F.col("id") == 4, "changed").otherwise(F.col("s")))
    assert rows(runs.diff_runs(a, d.filter("id < 999"), ["id"]).groupBy("status").count(), "status", "count") == [
        ("changed", 1), ("only_left", 1), ("same", 998)]


def test_partitioned_layout(spark):
    path = fresh_path(spark, "p")
    write_partitioned(spark.range(100).withColumn("site_no", F.col("id") % 3), path, ["site_no"], files_per_partition=4, tasks=16)
    back = spark.read.parquet(path)
    assert back.count() == 100 and back.filter("site_no = 1").select(F.input_file_name()).distinct().count() > 1
