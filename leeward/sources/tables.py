"""Writers: keyed upsert over versioned folders, and partitioned layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leeward.operators.slices import latest


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Target with the updates applied: the highest ``order`` per key wins, ties go to the update.

    Repeating an update changes nothing. The target rows no update touches come through an
    anti join, whose small side the optimizer broadcasts when its size allows.
    """
    fresh = latest(updates, keys, order)
    touched = fresh.select(*keys)
    untouched = target.join(touched, keys, "left_anti")
    contested = target.join(touched, keys, "left_semi")
    winners = latest(contested.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1))),
                     keys, [*order, "__new"]).drop("__new")
    return untouched.unionByName(winners.select(*target.columns))


class VersionedTable:
    """A Parquet table whose every write is a new folder.

    Parquet has no merge. A write goes to the next version folder; the current version is the
    highest folder that carries Spark's success marker, so a reader never sees half a write and a
    failed write leaves the table as it was. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _fs(self):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        return hadoop, root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        hadoop, root, fs = self._fs()
        if not fs.exists(root):
            return []
        found = []
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("v=") and fs.exists(hadoop.Path(status.getPath(), "_SUCCESS")):
                found.append(int(name[2:]))
        return sorted(found)

    def folder(self, version: int) -> str:
        return f"{self.path}/v={version:09d}"

    def read(self, version: int | None = None) -> DataFrame:
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"no version of {self.path}")
        return self.spark.read.parquet(self.folder(found[-1] if version is None else version))

    def before(self, version: int) -> DataFrame | None:
        """The newest version older than ``version``, if any."""
        older = [v for v in self.versions() if v < version]
        return self.read(older[-1]) if older else None

    def overwrite(self, df: DataFrame, version: int | None = None) -> int:
        """Write a new version. With a given number (a batch id), a repeated write replaces itself."""
        found = self.versions()
        version = version if version is not None else (found[-1] if found else 0) + 1
        df.write.mode("overwrite").parquet(self.folder(version))
        # the newest older version is what a retry of this write starts from: it stays however often the write is repeated
        hadoop, _, fs = self._fs()
        older = [v for v in found if v < version]
        for old in older[: max(0, len(older) - max(1, self.keep - 1))]:
            fs.delete(hadoop.Path(self.folder(old)), True)
        return version

    def upsert(self, updates: DataFrame, keys: list[str], order: list[str]) -> int:
        if not self.versions():
            return self.overwrite(latest(updates, keys, order))
        return self.overwrite(upsert(self.read(), updates, keys, order))


def write_partitioned(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite",
                      files_per_partition: int = 1, tasks: int | None = None) -> None:
    """Write with a fixed layout. A big partition is spread over several files by hash, not one task.

    Without ``tasks``, small pieces are merged by their size at run time.
    """
    spread = [F.col(c) for c in columns]
    if files_per_partition > 1:
        spread.append(F.pmod(F.xxhash64(*df.columns), F.lit(files_per_partition)))
    laid = df.repartition(tasks, *spread) if tasks else df.repartition(*spread)
    laid.write.mode(mode).partitionBy(*columns).parquet(path)
