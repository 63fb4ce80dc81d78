"""Helpers that every operator here uses."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leeward.session import fresh_path, staged

__all__ = ["fresh_folder", "ident", "read_table", "ship", "staged", "tidy", "unused"]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unused(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not have yet, whatever columns the caller's table brings."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"{wish}_"
    return wish


def ident(df: DataFrame, column: str) -> Column:
    """Column reference that survives dots and blanks in names."""
    return F.col(f"`{column}`")


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package through the shared folder, once per application, however the driver came by it."""
    context = spark.sparkContext
    if getattr(context, "_leeward_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"{root.name}/{path.relative_to(root)}")
    archive = f"{fresh_folder(spark, 'package')}/{root.name}_package.zip"
    target = context._jvm.org.apache.hadoop.fs.Path(archive)
    stream = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(packed.getvalue()))
    stream.close()
    context.addPyFile(archive)
    context._leeward_shipped = True


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new, empty folder in the shared one, as a URI."""
    path = fresh_path(spark, name)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(folder)
    uri = system.makeQualified(folder).toString()
    return f"file://{uri.removeprefix('file:')}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within this, the shuffle files of a finished write are removed at once instead of when the driver happens to collect them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
