"""Row filters and column masks as DataFrame transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leeward.functions.geo import snap

NATIONAL = "regulator_national"
FULL_ROLES = ("regulator", NATIONAL)
POLICY_SCHEMA = "group_name string, jurisdiction_code string"


def default_policy(spark, jurisdictions: list[str]) -> DataFrame:
    """One group per jurisdiction. A settings table."""
    return spark.createDataFrame([(f"jur_{j}", j) for j in jurisdictions], POLICY_SCHEMA)


def visible_rows(df: DataFrame, policy: DataFrame, groups: list[str], column: str = "jurisdiction_code") -> DataFrame:
    """Rows whose jurisdiction one of the caller's groups covers; the national regulator sees all.

    Gold tables carry the jurisdiction of the release site, sensor tables that of the device.
    """
    if NATIONAL in groups:
        return df
    allowed = policy.filter(F.col("group_name").isin(list(groups))).select(
        F.col("jurisdiction_code").alias("__allowed")).distinct()
    return df.join(allowed, df[column] == allowed["__allowed"], "left_semi")


def mask(df: DataFrame, role: str, salt: str = "", cell_deg: float = 0.05, secret_columns=("source_term_bq",),
         id_column: str = "device_id", coordinates=("lat", "lon")) -> DataFrame:
    """What a role may see: full rows for regulators; otherwise hashed ids, coordinates snapped to the
    cell and release amounts removed."""
    if role in FULL_ROLES:
        return df
    changes: dict[str, Column] = {}
    if id_column in df.columns:
        changes[id_column] = F.sha2(F.concat(F.lit(salt), F.col(id_column)), 256)
    for name in coordinates:
        if name in df.columns:
            changes[name] = snap(F.col(name), cell_deg)
    for name in secret_columns:
        if name in df.columns:
            changes[name] = F.lit(None).cast(df.schema[name].dataType)
    return df.withColumns(changes) if changes else df
