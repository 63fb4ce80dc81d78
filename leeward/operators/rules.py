"""Hard rules with reasons, the quarantine split, and expectations of three strengths."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, functions as F

from leeward.config import Limits
from leeward.functions.numeric import holds


def reading_rules(limits: Limits = Limits()) -> dict[str, Column]:
    """What a single reading must satisfy to pass; the key is the reason it is refused for."""
    dose, wind, battery = F.col("dose_rate_usv_h"), F.col("wind_speed_ms"), F.col("battery")
    return {
        "wind_physical": wind.between(limits.wind_min, limits.wind_max),
        "dose_in_detector_range": dose.isNull() | dose.between(limits.dose_min, limits.dose_max),
        "no_null_when_powered": ~((battery > 0) & dose.isNull()),
        "measure_present": dose.isNotNull() | (battery > 0),
    }


def record_checks() -> dict[str, Column]:
    """Contradictions within a record, reported apart from the hard rules."""
    return {
        "sends_without_power": ~holds(F.col("battery") <= 0),
        "zero_when_powered": ~holds((F.col("battery") > 0) & (F.col("dose_rate_usv_h") == 0)),
    }


def apply_rules(df: DataFrame, rules: Mapping[str, Column], column: str = "reasons") -> DataFrame:
    """Adds the array of broken rules. A rule that is NULL counts as broken."""
    broken = [F.when(~holds(ok), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn(column, F.array_compact(F.array(*broken)))


def quarantine(df: DataFrame, column: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """(passed, refused). Each row is in exactly one part, however many rules it breaks."""
    return df.filter(F.size(column) == 0), df.filter(F.size(column) > 0)


def expect(df: DataFrame, name: str, condition: Column, level: str = "warn",
           observation: Observation | None = None) -> DataFrame:
    """``warn`` counts the misses in an observation, ``drop`` removes them, ``fail`` stops the job."""
    ok = holds(condition)
    if level == "warn":
        misses = F.count_if(~ok).alias(name)
        return df.observe(observation if observation is not None else name, misses)
    if level == "drop":
        return df.filter(ok)
    if level == "fail":
        guard = F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(f"expectation failed: {name}")).cast("boolean"))
        return df.filter(guard)
    raise ValueError(f"unknown level {level!r}")


def batch_rules(limits: Limits = Limits()) -> dict[str, tuple[Column, str]]:
    """Expectations of the batch path: (condition, level)."""
    return {
        "wind_physical": (F.col("wind_speed_10m").between(0.0, limits.batch_wind_max), "drop"),
        "no_negative_concentration": (F.col("concentration") >= 0, "fail"),
        "land_has_elevation": (F.col("grid_elevation") > 0, "warn"),
    }


def apply_rules_by_firmware(df: DataFrame, rule_dim: DataFrame) -> DataFrame:
    """Range rules that depend on the firmware valid at event time.

    ``rule_dim`` has (firmware, column_name, lo, hi), one row per firmware and measure. It is a
    settings table: the join is left to the optimizer, which broadcasts it by its size. Rows whose
    firmware has no rule are refused with ``no_rule_for_firmware``.
    """
    measures = ("dose_rate_usv_h", "wind_speed_ms")
    wide = rule_dim.groupBy("firmware").agg(*[
        agg(F.when(F.col("column_name") == m, F.col(side))).alias(f"__{side}_{m}")
        for m in measures for side, agg in (("lo", F.max), ("hi", F.max))])
    wide = wide.withColumn("__known", F.lit(True))
    out = df.join(wide, "firmware", "left")
    rules = {"no_rule_for_firmware": F.col("__known")}
    for m in measures:
        inside = F.col(m).between(F.col(f"__lo_{m}"), F.col(f"__hi_{m}"))
        rules[f"{m}_range"] = F.col("__known").isNull() | inside
    out = apply_rules(out, rules)
    return out.drop("__known", *[f"__{s}_{m}" for m in measures for s in ("lo", "hi")])
