"""Row-order rules over a key, computed in slices of the key.

A window partitioned by the key alone puts all rows of a busy key into one task. Here a
window partition is (key, slice of the ordering axis). What a slice needs from the rows before
it is carried over by a summary with one row per slice, whose size depends on the length of
the axis and not on the number of rows. Results equal those of the plain window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

SLICE = "__slice"


def slice_no(position: Column, width: int | float) -> Column:
    return F.floor(position / F.lit(width)).cast("long")


def with_previous(df: DataFrame, keys: list[str], order: list[Column], take: dict[str, Column],
                  width: int | float) -> DataFrame:
    """Adds, per row, the ``take`` columns of the row before it in the key's order.

    ``order[0]`` is numeric and gives the axis that is sliced.
    """
    df = df.withColumn(SLICE, slice_no(order[0], width))
    tail = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *[c.alias(n) for n, c in take.items()])
    by_slice = Window.partitionBy(*keys).orderBy(SLICE)
    carried = (df.groupBy(*keys, SLICE).agg(F.max(tail).alias("__tail"))
               .select(*keys, SLICE, F.lag("__tail").over(by_slice).alias("__carry")))
    w = Window.partitionBy(*keys, SLICE).orderBy(*order)
    df = df.withColumn("__rn", F.row_number().over(w))
    for name, col in take.items():
        df = df.withColumn(f"__p_{name}", F.lag(col).over(w))
    df = df.join(carried, [*keys, SLICE], "left")
    for name in take:
        df = df.withColumn(name, F.when(F.col("__rn") == 1, F.col(f"__carry.{name}")).otherwise(F.col(f"__p_{name}")))
    return df.drop(SLICE, "__carry", "__rn", *[f"__p_{n}" for n in take])


def runs(df: DataFrame, keys: list[str], order: list[Column], take: dict[str, Column],
         opens: Callable[[dict[str, Column], dict[str, Column]], Column], width: int | float) -> DataFrame:
    """Adds ``run_len`` (rows of the run so far) and ``run_start`` (its first ``order[0]``).

    ``opens(before, now)`` says from the ``take`` values of two neighbouring rows whether the
    second opens a new run; NULL counts as yes. The first row of a key always does.
    """
    df = df.withColumn(SLICE, slice_no(order[0], width))
    df = df.withColumns({f"__o{i}": c for i, c in enumerate(order)}).withColumns({f"__t_{n}": c for n, c in take.items()})
    places, values = [f"__o{i}" for i in range(len(order))], [f"__t_{n}" for n in take]
    w = Window.partitionBy(*keys, SLICE).orderBy(*places)
    before = {n: F.lag(f"__t_{n}").over(w) for n in take}
    now = {n: F.col(f"__t_{n}") for n in take}
    df = df.withColumn("__rn", F.row_number().over(w)).withColumns({f"__b_{n}": c for n, c in before.items()})
    opened = (F.col("__rn") > 1) & F.coalesce(opens({n: F.col(f"__b_{n}") for n in take}, now), F.lit(True))
    df = df.withColumn("__open", opened)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns({"__open_rn": F.max(F.when(F.col("__open"), F.col("__rn"))).over(upto),
                         "__open_pos": F.max(F.when(F.col("__open"), F.col("__o0"))).over(upto)})
    ends = F.struct(*places, *values)
    per_slice = df.groupBy(*keys, SLICE).agg(
        F.count(F.lit(1)).alias("n"), F.max("__open_rn").alias("last_rn"), F.max("__open_pos").alias("last_pos"),
        F.min(ends).alias("head"), F.max(ends).alias("tail"))
    by_slice = Window.partitionBy(*keys).orderBy(SLICE)
    per_slice = per_slice.withColumn("tail_before", F.lag("tail").over(by_slice))
    joint = opens({n: F.col(f"tail_before.__t_{n}") for n in take}, {n: F.col(f"head.__t_{n}") for n in take})
    linked = F.col("tail_before").isNotNull() & ~F.coalesce(joint, F.lit(True))
    per_slice = carry_runs(per_slice.withColumn("linked", linked).withColumn("head_pos", F.col("head.__o0")), keys)
    df = df.join(per_slice, [*keys, SLICE], "left")
    df = df.withColumn("run_len", F.when(F.col("__open_rn").isNull(), F.col("__rn") + F.col("__len_in"))
                       .otherwise(F.col("__rn") - F.col("__open_rn") + 1).cast("long"))
    df = df.withColumn("run_start", F.coalesce("__open_pos", "__pos_in"))
    return df.drop(SLICE, "__open", "__rn", "__open_rn", "__open_pos", "__len_in", "__pos_in", *places, *values,
                   *[f"__b_{n}" for n in take])


def carry_runs(per_slice: DataFrame, keys: list[str]) -> DataFrame:
    """What each slice inherits: length and start of the run that reaches into it.

    ``per_slice`` has n, last_rn (rank of the last row that opens a run, if any), last_pos, head_pos
    and linked (the first row goes on the run of the slice before).
    """
    by_slice = Window.partitionBy(*keys).orderBy(SLICE)
    within = Window.partitionBy(*keys, "island").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, 0)
    last = F.coalesce("last_rn", F.when(~F.col("linked"), F.lit(1)))
    pos = F.coalesce("last_pos", F.when(~F.col("linked"), F.col("head_pos")))
    out = (per_slice.withColumn("last", last).withColumn("pos", pos)
           .withColumn("island", F.sum(F.when(F.col("last").isNotNull(), 1).otherwise(0)).over(by_slice))
           .withColumn("part", F.when(F.col("last").isNotNull(), F.col("n") - F.col("last") + 1).otherwise(F.col("n")))
           .withColumn("len_out", F.sum("part").over(within)).withColumn("pos_out", F.max("pos").over(within)))
    goes_on = F.col("linked")
    return out.select(*keys, SLICE,
                      F.when(goes_on, F.lag("len_out").over(by_slice)).otherwise(0).alias("__len_in"),
                      F.when(goes_on, F.lag("pos_out").over(by_slice)).otherwise(F.col("head_pos")).alias("__pos_in"))


def runs_of_value(df: DataFrame, keys: list[str], order: list[Column], value: Column,
                  width: int | float) -> DataFrame:
    """``runs`` of equal neighbouring values. NULL equals nothing, so it always opens a run."""
    return runs(df, keys, order, {"v": value}, lambda before, now: before["v"] != now["v"], width)


def trailing(df: DataFrame, keys: list[str], seconds: Column, window_s: int, width: int,
             measures: dict[str, Column]) -> DataFrame:
    """Aggregates over the rows of the last ``window_s`` seconds, current row included.

    ``measures`` maps output names to aggregate expressions. Rows near the end of a slice are
    repeated into the next slices that look back on them, so the frame never crosses a slice.
    """
    own = slice_no(seconds, width)
    df = df.withColumn("__home", own).withColumn("__sec", seconds.cast("long"))
    df = df.withColumn(SLICE, F.explode(F.sequence(own, slice_no(seconds + F.lit(window_s), width))))
    w = Window.partitionBy(*keys, SLICE).orderBy("__sec").rangeBetween(-window_s, 0)
    for name, agg in measures.items():
        df = df.withColumn(name, agg.over(w))
    return df.filter(F.col(SLICE) == F.col("__home")).drop(SLICE, "__home", "__sec")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key by ``order``. A merged maximum, no window."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return (df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__last"))
            .select(*keys, "__last.*").select(*df.columns))


def first_arrival(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c not in order]
    return (df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("__first"))
            .select(*keys, "__first.*").select(*df.columns))
