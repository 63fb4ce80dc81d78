"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target in tokens. Whole copies of the source fill it as far as they go; what remains
is met by a choice of documents. Documents are counted by exact token length. A proportional share of
each length comes first, and bounded-knapsack dynamic programming over the lengths still free fits what is left
of the budget. Which documents of a length are taken is decided by a seeded hash of their ids. Only
counts by (source, length, hash slice) are gathered; a (source, length) group with a third of all rows
is cut into hash slices, and only the one slice in which the choice ends is put in order.

Nulls: a null text has length 0, a null source is a source of its own (last in order). Documents of
length 0 never count and are taken 0 times. Repeated rows are separate documents; which of several equal rows is
taken makes no difference. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leeward.llm.shared import ident, staged

SLICES = 256
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), most: int = 3) -> DataFrame:
    """Token targets per source, from rows (source, source_size): one row per source in and out.

    Sources in order (nulls last) take the weights in turn. The targets share the whole size by weight; none passes ``most``
    times its source's size, the excess goes to the others by weight until none is above.
    Those that stop are the ones with the least bound per weight. If the first i of that order stop, the others get a level of
    (all - their bounds) / (the weights left) per weight; the right i is the one with the highest level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    bounded = sizes.withColumn("weight", weight).withColumn("bound", F.col("source_size") * F.lit(float(most)))
    by_need = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    return (bounded.withColumn("level", level).withColumn("level", F.max("level").over(everything))
            .select("source", "source_size", F.least(F.col("bound"), F.col("level") * F.col("weight")).alias("target")))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, capacity: int = 1 << 17) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum as near to ``budget`` as they can.

    Works on the counts alone: memory is ``capacity`` plus the distinct lengths.
    """
    take = np.zeros(len(lengths), np.int64)
    size = int((lengths * counts).sum())
    if budget <= 0 or size == 0:
        return take
    if budget >= size:
        return counts.copy()
    take[:] = [int(n) * budget // size for n in counts.tolist()]          # exact integers: the share of each length
    left = budget - int((lengths * take).sum())
    free = counts - take
    for i in np.argsort(-lengths, kind="stable"):                         # the longest first, down to what the programme covers
        if left <= capacity:
            break
        k = min(int(free[i]), (left - capacity) // int(lengths[i]) + 1, left // int(lengths[i]))
        take[i] += k
        free[i] -= k
        left -= k * int(lengths[i])
    top = 2 * left                                                        # a sum above may be nearer, but none beyond this
    usable = np.flatnonzero((free > 0) & (lengths <= top))
    reach = np.zeros(top + 1, bool)
    reach[0] = True
    by = np.full(top + 1, -1, np.int64)
    items = []
    for i in usable[np.argsort(lengths[usable], kind="stable")[::-1]]:
        part, rest = 1, min(int(free[i]), top // int(lengths[i]))
        while rest > 0 and not reach[left]:
            part = min(part, rest)
            step = part * int(lengths[i])
            if step <= top:
                new = np.zeros(top + 1, bool)
                new[step:] = reach[:-step]
                new &= ~reach
                by[new] = len(items)
                reach |= new
                items.append((i, part))
            rest -= part
            part *= 2
        if reach[left]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - left))])
    while at > 0:
        i, part = items[by[at]]
        take[i] += part
        at -= part * int(lengths[i])
    return take


def mixed(docs: DataFrame, *, weights: Sequence[float] = (1.0, 2.0, 3.0), most: int = 3, seed: int = 23,
          id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
          keep: Sequence[str] | None = None) -> DataFrame:
    """Every row of ``docs``, its columns ``keep`` (all) as struct ``r``, with ``size``, ``source_size``, ``target`` and ``copies`` (0 to ``most``)."""
    source, text = ident(docs, source_column), ident(docs, text_column)
    base = docs.select(F.struct(*[ident(docs, c) for c in keep or docs.columns]).alias("r"), source.alias("source"),
                       word_count(text).alias("size"), F.xxhash64(F.lit(seed), ident(docs, id_column), text).alias("h"))
    base = base.withColumn("slice", F.pmod(F.col("h"), F.lit(SLICES)).cast("int"))
    slices = staged(base.groupBy("source", "size", "slice").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    per_source = slices.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = targets(per_source, weights, most)
    lengths = slices.groupBy("source", "size").agg(F.sum("n").alias("docs")).where("size > 0")
    kind = docs.schema[source_column].dataType.simpleString()

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size", ignore_index=True)
        whole = min(int(frame["target"][0] // frame["source_size"][0]), most)
        budget = int(round(frame["target"][0] - whole * frame["source_size"][0])) if whole < most else 0
        frame["extra"] = fit_budget(frame["size"].to_numpy(), frame["docs"].to_numpy(), budget)
        frame["whole"] = whole
        return frame[["source", "size", "source_size", "target", "whole", "extra"]]

    # One group is one source's distinct lengths, however many documents it has.
    named = goals.withColumnRenamed("source", "s")
    chosen = (lengths.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s").groupBy("source").applyInPandas(
        choose, f"source {kind}, size long, source_size long, target double, whole int, extra long"))
    zero = goals.select("source", F.lit(0).cast("long").alias("size"), "source_size", "target",
                        F.lit(0).alias("whole"), F.lit(0).cast("long").alias("extra"))
    chosen = chosen.union(zero)
    earlier = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    plan = (slices.join(chosen.withColumnRenamed("source", "s").withColumnRenamed("size", "z"),
                        F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
            .withColumn("taken_here", F.greatest(F.lit(0), F.least(
                "n", F.col("extra") - F.coalesce(F.sum("n").over(earlier), F.lit(0)))))
            .drop("extra")
            .withColumnsRenamed({"source": "s", "size": "z", "slice": "c"}))
    placed = base.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
                       & (F.col("slice") == F.col("c")))
    in_slice = Window.partitionBy("source", "size", "slice").orderBy("h")
    return (placed.withColumn("place", F.row_number().over(in_slice))
            .select("r", "size", "source_size", "target",
                    (F.col("whole") + (F.col("place") <= F.col("taken_here")).cast("int")).alias("copies")))


def apply_mix(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document taken k times is there k times."""
    made = mixed(docs, **settings).where("copies > 0")
    again = made.select("r", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return again.select(*[F.col(f"r.`{c}`").alias(c) for c in docs.columns])
