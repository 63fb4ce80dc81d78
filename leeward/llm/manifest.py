r"""Merkle manifest of a dataset: leaf places by rank in bitmaps, levels by slot.

A row is a leaf; the leaves of a group ascend by id. Nothing sorts the leaves: the ids of a group become a bitmap, kept as its non-empty
64-bit words (``bit_or`` of single bits, which Spark merges per task before the shuffle), and a directory gives each word the leaves
before it. The place of a leaf is its word's start plus the number of lower bits in the word. Only the directory, at most a row per
64 consecutive ids, is ordered, over ranges.

Rows that share an id cannot be told apart by a bitmap: words that count more rows than bits take the exact way of ``_tied`` instead (order
by id, leaf and part of the staged table, ranges again), so that one id may hold any share of the rows. Null ids come first.

Places are slots. ``FAN ** LEVELS`` consecutive slots form a chunk, which one task takes as an array by slot and folds ``LEVELS`` times; the chunk
roots are the slots of the next round, until a group has one node. The group roots, by rank of the group, fold the same way to the root. Down again, every
chunk tells its members the siblings on their way, so a proof is read off without looking at any other chunk.

A leaf is the SHA-256 of the fields, each ``-`` for null or its UTF-8 byte count, ``:`` and the value. Repeated rows are leaves of their own.
No rows give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leeward.llm.shared import ident, staged, tidy

FAN = 8
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NO_ID = -(1 << 60)                  # word of null ids, below the word of every 64-bit id


def leaf_hash(fields: list[Column]) -> Column:
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*[part(c) for c in fields]), 256)


def group_name(group: Column) -> Column:
    """A string that orders null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), group), F.lit(""))


def running(frame: DataFrame, order: list[str], weight: str, output: str) -> DataFrame:
    """``frame`` with the sum of ``weight`` over all rows before each in ``order``, from ranges: no task sees more than its range."""
    ranged = staged(frame.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)          # a row per range
    starts = (ranged.groupBy("_range").agg(F.sum(weight).alias("_sum"))
              .select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start")))
    return (ranged.withColumn(output, F.coalesce(F.sum(weight).over(within), F.lit(0))).join(starts, "_range")
            .withColumn(output, F.col(output) + F.col("_start")).drop("_range", "_start"))


def _bit(ids: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), ids.bitwiseAND(63).cast("int"))


def _lower_bits(bits: Column, ids: Column) -> Column:
    """How many bits of ``bits`` lie below the id's own."""
    off = ids.bitwiseAND(63).cast("int")
    return F.when(off == 0, 0).otherwise(F.bit_count(F.call_function("shiftleft", bits, 64 - off)))


def _tied(leaves: DataFrame, words: DataFrame) -> DataFrame:
    """Places within their word for rows of words that hold an id twice or a null id: by id, leaf, then part and order in the part."""
    rows = leaves.join(words.where("tied").select("grp", "word"), ["grp", "word"], "left_semi")
    kinds = rows.groupBy("grp", "word", "id", "leaf", "part").agg(F.count(F.lit(1)).alias("n"))
    kinds = staged(running(kinds, ["grp", "word", "id", "leaf", "part"], "n", "before"), "kinds")
    firsts = kinds.groupBy("grp", "word").agg(F.min("before").alias("first"))
    kinds = kinds.join(firsts, ["grp", "word"]).select("grp", "word", F.col("id").alias("k_id"), "leaf", "part", (F.col("before") - F.col("first")).alias("at"))
    copy = F.row_number().over(Window.partitionBy("grp", "word", "id", "leaf", "part").orderBy(F.lit(0)))
    rows = rows.withColumn("copy", copy)
    return (rows.join(kinds, ["grp", "word", "leaf", "part"]).where(F.col("id").eqNullSafe(F.col("k_id")))
            .select(*rows.columns, (F.col("at") + F.col("copy") - 1).alias("within")).drop("copy"))


def placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``leaves`` (id, grp, word, leaf, part, ..) with their ``slot`` in the group, and the groups: (grp, total, rank)."""
    words = leaves.groupBy("grp", "word").agg(F.coalesce(F.bit_or(_bit(F.col("id"))), F.lit(0).cast("long")).alias("bits"),
                                              F.count(F.lit(1)).alias("n"))
    words = staged(running(words, ["grp", "word"], "n", "before"), "directory")
    groups = words.groupBy("grp").agg(F.min("before").alias("first"), F.sum("n").alias("total"), F.lit(1).alias("one"))
    groups = staged(running(groups, ["grp"], "one", "rank"), "groups")
    words = words.join(groups.select("grp", "first"), "grp").select(
        "grp", "word", "bits", (F.col("before") - F.col("first")).alias("start"), (F.bit_count("bits") != F.col("n")).alias("tied"))
    words = staged(words, "ranks")
    clean = leaves.join(words.where("not tied"), ["grp", "word"]).withColumn("within", _lower_bits(F.col("bits"), F.col("id")).cast("long"))
    out = clean.select(*leaves.columns, (F.col("start") + F.col("within")).alias("slot"))
    if words.where("tied").limit(1).count():
        tied = _tied(leaves, words).join(words.select("grp", "word", "start"), ["grp", "word"])
        out = out.union(tied.select(*leaves.columns, (F.col("start") + F.col("within")).alias("slot")))
    return out, groups.select("grp", "total", "rank")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fold(nodes: list[str], levels: int, alone: bool) -> list[list[str]]:
    """The levels above ``nodes``. A group that lies in one chunk (``alone``) stops at one node, any other goes through all levels."""
    out = [nodes]
    for _ in range(levels):
        if alone and len(out[-1]) == 1:
            break
        out.append([sha("".join(out[-1][i:i + FAN])) for i in range(0, len(out[-1]), FAN)])
    return out


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by("slot")


def _up(levels: int) -> Callable[[pa.Table], pa.Table]:
    def up(table: pa.Table) -> pa.Table:
        table = _ordered(table)
        chunk, alone = table["chunk"][0].as_py(), table["total"][0].as_py() <= FAN ** levels
        return pa.table({"grp": [table["grp"][0].as_py()], "slot": pa.array([chunk], pa.int64()), "total": pa.array([-(-table["total"][0].as_py() // FAN ** levels)], pa.int64()),
                         "hash": [fold(table["hash"].to_pylist(), levels, alone)[-1][0]]})
    return up


PATH = "array<struct<left:string,right:string>>"


def siblings(tree: list[list[str]], i: int) -> list[dict]:
    """The other nodes of the runs on the way up from node ``i`` of the lowest level, as what stands left and right."""
    path = []
    for level in tree[:-1]:
        first = i - i % FAN
        path.append({"left": "".join(level[first:i]), "right": "".join(level[i + 1:first + FAN])})
        i //= FAN
    return path


def _down(levels: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def down(table: pa.Table, above: pa.Table) -> pa.Table:
        table = _ordered(table)
        alone = table["total"][0].as_py() <= FAN ** levels
        tree = fold(table["hash"].to_pylist(), levels, alone)
        tail = above["path"][0].as_py()
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.table({"grp": table["grp"], "slot": table["slot"], "path": pa.array([siblings(tree, i) + tail for i in range(len(table))], kind)})
    return down


def told(leaf: str, changed: str, path: list[dict]) -> tuple[str, str]:
    """Hash of the siblings from the leaf to the root, and the root that the changed leaf leads to."""
    node = changed
    for step in path:
        node = sha(step["left"] + node + step["right"])
    return sha("".join(step["left"] + step["right"] for step in path)), node


def _proofs(levels: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def proofs(table: pa.Table, above: pa.Table) -> pa.Table:
        table = _ordered(table)
        leaves, changed = table["hash"].to_pylist(), table["changed"].to_pylist()
        tree = fold(leaves, levels, table["total"][0].as_py() <= FAN ** levels)
        tail, subroot, root = (above[c][0].as_py() for c in ("path", "subroot", "root"))
        rows = [told(leaf, leaf if new is None else new, siblings(tree, i) + tail) for i, (leaf, new) in enumerate(zip(leaves, changed))]
        n = len(rows)
        return pa.table({"id": table["id"].cast(pa.int64()), "grp": table["grp"], "slot": table["slot"], "leaf": table["hash"], "subroot": pa.array([subroot] * n, pa.string()),
                         "root": pa.array([root] * n, pa.string()), "proof_sha256": pa.array([r[0] for r in rows], pa.string()),
                         "folded_root": pa.array([r[1] for r in rows], pa.string())})
    return proofs


NODE = "grp string, slot long, total long, hash string"


def _chunked(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("chunk", F.floor(F.col("slot") / FAN ** levels).cast("long"))


def _climb(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Rounds of nodes (grp, slot, total, hash), the last with one node per group."""
    rounds = [nodes]
    while rounds[-1].where("total > 1").limit(1).count():
        rounds.append(staged(_chunked(rounds[-1], levels).groupBy("grp", "chunk").applyInArrow(_up(levels), NODE), "nodes"))
    return rounds


def _descend(rounds: list[DataFrame], above: DataFrame, levels: int, lowest: int) -> DataFrame:
    """(grp, slot, path) of the nodes of round ``lowest``, from the paths ``above`` of the groups' single nodes."""
    for nodes in reversed(rounds[lowest:-1]):
        left = _chunked(nodes, levels)
        right = above.select("grp", F.col("slot").alias("chunk"), "path")
        above = staged(left.groupBy("grp", "chunk").cogroup(right.groupBy("grp", "chunk")).applyInArrow(_down(levels), f"grp string, slot long, path {PATH}"), "paths")
    return above


def leaves_of(rows: DataFrame, *, fields: tuple[str, ...] = FIELDS, id_column: str = "doc_id", group_column: str = "lang",
              tampered: Callable[[DataFrame], dict[str, Column]] | None = None) -> DataFrame:
    """Leaves of ``rows``, staged: (id, grp, word, leaf, changed, part). ``tampered`` gives the fields of altered rows, and ``when`` a row is altered."""
    number = ident(rows, id_column).cast("long")
    own = [ident(rows, c) for c in fields]
    changed = F.lit(None).cast("string")
    if tampered is not None:
        new = tampered(rows)
        changed = F.when(new["when"], leaf_hash([new.get(c, o) for c, o in zip(fields, own)]))
    made = rows.select(number.alias("id"), group_name(ident(rows, group_column).cast("string")).alias("grp"),
                       F.coalesce(F.call_function("shiftright", number, F.lit(6)), F.lit(NO_ID)).alias("word"),
                       leaf_hash(own).alias("leaf"), changed.alias("changed"), F.spark_partition_id().alias("part"))
    return staged(made, "leaves")


def manifest(rows: DataFrame, *, levels: int = LEVELS, **settings) -> DataFrame:
    """Per row: id, group, slot, leaf, subroot, root, proof_sha256, and ``folded_root`` of the changed leaf (of the leaf itself where unchanged)."""
    spark = rows.sparkSession
    with tidy(spark):
        leaves, groups = placed(leaves_of(rows, **settings))
        leaves = staged(leaves.join(groups.select("grp", "total"), "grp").select("id", "grp", "slot", "total", F.col("leaf").alias("hash"), "changed"), "slots")
        below = _climb(leaves.select("grp", "slot", "total", "hash"), levels)
        n_groups = groups.agg(F.count(F.lit(1)).alias("n")).first()["n"]
        # The groups' own nodes are the leaves of one more tree, in order of their rank.
        tops = below[-1].select("grp", F.col("hash").alias("subroot")).join(groups.select("grp", "rank"), "grp")
        tops = staged(tops.select("grp", "rank", "subroot"), "subroots")
        upper = _climb(tops.select(F.lit("").alias("grp"), F.col("rank").alias("slot"), F.lit(n_groups).cast("long").alias("total"), F.col("subroot").alias("hash")), levels)
        empty = F.array().cast(PATH)
        root = next((r["hash"] for r in upper[-1].limit(1).collect()), None)
        paths = _descend(upper, upper[-1].select("grp", "slot", empty.alias("path")), levels, 0)
        ends = tops.join(paths.select(F.col("slot").alias("rank"), "path"), "rank")
        ends = staged(ends.select("grp", F.lit(0).cast("long").alias("slot"), "path", "subroot", F.lit(root).cast("string").alias("root")), "ends")
        above = _descend(below, ends.select("grp", "slot", "path"), levels, 1)
        above = above.join(ends.select("grp", "subroot", "root"), "grp").select("grp", F.col("slot").alias("chunk"), "path", "subroot", "root")
        schema = "id long, grp string, slot long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
        made = _chunked(leaves, levels).groupBy("grp", "chunk").cogroup(above.groupBy("grp", "chunk")).applyInArrow(_proofs(levels), schema)
        return staged(made, "manifest")
