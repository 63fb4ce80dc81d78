"""Hard negatives from Hilbert-ordered blocks with zone maps.

Components are scaled to integers (floor of ``scale`` times x), so scores are exact. Rows are ordered along a Hilbert curve through all dimensions and
written to Parquet as blocks of up to ``Sizes.block`` rows, one packed row per block, with a zone map beside it: the least and greatest value of
every dimension, and the labels it holds. Rows close on the curve are close in space, so zones are narrow where the data have any structure.

For an anchor a and a zone, interval arithmetic bounds every score in the block: the upper bound takes hi where a is positive and lo where it is not,
the lower bound the other way. Two products of a wave of anchors with a few hundred zones decide which blocks it must read, before any block travels.

1. Positives. While a block's region is packed, its anchors are scored against it; the k-th best there is a floor for the k-th best of all.
   A wave reads the blocks that hold an own label and whose upper bound reaches the floor of some anchor.
2. Negatives. Every positive opens a window of scores; a wave reads the blocks whose interval meets a window of some anchor.

Blocks and anchors meet by (wave, region) in an equality join. Within such a tile the k-th best so far raises the floor, so later blocks are
skipped for the anchors that cannot gain; a block's products are taken for the others only. Tiles give at most k rows per anchor and window, merged by rank.

Nothing is dropped: bounds only rule out blocks that hold no answer. The curve orders by (key, id), so a group of equal vectors with any share of
all rows is cut into blocks like the rest. A vector that no zone excludes costs a product with every row, in tiles.

Rows with a null id, label or vector, or a null or non-finite component take no part. Vectors meet those of their own length only. Rows equal in id,
label and vector are one row; other rows with one id are rows of their own and never each other's partner. Ties: smaller id. No rows give no rows.
Scores beyond 64 bits raise an OverflowError. Other columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leeward.llm.shared import ident, staged, tidy

SCALE = 256
FLOOR = np.iinfo(np.int64).min
PRODUCTS = 1 << 22      # scores held at once

BLOCKS = ("block long, region long, part int, n int, dims int, asked int, labels_in array<long>, lo binary, hi binary, "
          "ids binary, labels binary, flags binary, seeds binary, vectors binary")


@dataclass(frozen=True)
class Sizes:
    """What is held at once."""

    block: int = 1024           # rows of a block, 1,024 at most
    region: int = 16            # blocks of a region at most: what one tile reads
    wave: int = 8192            # anchors of a wave, about
    zones: int = 512            # blocks whose bounds one task works out at a time


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of the place on the Hilbert curve of each row of ``cells`` (n, d), whose values have ``bits`` bits."""
    x = np.ascontiguousarray(cells.T.astype(np.uint32))
    d, n = x.shape
    if d == 0:
        return np.zeros((n, 1), np.uint8)
    for level in range(bits - 1, 0, -1):
        q, p = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint32(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(n, np.uint32)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[d - 1] & np.uint32(1 << level)) != 0, np.uint32((1 << level) - 1), np.uint32(0))
    x ^= turn
    planes = [(x >> np.uint32(level)) & np.uint32(1) for level in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


class Numbers:
    """How integers are stored, and whether products may be taken in floating point."""

    def __init__(self, top: int, dims: int):
        if top * top * max(dims, 1) * 128 >= 1 << 63:
            raise OverflowError(f"components up to {top} in {dims} dimensions give scores beyond 64 bits")
        self.top = top
        self.code = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
        self.work = np.float64 if top * top * max(dims, 1) < 1 << 53 else np.int64

    def pack(self, values: np.ndarray) -> bytes:
        return np.ascontiguousarray(values).astype(self.code).tobytes()

    def unpack(self, blob: bytes, dims: int, n: int) -> np.ndarray:
        return np.frombuffer(blob, self.code).reshape(n, dims).astype(self.work)


def _longs(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<i8")


class Best:
    """The ``k`` best (greatest score, then least id) of each of ``n`` questions so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), FLOOR)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def kth(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(rows):
            return
        touched = np.unique(rows)
        rows = np.concatenate([np.repeat(touched, self.k), rows])
        scores = np.concatenate([self.scores[touched].ravel(), scores])
        ids = np.concatenate([self.ids[touched].ravel(), ids])
        order = np.lexsort((ids, ~scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1])
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        kept = place < self.k
        self.scores[rows[kept], place[kept]] = scores[kept]
        self.ids[rows[kept], place[kept]] = ids[kept]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, places = np.nonzero(self.scores != FLOOR)
        return rows, self.scores[rows, places], self.ids[rows, places]


def _keys(numbers: Numbers, scale: int):
    """Scaled vectors and their place on the curve."""
    def keys(batches):
        for batch in batches:
            lists = batch.column("vector")
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.concatenate([[0], np.cumsum(lengths)])
            key, blob = [None] * len(lengths), [None] * len(lengths)
            for d in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == d)
                whole = np.floor(scale * flat[at[rows][:, None] + np.arange(d)]).astype(np.int64)
                bits = min(16, max(4, -(-256 // max(d, 1))))
                cells = ((whole + numbers.top).astype(np.float64) * ((1 << bits) - 1) / max(2 * numbers.top, 1)).astype(np.uint32)
                curve = hilbert(cells, bits)
                for r, c, v in zip(rows.tolist(), curve, whole):
                    key[r], blob[r] = c[:32].tobytes(), numbers.pack(v)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("asked"), pa.array(lengths.astype(np.int32)),
                                              pa.array(key, pa.binary()), pa.array(blob, pa.binary())],
                                             ["id", "label", "asked", "dims", "key", "vector"])
    return keys


def _unlike(labels: np.ndarray, own: np.ndarray) -> np.ndarray:
    return own[:, None] != labels[None, :]


def _packer(numbers: Numbers, positives: int, sizes: Sizes):
    """Sorted rows of a range to blocks. Anchors get a floor from their own region."""
    def region_rows(part, region, dims, table):
        rows = {c: table.column(c).combine_chunks() if isinstance(table.column(c), pa.ChunkedArray) else table.column(c) for c in ("id", "label", "asked", "vector")}
        ids, labels = (rows[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "label"))
        asked = rows["asked"].to_numpy(zero_copy_only=False).astype(bool)
        blobs = rows["vector"].to_pylist()
        fresh = np.array([i == 0 or ids[i] != ids[i - 1] or labels[i] != labels[i - 1] or blobs[i] != blobs[i - 1] for i in range(len(ids))], bool)
        ids, labels, asked = ids[fresh], labels[fresh], asked[fresh]
        vectors = numbers.unpack(b"".join(b for b, f in zip(blobs, fresh) if f), dims, len(ids))
        seeds = np.full(len(ids), FLOOR)
        who = np.flatnonzero(asked)
        best = Best(len(who), positives)
        step = max(1, PRODUCTS // max(1, len(ids)))
        for i in range(0, len(who), step):
            some = who[i:i + step]
            scores = (vectors[some] @ vectors.T).astype(np.int64)
            r, c = np.nonzero(~_unlike(labels, labels[some]) & (ids[some][:, None] != ids[None, :]))
            best.add(r + i, scores[r, c], ids[c])
        seeds[who] = best.kth()
        for b, i in enumerate(range(0, len(ids), sizes.block)):
            cut = slice(i, i + sizes.block)
            v = vectors[cut]
            yield ((part << 32) + region * sizes.region + b, (part << 32) + region, part, len(v), dims, int(asked[cut].sum()),
                   np.unique(labels[cut]).tolist(), numbers.pack(v.min(axis=0)), numbers.pack(v.max(axis=0)), ids[cut].astype("<i8").tobytes(),
                   labels[cut].astype("<i8").tobytes(), asked[cut].tobytes(), seeds[cut].astype("<i8").tobytes(), numbers.pack(v))

    def record(rows):
        return pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in rows], schema=BLOCK_SCHEMA)

    def pack(batches):
        part, region, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while len(held):
                dims = held["dims"][0].as_py()
                same = np.flatnonzero(held["dims"].to_numpy() != dims)
                end = int(same[0]) if len(same) else len(held)
                if end == len(held) and end < sizes.block * sizes.region:
                    break                                       # more rows of this region may come
                end = min(end, sizes.block * sizes.region)
                yield record(region_rows(part, region, dims, held.slice(0, end)))
                held, region = held.slice(end), region + 1
        if held is not None and len(held):
            yield record(region_rows(part, region, held["dims"][0].as_py(), held))
    return pack


BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("region", pa.int64()), ("part", pa.int32()), ("n", pa.int32()), ("dims", pa.int32()), ("asked", pa.int32()),
                          ("labels_in", pa.list_(pa.int64())), ("lo", pa.binary()), ("hi", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary()),
                          ("flags", pa.binary()), ("seeds", pa.binary()), ("vectors", pa.binary())])
NAMES = BLOCK_SCHEMA.names


def blocks(rows: DataFrame, asked: Column, numbers: Numbers, count: int, sizes: Sizes, *, scale: int, positives: int) -> DataFrame:
    """Packed blocks in the order of the curve, as a table in the shared folder."""
    keyed = (rows.withColumn("asked", F.coalesce(asked, F.lit(False))).select("id", "label", "asked", "vector")
             .mapInArrow(_keys(numbers, scale), "id long, label long, asked boolean, dims int, key binary, vector binary"))
    parts = max(1, math.ceil(count / max(1, sizes.block * sizes.region // 2)))
    ranged = keyed.repartitionByRange(parts, "dims", "key", "id").sortWithinPartitions("dims", "key", "id", "label", "vector")
    return staged(ranged.mapInArrow(_packer(numbers, positives, sizes), BLOCKS), "blocks")


def _anchors(numbers: Numbers):
    """The anchors of blocks, one row each."""
    def anchors(batches):
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                ids, labels, seeds = _longs(b["ids"]), _longs(b["labels"]), _longs(b["seeds"])
                width = len(b["vectors"]) // max(1, b["n"])
                for i in np.flatnonzero(np.frombuffer(b["flags"], bool)).tolist():
                    out.append(((b["block"] << 10) + i, int(ids[i]), int(labels[i]), b["dims"], int(seeds[i]), b["wave"], b["vectors"][i * width:(i + 1) * width]))
            yield pa.RecordBatch.from_pylist([dict(zip(("uid", "id", "label", "dims", "seed", "wave", "vector"), r)) for r in out],
                                             schema=pa.schema([("uid", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("dims", pa.int32()),
                                                               ("seed", pa.int64()), ("wave", pa.int32()), ("vector", pa.binary())]))
    return anchors


class Wave:
    """Anchors of one length from a group's table, sorted by uid, with the score windows (lo, hi) of each of their questions."""

    def __init__(self, table: pa.Table, numbers: Numbers, dims: int, negative: bool):
        table = table.filter(pa.compute.equal(table["dims"], dims)).sort_by("uid")
        take = lambda c: table[c].to_numpy().astype(np.int64)
        self.uid, self.id, self.label = take("uid"), take("id"), take("label")
        self.n = len(self.uid)
        self.vectors = numbers.unpack(b"".join(table["vector"].to_pylist()), dims, self.n)
        if negative:
            width = max((len(w) for w in table["lows"].to_pylist()), default=0)
            fill = lambda c, v: np.array([w + [v] * (width - len(w)) for w in table[c].to_pylist()], np.int64).reshape(self.n, width)
            self.lo, self.hi = fill("lows", 1), fill("highs", 0)          # an empty window where there are fewer positives
        else:
            seeds = take("seed")
            self.lo, self.hi = seeds[:, None], np.full((self.n, 1), np.iinfo(np.int64).max)

    def bounds(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of every anchor with what lies between ``lo`` and ``hi`` (zones, dims)."""
        up, down = np.maximum(self.vectors, 0), np.minimum(self.vectors, 0)
        return (up @ lo.T + down @ hi.T).astype(np.int64), (up @ hi.T + down @ lo.T).astype(np.int64)


def _open(wave: Wave, floor: np.ndarray, least: np.ndarray, most: np.ndarray, labels: list, negative: bool) -> np.ndarray:
    """Which questions (anchor, window) a block with these bounds and labels can still answer."""
    labels = np.array(labels, np.int64)
    fits = (len(labels) > 1) | ~np.isin(wave.label, labels) if negative else np.isin(wave.label, labels)
    return fits[:, None] & (least[:, None] <= wave.hi) & (most[:, None] >= floor) & (wave.lo <= wave.hi)


def _needed(numbers: Numbers, negative: bool):
    """The blocks of a group of zones that a wave must read."""
    def needed(zones: pa.Table, table: pa.Table) -> pa.Table:
        out = []
        if len(zones) and len(table):
            for dims in sorted(set(zones["dims"].to_pylist())):
                own = zones.filter(pa.compute.equal(zones["dims"], dims))
                wave = Wave(table, numbers, dims, negative)
                if not wave.n:
                    continue
                lo, hi = (numbers.unpack(b"".join(own[c].to_pylist()), dims, len(own)) for c in ("lo", "hi"))
                least, most = wave.bounds(lo, hi)
                for i, (block, region, labels) in enumerate(zip(own["block"].to_pylist(), own["region"].to_pylist(), own["labels_in"].to_pylist())):
                    if _open(wave, wave.lo, least[:, i], most[:, i], labels, negative).any():
                        out.append((table["wave"][0].as_py(), region, block))
        return pa.table({c: pa.array([r[k] for r in out], t) for k, (c, t) in enumerate((("wave", pa.int32()), ("region", pa.int64()), ("block", pa.int64())))})
    return needed


def _tile(numbers: Numbers, negative: bool, k: int):
    """The blocks of a region against a wave: the best ``k`` rows for every question."""
    def tile(held: pa.Table, table: pa.Table) -> pa.Table:
        out = []
        if len(held) and len(table):
            held = held.sort_by("block")
            for dims in sorted(set(held["dims"].to_pylist())):
                wave = Wave(table, numbers, dims, negative)
                if wave.n:
                    out.append(_answers(wave, [b for b in held.to_pylist() if b["dims"] == dims], numbers, dims, negative, k))
        cols = [np.concatenate([o[c] for o in out]) if out else np.empty(0, np.int64) for c in range(4)]
        return pa.table({"uid": cols[0], "window": pa.array(cols[1].astype(np.int32)), "score": cols[2], "id": cols[3]})
    return tile


def _answers(wave: Wave, held: list[dict], numbers: Numbers, dims: int, negative: bool, k: int) -> tuple[np.ndarray, ...]:
    width = wave.lo.shape[1]
    best = Best(wave.n * width, k)
    zones = [numbers.unpack(b"".join(b[c] for b in held), dims, len(held)) for c in ("lo", "hi")]
    least, most = wave.bounds(*zones)
    for b in np.argsort(-most.max(axis=0), kind="stable").tolist():
        block = held[b]
        ids, labels = _longs(block["ids"]), _longs(block["labels"])
        vectors = numbers.unpack(block["vectors"], dims, block["n"])
        floor = np.maximum(wave.lo, best.kth().reshape(wave.n, width))
        live = _open(wave, floor, least[:, b], most[:, b], block["labels_in"], negative)
        who = np.flatnonzero(live.any(axis=1))
        for some in np.array_split(who, -(-len(who) * len(ids) // PRODUCTS)) if len(who) else []:
            scores = (wave.vectors[some] @ vectors.T).astype(np.int64)
            fits = _unlike(labels, wave.label[some])
            if not negative:
                fits = ~fits
            fits &= wave.id[some][:, None] != ids[None, :]
            for w in range(width):
                r, c = np.nonzero(fits & (scores >= floor[some, w][:, None]) & (scores <= wave.hi[some, w][:, None]) & live[some, w][:, None])
                asked, found = some[r] * width + w, scores[r, c]
                # Among equal scores only a smaller id gains a place: a group of copies, whose ids ascend, is not sorted again and again.
                gains = (found > best.scores[asked, -1]) | (ids[c] < best.ids[asked, -1])
                best.add(asked[gains], found[gains], ids[c][gains])
    rows, scores, ids = best.found()
    return wave.uid[rows // width], rows % width, scores, ids


def _searched(table: DataFrame, anchors: DataFrame, numbers: Numbers, negative: bool, k: int, sizes: Sizes) -> DataFrame:
    """(uid, window, score, id, place): the best ``k`` rows of all blocks for every question of ``anchors``."""
    waves = anchors.select("wave").distinct()
    shared = max(1, table.count() // sizes.zones)
    zones = table.select("block", "region", "dims", "labels_in", "lo", "hi").withColumn("share", F.pmod(F.xxhash64("block"), F.lit(shared)))
    # Every wave meets every group of zones, a few hundred bytes a block; blocks follow only where the bounds let them.
    shares = waves.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shared - 1)))).withColumn("share", F.col("share").cast("long"))
    seen = (zones.join(shares, "share").select(F.col("wave").alias("l_wave"), F.col("share").alias("l_share"), "block", "region", "dims", "labels_in", "lo", "hi")
            .groupBy("l_wave", "l_share").cogroup(anchors.join(shares, "wave").groupBy("wave", "share")))
    needed = staged(seen.applyInArrow(_needed(numbers, negative), "wave int, region long, block long"), "needed")
    payload = table.select("block", "dims", "n", "labels_in", "lo", "hi", "ids", "labels", "vectors").join(needed, "block")
    tiles = needed.select("wave", "region").distinct()
    payload = payload.withColumns({"l_wave": F.col("wave") + 0, "l_region": F.col("region") + 0}).drop("wave", "region")
    met = payload.groupBy("l_wave", "l_region").cogroup(anchors.join(tiles, "wave").groupBy("wave", "region"))
    some = met.applyInArrow(_tile(numbers, negative, k), "uid long, window int, score long, id long")
    order = Window.partitionBy("uid", "window").orderBy(F.desc("score"), "id")
    return some.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _floored(x: Column, by: int) -> Column:
    """Whole-number division that rounds down, exact for any long."""
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by))


def mine(rows: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = SCALE, sizes: Sizes = Sizes(),
         id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``rows`` where ``anchors`` holds.

    Positives: the best rows of the anchor's label. Negatives, for each: the best rows of other labels whose score is ``low`` to ``high`` percent of the positive's.
    """
    spark = rows.sparkSession
    vector = ident(rows, vector_column)
    sound = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    valid = rows.where(ident(rows, id_column).isNotNull() & ident(rows, label_column).isNotNull() & vector.isNotNull() & F.coalesce(sound, F.lit(False)))
    plain = valid.select(ident(rows, id_column).cast("long").alias("id"), ident(rows, label_column).cast("long").alias("label"), vector.alias("vector"),
                         F.coalesce(anchors, F.lit(False)).alias("chosen"))
    size = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))
    seen = plain.agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("top"), F.max(F.size("vector")).alias("dims")).first()
    numbers = Numbers(math.ceil(scale * (seen["top"] or 0.0)) + 1, seen["dims"] or 0)
    with tidy(spark):
        table = blocks(plain, F.col("chosen"), numbers, seen["n"], sizes, scale=scale, positives=positives)
        known = table.agg(F.coalesce(F.sum("asked"), F.lit(0)).alias("asked"), F.coalesce(F.max("part"), F.lit(0)).alias("last")).first()
        waves = max(1, math.ceil(known["asked"] / sizes.wave))
        wave = F.floor(F.col("part") * F.lit(waves) / (known["last"] + 1)).cast("int")
        found = table.where("asked > 0").select("block", "n", "dims", "ids", "labels", "flags", "seeds", "vectors", wave.alias("wave"))
        asked = staged(found.mapInArrow(_anchors(numbers), "uid long, id long, label long, dims int, seed long, wave int, vector binary"), "anchors")
        near = staged(_searched(table, asked, numbers, False, positives, sizes), "positives")
        ranked = F.array_sort(F.collect_list(F.struct("place", "score", F.col("id").alias("positive"))))         # at most ``positives`` each
        near = near.groupBy("uid").agg(ranked.alias("near"))
        window = lambda part: F.transform("near", part)
        opened = asked.join(near, "uid").withColumn("lows", window(lambda p: -_floored(p["score"] * F.lit(-low), 100))).withColumn(
            "highs", window(lambda p: _floored(p["score"] * F.lit(high), 100)))
        opened = staged(opened, "windows")
        hard = staged(_searched(table, opened.drop("near"), numbers, True, negatives, sizes), "negatives")
        positive = F.col("near")[F.col("window")]
        return hard.select("uid", "window", "score", F.col("id").alias("negative"), "place").join(opened.select("uid", F.col("id").alias("anchor"), "near"), "uid").select(
            F.col("anchor").alias("anchor_id"), positive["positive"].alias("positive_id"), F.col("place").cast("int").alias("rank"),
            F.col("negative").alias("negative_id"), positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))
