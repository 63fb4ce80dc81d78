"""Approximate nearest neighbours by cross-polytope hashing, with exact scores.

Three rounds of seeded sign flips and a fast Hadamard transform turn every vector; the nearest signed axis is its
bucket. A table joins the axis of one such rotation with the axis among the first ``second`` axes of
another; ``second`` grows with the number of vectors, so buckets do not. A query visits the
buckets in order of what it lacks to their axes (multiprobe), and every vector found there is scored exactly.

Equal vectors are one entry with its smallest ``k + 1`` ids, all that any answer can need, so a vector with a third of all
rows costs as much as any other. Large buckets are cut into blocks that the queries visit one by one. A score that a query's answer will
surely reach is known from a bounded sample of entries; of what lies below it a block sends on its best only.

Only directions are hashed. Entries lie in bands of length, each ``BAND`` times the next: a query leaves out the bands whose
longest vector cannot reach its sure score, and visits more buckets of a band the smaller the cosine that reaches it there,
up to all buckets of one table. So it does with the bands of few entries, if there are several bands.

Vectors that are null, zero, hold a null, NaN or infinity, or have another length than most, take no part; nor do null
ids. Rows equal in id and vector count once; rows with one id and several vectors are candidates each. Ties go to the smaller id. With no
more than ``k`` candidates all those found are returned. No rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leeward.llm.shared import ident, staged

SAMPLE = 8192
SLACK = 5              # the bound's place among all entries is at least about so many times the places asked for
PER_SECOND_AXIS = 4096
BAND = 1.1             # longest length of a band, times the shortest
BANDS = 128            # shorter vectors than these bands hold lie in the last one
SPARSE = 1024          # a band of up to so many entries is visited whole, if it isn't the only one
HASHED = "place int, block int, entry long, inner array<int>, least double, vector binary"


def hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


class Hasher:
    """Rotations of all tables; rows in, signed axes out."""

    def __init__(self, width: int, second: int, tables: int, seed: int):
        self.width, self.second, self.tables = width, second, tables
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 2, 3, width))

    def axes(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Signed coordinates under the two rotations of a table."""
        full = np.zeros((len(x), self.width))
        full[:, :x.shape[1]] = x
        out = []
        for half, keep in ((0, self.width), (1, self.second)):
            r = full
            for signs in self.signs[table, half]:
                r = hadamard(r * signs)
            out.append(np.concatenate([r[:, :keep], -r[:, :keep]], axis=1))
        return out[0], out[1] if self.second > 1 else np.zeros((len(x), 1))


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _directions(raw: np.ndarray) -> np.ndarray:
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _wanted(least: np.ndarray, cosine: np.ndarray, lengths: np.ndarray, tops: np.ndarray, sparse: np.ndarray,
            probes: int, buckets: int, tables: int) -> np.ndarray:
    """Buckets to visit by query and band; -1: all of one table.

    ``cosine`` is the angle's part in ``least``: what the same place among the sampled directions reaches.
    """
    needed = (least / lengths)[:, None] / tops[None, :]
    near = np.where((least > 0) & (cosine > 0), 1.0, 0.0)[:, None] * np.minimum(1, needed / np.where(cosine > 0, cosine, 1)[:, None])
    near = np.where(near > 0.999, 1.0, np.maximum(near, 0))
    wanted = np.ceil(buckets * (probes / buckets) ** (near ** 2) - 1e-6).astype(int)
    whole = sparse[None, :] | ((near < 1) & (wanted * tables >= 2 * buckets))
    return np.where(needed > 1 + 1e-9, 0, np.where(whole, -1, wanted))


def _hash_entries(hasher: Hasher, tops: np.ndarray, sparse: np.ndarray, probes: int, sample: np.ndarray, bound: int):
    inner_count = 2 * hasher.second if hasher.second > 1 else 1
    buckets = 2 * hasher.width * inner_count
    pointed = _directions(sample)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                raw = np.array(part.column("vector").to_pylist(), np.float64)
                entries, asks = part.column("entry").to_numpy(), part.column("asks").to_numpy(zero_copy_only=False)
                bands = part.column("band").to_numpy()
                x = _directions(raw)
                vectors = [v.tobytes() for v in raw]
                asking = np.flatnonzero(asks)
                q = x[asking]
                least = cosine = np.full(len(asking), -np.inf)
                at = len(sample) - bound
                if len(asking) and at > 0:
                    least = np.partition(raw[asking] @ sample.T, at, axis=1)[:, at]
                    least -= 1e-9 * (1 + np.abs(least))
                    cosine = np.partition(q @ pointed.T, at, axis=1)[:, at]
                wanted = _wanted(least, cosine, np.linalg.norm(raw[asking], axis=1), tops, sparse, probes, buckets, hasher.tables)
                rows = []
                for t in range(hasher.tables):
                    a, b = hasher.axes(x, t)
                    first, inner = a.argmax(axis=1), b.argmax(axis=1)
                    rows += [(t * 2 * hasher.width + int(first[i]), None, int(entries[i]), [int(bands[i] * inner_count + inner[i])], None, vectors[i])
                             for i in range(len(raw))]
                    if not len(asking):
                        continue
                    a, b = hasher.axes(q, t)
                    lack = ((a.max(axis=1, keepdims=True) - a) ** 2)[:, :, None] + ((b.max(axis=1, keepdims=True) - b) ** 2)[:, None, :]
                    lack = lack.reshape(len(asking), -1)
                    for i, own in enumerate(wanted):
                        most = max(own.max(), 1)
                        order = np.argpartition(lack[i], min(most, buckets) - 1)[:most]
                        order = order[np.argsort(lack[i, order])]
                        whole = np.arange(buckets if t == 0 else 0)
                        chosen = [whole if n < 0 else order[:n] for n in own]
                        outer, cell = np.divmod(np.concatenate(chosen), b.shape[1])
                        cell += np.repeat(np.arange(len(own)), [len(c) for c in chosen]) * inner_count
                        for axis in np.unique(outer):
                            rows.append((t * 2 * hasher.width + int(axis), -1, int(entries[asking[i]]),
                                         cell[outer == axis].tolist(), float(least[i]), vectors[asking[i]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                     pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int32())),
                     pa.array([r[4] for r in rows], pa.float64()), pa.array([r[5] for r in rows], pa.binary())],
                    ["place", "block", "entry", "inner", "least", "vector"])
    return run


def _scorer(k: int, inner_count: int):
    def score(table: pa.Table) -> pa.Table:
        asks = pc.is_valid(table.column("least")).to_numpy()
        entries = table.column("entry").to_numpy()
        inner = table.column("inner").combine_chunks()
        queries, stock = np.flatnonzero(asks), np.flatnonzero(~asks)
        out_q, out_c, out_s = [], [], []
        if len(queries) and len(stock):
            x = _matrix(table.column("vector").take(stock))
            where = inner.take(pa.array(stock)).flatten().to_numpy()
            q = _matrix(table.column("vector").take(queries))
            least = table.column("least").to_numpy()[queries]
            probes = inner.take(pa.array(queries))
            for start in range(0, len(queries), 256):
                part = slice(start, start + 256)
                own = probes.slice(start, 256)
                visit = np.zeros((len(own), inner_count), bool)
                visit[np.repeat(np.arange(len(own)), own.value_lengths().to_numpy()), own.flatten().to_numpy()] = True
                found = q[part] @ x.T
                allowed = visit[:, where]
                found[~allowed] = -np.inf
                # What lies below the bound is kept only as a block's best, so that no query is left short of entries.
                row, col = np.nonzero(allowed & ((found >= least[part][:, None]) | (found == found.max(axis=1, keepdims=True))))
                row += start
                exact = (q[row] * x[col]).sum(axis=1)            # the same sum wherever the pair is met
                order = np.lexsort((entries[stock[col]], -exact, row))
                row, col, exact = row[order], col[order], exact[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                best = rank <= k
                out_q.append(entries[queries[row[best]]])
                out_c.append(entries[stock[col[best]]])
                out_s.append(exact[best])
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.empty(0), kind)
        return pa.table([join(out_q, pa.int64()), join(out_c, pa.int64()), join(out_s, pa.float64())], names=["query", "entry", "score"])
    return score


def search(vectors: DataFrame, asks: Column, *, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding",
           tables: int = 8, probes: int = 16, seed: int = 3, block_rows: int = 50_000) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each row for which ``asks`` holds."""
    vector = ident(vectors, vector_column)
    rows = vectors.select(ident(vectors, id_column).cast("long").alias("id"), vector.cast("array<double>").alias("vector"),
                          F.coalesce(asks, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not size:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    width = size[0]["n"]
    rows = rows.where(F.size("vector") == width)
    few = (rows.withColumn("r", F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("r") <= k + 1)
           .groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids")))
    asking = rows.where("asks").select("vector").distinct().withColumn("asks", F.lit(True))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v))
    entries = staged(few.join(asking, "vector", "left").select(
        F.col("ids")[0].alias("first"), F.xxhash64("vector").alias("h"), "vector", "ids", F.coalesce("asks", F.lit(False)).alias("asks"),
        length.alias("length")), "entries")
    # Entries that share their smallest id (one id with several vectors) are told apart by their place.
    clash = entries.groupBy("first").count().where("count > 1").limit(1).count() > 0
    entries = entries.withColumn("entry", F.xxhash64("first", "h") if clash else F.col("first"))
    told = entries.agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("most")).first()
    fall = (F.log(F.lit(told["most"])) - F.log("length")) / math.log(BAND)
    entries = entries.withColumn("band", F.floor(F.coalesce(F.least(fall, F.lit(BANDS - 1.0)), F.lit(BANDS - 1.0))).cast("int"))
    bands = entries.groupBy("band").agg(F.max("length").alias("most"), F.count(F.lit(1)).alias("n")).orderBy("band").collect()
    number = F.create_map(*[F.lit(v) for at, r in enumerate(bands) for v in (r["band"], at)])
    entries = entries.withColumn("band", number[F.col("band")])
    tops = np.array([r["most"] for r in bands], np.float64)
    sparse = np.array([len(bands) > 1 and r["n"] <= SPARSE for r in bands])
    full = 1 << max(1, math.ceil(math.log2(width)))
    second = min(full, max(1, told["n"] // PER_SECOND_AXIS))
    hasher = Hasher(full, second, tables, seed)
    sample = np.array([r["vector"] for r in entries.orderBy(F.xxhash64("h"), "h").select("vector").limit(SAMPLE).collect()], np.float64)
    # k + 1 sampled entries reach the bound, so the answer does too; in a small table the bound is lower still.
    bound = max(k + 1, math.ceil(SLACK * (k + 1) * len(sample) / max(1, told["n"])))
    inner_count = 2 * second if second > 1 else 1
    visits = min(math.ceil(probes * max(1, full / 64) * second ** 0.85), 2 * full * inner_count)
    hashed = staged(entries.select("entry", "vector", "asks", "band").mapInArrow(
        _hash_entries(hasher, tops, sparse, visits, sample, bound), HASHED), "hashed")
    stock = hashed.where("block is null")
    blocks = (stock.groupBy("place").count().select("place", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks")))
    stock = stock.join(blocks, "place").withColumn("block", F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int")).drop("blocks")
    sent = (hashed.where("block is not null").drop("block").join(blocks, "place")
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks"))
    scored = stock.unionByName(sent).groupBy("place", "block").applyInArrow(
        _scorer(k, len(bands) * inner_count), "query long, entry long, score double")
    best = (scored.groupBy("query", "entry").agg(F.max("score").alias("score"))
            .withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "entry")))
            .where(F.col("r") <= k + 1).drop("r"))
    named = (best.join(entries.select("entry", "ids"), "entry")
             .select("query", "score", F.explode("ids").alias("vec_id"))
             .groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.negate("score").alias("s"), "vec_id"))), 1, 2 * k + 2).alias("all")))
    of_vector = entries.where("asks").select(F.col("entry").alias("query"), "vector").join(named, "query")
    answered = (rows.where("asks").select("id", "vector").distinct().join(of_vector, "vector")
                .select(F.col("id").alias("query_id"), F.slice(F.filter("all", lambda s: s["vec_id"] != F.col("id")), 1, k).alias("all")))
    return answered.select("query_id", F.posexplode("all").alias("place", "x")).select(
        "query_id", (F.col("place") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.negate("x.s").alias("score"))
