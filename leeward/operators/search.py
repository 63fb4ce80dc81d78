"""Documents for retrieval: overlapping chunks, and nearest vectors."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F


def chunk(docs: DataFrame, size: int = 200, overlap: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of ``size`` words, each beginning ``size - overlap`` words after the one before it.

    Whole texts are cut; the last chunk holds what is left. ``chunk_id`` depends on document,
    position and content only, so a second run gives the same ids.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than the chunk size")
    step = size - overlap
    words = F.filter(F.split(F.col(text), r"[ \t\n\r\f]+"), lambda w: w != "")
    df = docs.select(key, words.alias("words")).filter(F.size("words") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("words") - F.lit(size)) / step).cast("int"))
    # the parts are cut before they become rows, so no row carries the whole text
    parts = F.transform(F.sequence(F.lit(0), last), lambda c: F.struct(
        c.cast("long").alias("chunk_no"), F.slice("words", c * step + 1, F.lit(size)).alias("part")))
    df = df.select(key, F.inline(parts))
    df = df.select(key, "chunk_no", F.size("part").cast("long").alias("n_words"), F.array_join("part", " ").alias("chunk"))
    return df.withColumn("chunk_id", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("chunk_no").cast("string"), "chunk")))


def centroids(vectors: DataFrame, group: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean vector per group, summed element by element with merging before the shuffle."""
    parts = vectors.select(group, F.posexplode(vector).alias("pos", "x"))
    means = parts.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))),
                                                lambda s: s["m"]).alias("query_vector"))


def knn(queries: DataFrame, vectors: DataFrame, k: int = 10, block: int = 1000, query_key: str = "query_id",
        vector_key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k most similar vectors per query by dot product, exactly.

    ``queries`` (query_key, query_vector) meet the vectors in blocks of about ``block`` questions, each of which travels to
    the vectors as one array value, one pass over them per block. Each task keeps its own best k per query before anything
    is shuffled.
    """
    blocks = max(1, math.ceil(queries.count() / block))
    numbered = queries.select(F.struct(F.col(query_key).alias("q"), F.col("query_vector").alias("qv")).alias("one"),
                              F.pmod(F.xxhash64(query_key), F.lit(blocks)).alias("b"))
    passes = []
    for b in range(blocks):
        packed = numbered.filter(F.col("b") == b).agg(F.collect_list("one").alias("qs")).scalar()
        passes.append(vectors.select(vector_key, F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"),
                                     F.explode(packed).alias("query")))
    rows = reduce(DataFrame.unionAll, passes)
    score = F.aggregate(F.zip_with("v", "query.qv", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = rows.select(F.col("query.q").alias(query_key), vector_key, score.alias("score"))
    best = Window.partitionBy(query_key).orderBy(F.desc("score"), vector_key)
    return scored.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
