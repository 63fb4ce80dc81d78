"""Neighbours of vectors whose lengths differ."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leeward.llm import neighbours


@pytest.mark.parametrize("lengths", ["outlier", "mixed", "near", "skewed"])
def test_recall_with_lengths(spark, lengths):
    rng = np.random.default_rng(8)
    n = 6000
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if lengths == "outlier":
        x[17] *= 3
    elif lengths == "skewed":
        x *= rng.lognormal(0, 1, (n, 1))
    else:
        x *= rng.uniform(*{"mixed": (0.5, 2), "near": (1, 1.5)}[lengths], (n, 1))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(set)
    for r in neighbours.search(table, F.col("vec_id") % 40 == 0).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, n, 40):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(got[q] & {int(i) for i in np.argsort(-scores)[:20]})
    recall = hits / (20 * len(range(0, n, 40)))
    print(f"recall {lengths} {recall:.3f}")
    assert recall >= 0.9
