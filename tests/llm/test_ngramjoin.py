"""The n-gram join against all pairs."""

import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leeward.llm import graph, ngramjoin, toccurrence
from leeward.llm.toccurrence import Index, link_all


@pytest.mark.parametrize("n,num,block", [(3, 90, 1 << 20), (5, 80, 150), (2, 60, 200)])
def test_groups(corpus, documents, n, num, block):
    found = ngramjoin.groups(documents, n=n, num=num, den=100, bytes_per_bucket=20_000, block_members=block).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in found} == brute.components(corpus, n, num, 100)


def test_keep_one(spark, corpus, documents):
    again = documents.union(documents.where("doc_id % 2 = 0")).union(documents.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    left = ngramjoin.keep_one(again, bytes_per_bucket=20_000)
    assert left.columns == documents.columns
    wanted = {d for d, (size, least) in brute.components(corpus, 5, 80, 100).items() if size == 0 or least == d}
    ids = [r.doc_id for r in left.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(wanted) and ids.count(None) == 2


def test_no_rows(documents):
    assert ngramjoin.groups(documents.where(F.lit(False))).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (300, 200)], "a long, b long")
    found = {r.node: r.root for r in graph.components(edges).collect()}
    assert found == {**{i: 0 for i in range(41)}, 200: 200, 300: 200}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=20), min_size=2, max_size=12), st.integers(40, 100))
def test_search_finds_every_link(sets, num):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    alike = lambda a, b: 100 * len(a & b) >= num * len(a | b)
    index = Index(arrays)
    for s, a in zip(sets, arrays):
        assert sorted(index.search(a, num, 100)) == [j for j, o in enumerate(sets) if alike(s, o)]
    links = link_all(arrays, num, 100)
    assert all(alike(sets[i], sets[j]) for i, j in links)
    up = list(range(len(sets)))
    for i, j in links:
        up = [up[i] if u == up[j] else u for u in up]
    assert all(up[i] == up[j] for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j]))


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 400), st.integers(0, 40), st.sampled_from([(90, 100), (80, 100), (50, 100)]), st.integers(0, 2**32))
def test_alike_sets_share_a_part(size, changes, share, seed):
    num, den = share
    rng = np.random.default_rng(seed)
    one = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
    other = np.unique(np.concatenate([one[rng.permutation(len(one))[changes // 2:]], rng.integers(0, 1 << 63, changes - changes // 2, dtype=np.uint64)]))
    common = len(np.intersect1d(one, other))
    if not len(other) or den * common < num * (len(one) + len(other) - common):
        return
    rows = np.repeat([0, 1], [len(one), len(other)])
    row, keys = ngramjoin.part_hashes(rows, np.concatenate([one, other]), np.array([len(one), len(other)]), ngramjoin.Classes(num, den))
    assert set(keys[row == 0].tolist()) & set(keys[row == 1].tolist())


def star(n, where, size=100, edits=5):
    """``n`` sets, all but one near copies that are alike to that one only."""
    rng = np.random.default_rng(6)
    middle = np.unique(rng.integers(0, 1 << 60, size, dtype=np.uint64))
    sets = []
    for _ in range(n - 1):
        copy = middle.copy()
        copy[rng.permutation(len(copy))[:edits]] = rng.integers(0, 1 << 60, edits, dtype=np.uint64)
        sets.append(np.unique(copy))
    sets.insert(where, middle)
    return sets


@pytest.mark.parametrize("where", [0, 150, 299])
def test_middle_of_a_star_is_found_wherever_it_stands(where):
    asked = []

    class Counting(Index):
        def search(self, *args):
            asked.append(1)
            return super().search(*args)

        def shared(self, row):
            asked.append(1)
            return super().shared(row)
    before, toccurrence.Index = toccurrence.Index, Counting
    try:
        links = link_all(star(300, where), 90, 100)
    finally:
        toccurrence.Index = before
    assert len(links) == 299 and len(asked) < 30


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 40), st.sampled_from([50, 80, 90]), st.integers(1, 400))
def test_hubs_lose_no_link(seed, n, num, step):
    """Chains of edited copies of a few sets, with hubs and searches in any mix."""
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40), dtype=np.uint64)) for _ in range(3)]
    while len(sets) < n:
        new = np.unique(np.concatenate([sets[rng.integers(len(sets))], rng.integers(0, 60, 2, dtype=np.uint64)]))
        sets.append(np.delete(new, rng.integers(len(new))) if len(new) > 1 else new)
    before, toccurrence.HEAP_STEP = toccurrence.HEAP_STEP, step
    try:
        links = link_all(sets, num, 100)
    finally:
        toccurrence.HEAP_STEP = before
    up = list(range(n))
    for i, j in links:
        up = [up[i] if u == up[j] else u for u in up]
    for i in range(n):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            alike = 100 * both >= num * (len(sets[i]) + len(sets[j]) - both)
            assert not alike or up[i] == up[j]
    assert all(100 * len(np.intersect1d(sets[i], sets[j])) >= num * len(np.union1d(sets[i], sets[j])) for i, j in links)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_unite(edges):
    up = {}
    for a, b in edges:
        up.setdefault(a, {a})
        up.setdefault(b, {b})
        whole = up[a] | up[b]
        for x in whole:
            up[x] = whole
    a, b = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    child, root = graph.unite(a, b) if edges else ([], [])
    assert dict(zip(map(int, child), map(int, root))) == {x: min(c) for x, c in up.items() if min(c) != x}


def test_components_of_random_edges_over_many_tasks(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(900, i) for i in range(1000, 1100)]
    a, b = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    child, root = graph.unite(a, b)
    want = dict(zip(child.tolist(), root.tolist()))
    want.update({r: r for r in root.tolist()})
    found = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(13)).collect()
    assert len(found) == len(want) and {r.node: r.root for r in found} == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
