"""Shards, mixes, benchmark leaks, neighbours, and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from leeward.llm import decontaminate, mixing, neighbours, sharding
from leeward.llm.catalog import llm_queries, llm_sql

SMALL = "/root/testdata/sf0.001"


def test_shards(documents, corpus):
    one = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffled(documents, shards=7, bucket_bytes=20_000).select("r.doc_id", "shard", "slot").collect()}
    two = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffled(documents.repartition(5), shards=7, bucket_bytes=20_000).select("r.doc_id", "shard", "slot").collect()}
    assert one == two and set(one) == {i for i, _ in corpus}
    slots = defaultdict(list)
    for shard, slot in one.values():
        slots[shard].append(slot)
    assert set(slots) == set(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    other = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffled(documents, shards=7, seed=1, bucket_bytes=20_000).select("r.doc_id", "shard", "slot").collect()}
    assert other != one


def test_shards_written_and_awkward(spark, documents, tmp_path):
    again = documents.union(documents.limit(3)).union(documents.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    sharding.write_shards(sharding.shuffled(again, shards=3), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == again.count() and set(documents.columns) <= set(back.columns)
    assert sharding.shuffled(documents.where(F.lit(False))).count() == 0


def test_mix(documents, corpus):
    rows = mixing.mixed(documents).select("r.doc_id", "r.source", "size", "source_size", "target", "copies").collect()
    text = dict(corpus)
    assert len(rows) == len(corpus) and all(r.size == len(brute.words(text[r.doc_id])) for r in rows)
    sizes, taken, goal = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        goal[r.source] = r.target
        assert 0 <= r.copies <= 3
    assert None in sizes and all(r.source_size == sizes[r.source] for r in rows)
    assert goal == pytest.approx(brute.targets(dict(sizes)))
    assert all(abs(taken[s] - goal[s]) <= 2 for s in goal)
    again = mixing.mixed(documents.repartition(6)).select("r.doc_id", "copies").collect()
    assert {r.doc_id: r.copies for r in again} == {r.doc_id: r.copies for r in rows}
    made = mixing.apply_mix(documents)
    assert made.columns == documents.columns and made.count() == sum(r.copies for r in rows if r.size or r.copies)
    assert mixing.mixed(documents.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 5}, {"a": 7}, {"b": 10, None: 10, "a": 0}, {"é": 3, "z": 900, "Z": 3, "zz": 2}])
def test_targets_stop_at_the_bound(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    assert {r.source: r.target for r in mixing.targets(table).collect()} == pytest.approx(brute.targets(sizes))


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=12), st.floats(0, 1))
def test_budget(counts, share):
    lengths, n = np.array(sorted(counts)), np.array([counts[k] for k in sorted(counts)])
    budget = int(share * (lengths * n).sum())
    take = mixing.fit_budget(lengths, n, budget)
    assert (take >= 0).all() and (take <= n).all()
    assert abs(int((lengths * take).sum()) - budget) <= lengths.max() / 2


def test_leaks(spark):
    rng = random.Random(2)
    words = [f"v{i}" for i in range(4000)]
    items = [(k, " ".join(rng.sample(words, 20)).capitalize() + ".") for k in range(12)] + [(90, "too short"), (91, None), (3, None)]
    items.append((50, items[0][1]))
    docs, wanted = [(0, None), (1, ""), (2, "v1 v2 v3")], set()
    for k in range(60):
        text, item = rng.sample(words, 60), items[k % 12][1].rstrip(".").lower().split()
        if k % 3 == 0:
            text[10:10] = item
        elif k % 3 == 1:                       # every sixth word is another one
            text[30:30] = [w if i % 6 else "other" for i, w in enumerate(item)]
        if k % 3 < 2:
            wanted.add((100 + k, k % 12))
        docs.append((100 + k, ", ".join(text).upper() if k % 2 else " ".join(text)))
    docs.append((None, docs[3][1]))
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.id, r.item) for r in decontaminate.overlaps(table, bench).collect()}
    assert found == wanted | {(None, 0)}
    assert {(r.id, r.item) for r in decontaminate.overlaps(table, bench, block=50).collect()} == found
    left = decontaminate.remove(table, bench)
    assert left.columns == table.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, _ in docs if i is not None and i not in {a for a, _ in wanted})
    assert decontaminate.remove(table.where(F.lit(False)), bench).count() == 0
    assert decontaminate.remove(table, bench.where(F.lit(False))).count() == len(docs)


def test_one_block_of_seeds_is_broadcast_at_a_time_and_each_item_once(spark):
    items = spark.range(30).selectExpr("id as item_id", "concat_ws(' ', transform(sequence(0, 39), k -> concat('b', id, 'w', k))) as text")
    docs = items.selectExpr("item_id + 100 as doc_id", "concat('before ', text, ' after') as text")
    found = decontaminate.overlaps(docs, items, block=400)
    assert {(r.id, r.item, r.matched) for r in found.collect()} == {(100 + k, k, 13) for k in range(30)}
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_leaks_of_short_items(spark):
    """Every way to replace words of an item of 5 to 13 words that its rule allows, one more word, and one fewer kept."""
    from itertools import combinations
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(3, 14)]
    docs, wanted = [], set()
    for n, text in items:
        allowed = n - -(-4 * n // 5)
        for gone in range(allowed + 2):
            for places in combinations(range(n), gone):
                words = ["x" if k in places else w for k, w in enumerate(text.split())]
                docs.append((len(docs), " ".join(["before", "it", *words, "and", "after"])))
                if gone <= allowed and n >= 5:
                    wanted.add((len(docs) - 1, n, n - gone))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.id, r.item, r.matched) for r in decontaminate.overlaps(table, bench).collect()} == wanted
    few = bench.where("item_id = 7")
    assert {(r.id, r.item, r.matched) for r in decontaminate.overlaps(table, few).collect()} == {w for w in wanted if w[1] == 7}


@pytest.mark.parametrize("lengths", ["unit", "mixed"])
def test_neighbours(spark, lengths):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((800, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if lengths == "mixed":
        x *= rng.uniform(0.5, 2, (800, 1))
    x[100:160] = x[3]                          # a group of equal vectors
    x = x.astype(np.float32)
    odd = [(900, None), (901, [0.0] * 32), (902, [1.0, None] * 16), (903, [float("nan")] * 32), (904, [float("inf")] * 32), (905, [1.0]), (None, [1.0] * 32), (920, x[5].tolist())]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd + [(7, x[7].tolist())]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(3)
    got = defaultdict(list)
    for r in neighbours.search(table, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    asked = [*range(0, 800, 20), 920]
    assert set(got) == set(asked)
    all_ids, full = np.append(np.arange(800), 920), np.vstack([x, x[5]]).astype(np.float64)
    hits = 0
    for q in asked:
        answer = sorted(got[q])
        assert [a[0] for a in answer] == list(range(1, 21)) and q not in {a[1] for a in answer}
        vector = full[np.flatnonzero(all_ids == q)[0]]
        scores = full @ vector
        assert all(abs(scores[np.flatnonzero(all_ids == v)[0]] - s) < 1e-12 for _, v, s in answer)
        assert [(-s, v) for _, v, s in answer] == sorted((-s, v) for _, v, s in answer)
        order = [i for i in np.lexsort((all_ids, -np.round(scores, 12))) if all_ids[i] != q][:20]
        hits += len({int(all_ids[i]) for i in order} & {v for _, v, _ in answer})
    assert hits / (20 * len(asked)) >= 0.9


def test_few_neighbours(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): r.vec_id for r in neighbours.search(table, F.col("vec_id") % 20 == 0).collect()}
    assert got == {(0, 1): 20, (0, 2): 1, (20, 1): 0, (20, 2): 1}
    assert neighbours.search(table.where(F.lit(False)), F.col("vec_id") % 20 == 0).count() == 0


def test_queries_are_registered():
    names = sorted(llm_queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and set(llm_sql()) <= set(names)


def test_held_out_quality(spark):
    rows = {r.doc_id: r for r in llm_queries()["op1_quality_neighbours"](spark, SMALL).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    held = [(r.quality, rows[r.doc_id].predicted) for r in labels if rows[r.doc_id].held_out]
    assert sum(q == p for q, p in held) / len(held) >= 0.9


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    out = corpus_pipeline.run(spark, SMALL).collect()
    ids = {r.doc_id for r in out}
    kept = [(i, text[i]) for i in ids]
    assert all(size == 0 or least == i for i, (size, least) in brute.components(kept, 5, 80, 100).items())
    assert not [1 for i in ids for b in bench if b.text in text[i]]
    assert all(r.text == text[r.doc_id] for r in out) and max(Counter(r.doc_id for r in out).values()) <= 3
    counts = Counter(r.shard for r in out)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    assert [s for s, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
