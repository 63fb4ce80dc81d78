"""Hard negatives, manifest and licence scan against plain versions."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leeward.llm import licences, manifest, negatives


# ---- hard negatives

def plain_negatives(rows, anchor, positives=5, count=3):
    seen = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (i, label, tuple(math.floor(256 * float(x)) for x in v))
        if row not in seen:
            seen.append(row)
    out = []
    for a in [r for r in seen if anchor(r[0])]:
        scored = sorted((-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in seen if r[0] != a[0] and len(r[2]) == len(a[2]))
        for p, pid, _ in [s for s in scored if s[2] == a[1]][:positives]:
            fit = [(n, i) for n, i, label in scored if label != a[1] and 50 * -p <= 100 * -n <= 95 * -p][:count]
            out += [(a[0], pid, k + 1, i, -p, -n) for k, (n, i) in enumerate(fit)]
    return sorted(out)


def awkward_vectors():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((700, 6)) + np.repeat(rng.standard_normal((7, 6)), 100, axis=0)
    x[200:430] = x[5]                                   # a third of the rows are equal vectors
    rows = [(i, v.astype(np.float32).tolist(), int(i % 4)) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [1.0] * 6, None), (902, [1.0, None] * 3, 1), (903, [float("nan")] * 6, 2), (904, [float("-inf")] * 6, 2),
             (905, [1.0], 1), (906, [2.0], 1), (910, [0.5], 2), (920, [], 3), (930, [], 1), (None, [1.0] * 6, 1), (940, [0.0] * 6, 0), (950, [-1.0] * 6, 0)]
    return rows + rows[20:40] + [(60, rows[61][1], 2)]   # repeated rows, and an id with two vectors


@pytest.mark.parametrize("sizes", [negatives.Sizes(), negatives.Sizes(block=16, region=2, wave=20, zones=3)])
def test_hard_negatives(spark, sizes):
    rows = awkward_vectors()
    table = spark.createDataFrame([(i, v, c, 1, "x") for i, v, c in rows], "vec_id long, embedding array<float>, label int, block int, region string").repartition(3)
    got = negatives.mine(table, F.col("vec_id") % 10 == 0, sizes=sizes)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_of_few_rows(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [0.4, 0.0], 2), (3, [0.3, 9.0], 2)], "vec_id long, embedding array<double>, label int")
    assert list(map(tuple, negatives.mine(table, F.col("vec_id") == 0).collect())) == [(0, 1, 1, 2, 32768, 26112), (0, 1, 2, 3, 32768, 19456)]
    assert negatives.mine(table, F.lit(False)).count() == 0
    assert negatives.mine(table.where(F.lit(False)), F.lit(True)).count() == 0
    huge = spark.createDataFrame([(0, [1e300], 1), (1, [1e300], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(OverflowError):
        negatives.mine(huge, F.lit(True))


def test_hilbert_neighbours_touch():
    for d, bits in ((2, 4), (3, 3)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        keys = [bytes(k) for k in negatives.hilbert(cells, bits)]
        walk = cells[sorted(range(len(keys)), key=lambda i: keys[i])]
        assert len(set(keys)) == len(keys) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 8))
def test_bounds_hold(seed, dims):
    rng = np.random.default_rng(seed)
    numbers = negatives.Numbers(300, dims)
    wave = negatives.Wave.__new__(negatives.Wave)
    wave.vectors = rng.integers(-300, 300, (5, dims)).astype(np.float64)
    block = rng.integers(-300, 300, (9, dims)).astype(np.float64)
    least, most = wave.bounds(block.min(axis=0)[None], block.max(axis=0)[None])
    scores = wave.vectors @ block.T
    assert (least[:, 0] <= scores.min(axis=1)).all() and (most[:, 0] >= scores.max(axis=1)).all() and numbers.work is np.float64


def test_zones_rule_out_blocks(spark):
    """Where vectors lie in separate corners, a wave reads the blocks of its own corner only."""
    rng = np.random.default_rng(2)
    corner = np.repeat(np.eye(16)[:8], 200, axis=0)
    x = corner + rng.uniform(-0.01, 0.01, corner.shape)
    numbers = negatives.Numbers(300, 16)
    whole = np.floor(256 * x).astype(np.int64)
    lo, hi = (f(whole.reshape(8, 200, 16), 1) for f in (np.min, np.max))
    wave = negatives.Wave.__new__(negatives.Wave)
    wave.vectors = whole[:1].astype(np.float64)
    _, most = wave.bounds(lo.astype(np.float64), hi.astype(np.float64))
    fifth = np.sort(whole[:200] @ whole[0])[-6]
    assert (most[0] >= fifth).sum() == 1 and numbers.code == "<i2"


# ---- manifest

def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(fields):
    return h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_fold(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_manifest(rows):
    """[(doc_id, leaf, subroot, root, proof, folded)]: rows are (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_fold([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = plain_fold([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            changed = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                changed = plain_leaf((*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])))
            proof = ""
            for tree, at in ((trees[g], i), (top, k)):
                for level in tree[:-1]:
                    first = at - at % 8
                    left, right = "".join(level[first:at]), "".join(level[at + 1:first + 8])
                    proof, changed, at = proof + left + right, h(left + changed + right), at // 8
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], h(proof), changed))
    return sorted(out, key=str)


def tampered(docs):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return {"when": F.crc32(F.col("doc_id").cast("string")) % 3 == 0, "text": lower}


def manifest_rows(kind):
    rows = [(i * 7 - 300, f"s{i % 3}" if i % 5 else None, ("en", "de", None, "fr", "Ä")[min(i % 11, 4)], i, f"Text Nummer {i} É" if i % 9 else None) for i in range(160)]
    if kind == "awkward":
        rows += [(5, "a", "xx", None, ""), (2**62, "a", "en", 1, "x" * 9000), (-2**62, "a", "en", 1, "Y"), (None, "a", "en", 1, "B"), (None, "a", "en", 1, "A"), (None, None, None, None, None)]
        rows += rows[:20] + [rows[3]] * 70 + [(rows[3][0], "other", rows[3][2], 1, "Other")] * 3
    if kind == "one":
        rows = rows[:1]
    if kind == "singles":
        rows = [(i, "s", f"l{i}", i, "T") for i in range(11)]
    return rows


@pytest.mark.parametrize("kind,levels", [("plain", 4), ("plain", 1), ("awkward", 4), ("awkward", 1), ("one", 4), ("singles", 1)])
def test_manifest(spark, kind, levels):
    rows = manifest_rows(kind)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, slot int, grp string").repartition(3)
    made = manifest.manifest(table, levels=levels, tampered=tampered)
    got = sorted([(r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in made.collect()], key=str)
    assert got == plain_manifest(rows)
    slots = {}
    for r in made.collect():
        slots.setdefault(r.grp, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_manifest_of_no_rows(spark):
    table = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest.manifest(table).count() == 0


# ---- licences

def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(licences.BETWEEN.replace("[", "[^", 1), lower)


def plain_scan(rows):
    source = licences.templates()
    words = [plain_words(t) for _, t in rows]
    vocabulary = {w for t in source for w in t.words}
    weight = {w: math.log((len(rows) + 1) / (sum(w in set(ws) for ws in words) + 1)) + 1e-9 for w in vocabulary}
    out = []
    for (i, _), ws in zip(rows, words):
        at = lambda k: ws[k] if 0 <= k < len(ws) else None  # noqa: E731,B023
        base = [(k, label) for k in range(len(ws)) for p, label in licences.BASE if ws[k:k + len(p.split())] == p.split()]
        notices = set()
        for t in source:
            index = licences.rare_words(t, weight)
            for k, w in enumerate(ws):
                for start in {k - o for o, x in index if x == w}:
                    met = sum(any(at(start + o + d) == x for d in (-1, 0, 1)) for o, x in index)
                    if met >= -(-2 * len(index) // 3) and all(
                            any(tuple(at(start + o + d + j) for j in range(len(p))) == p for d in (-1, 0, 1)) for o, p in t.phrases):
                        share = sum(weight[x] for j, x in enumerate(t.words) if at(start + j) == x) / sum(weight[x] for x in t.words)
                        notices.add((t.label, start, min(share, 1.0)))
        labels = sorted({b[1] for b in base} | {n[0] for n in notices})
        out.append((i, len(ws), len(base), min((b[0] for b in base), default=None), max((b[0] for b in base), default=None),
                    ",".join(sorted({b[1] for b in base})), ",".join(labels), 1.0 if base else round(max((n[2] for n in notices), default=0.0), 9)))
    return sorted(out, key=str)


TEXTS = [None, "", "...", "x" * 9000, "The MITK License", "Released under the MIT License.", "RELEASED UNDER -- THE -- mit license", "mit license", "License: MIT",
         "Licensed under the Apache License, Version 2.0 (the License)", "licensed under the Apache Software License version 2.0", "This is CC BY 4.0, CC-BY; cc,by",
         "Licensed under CC BY-NC 4.0.", "cc by", "general public license", "GNU General Public License, version 3", "This work is licensed under the GNU General Public License, version 3",
         "All rights reserved. all RIGHTS reserved", "license " * 5000, "cc " * 3000 + "by", "Ähre all rights reservedé", "all rights", "by cc", "é cc by ü",
         "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "free of charge, to any person", "some other words " * 400 + "Released under the MIT License"]


def test_licences(spark, corpus):
    rows = list(enumerate(TEXTS)) + [(None, TEXTS[5]), (5, TEXTS[5]), (5, "cc by")] + [(100 + i, t) for i, t in corpus]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, labels string, n_words int").repartition(3)
    made = licences.report(table)
    got = [(*r[:7], 1.0 if r.n_base else round(r.score, 9)) for r in made.collect()]
    assert sorted(got, key=str) == plain_scan(rows)
    assert {r.labels for r in made.where("doc_id in (5, 6, 9, 12, 16, 24, 26)").collect()} == {
        "mit", "apache-2.0", "cc-by,cc-by-nc", "gpl,gpl-3.0", "cc-by"}
    for r in made.where("size(notices) > 0 and doc_id is not null").collect():
        assert all(n.end > n.start and 0 <= n.share <= 1 for n in r.notices)
    assert licences.report(table.where(F.lit(False))).count() == 0


def test_key_phrases_are_in_their_templates():
    assert all(t.words[o:o + len(p)] == p for t in licences.templates() for o, p in t.phrases)
    with pytest.raises(ValueError):
        licences.templates((("x", "some words", ("others",)),))
