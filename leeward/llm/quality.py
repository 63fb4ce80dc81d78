"""Quality by nearest neighbours among labelled latent-semantic vectors.

Terms are hashed byte trigrams of the whole text and a few shape terms (a word that repeats the one
before it, and the like). Their log counts, weighted by inverse document frequency, are projected on
the leading singular vectors of a bounded labelled sample. The labelled vectors and the projection are
broadcast, ``2 * per_class`` rows whatever the input's size; each block of documents meets
all of them in one matrix product, and the nearest vote with their cosine as weight.

Nulls and empty texts have no terms and get the labelled share of class 1; so does every text when
nothing is labelled (share 0.5 then). Repeated rows score alike. A labelled id with several labels
counts as its largest, with several texts as its smallest. Labels other than 0 and 1 are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leeward.llm.shared import ident
from leeward.llm.words import SPACE, pieces

SHAPES = 8
ROWS = 512


def term_counts(data: np.ndarray, offsets: np.ndarray, terms: int) -> np.ndarray:
    """Counts per text (rows) and term: hashed byte trigrams, then the shape terms."""
    n = len(offsets) - 1
    width = terms + SHAPES
    out = np.zeros((n, width), np.float32)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    if len(data) >= 3:
        b = data.astype(np.uint32)
        h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        at = (h >> np.uint32(7)).astype(np.int64) % terms
        whole = doc[2:] == doc[:-2]
        out[:, :terms] = np.bincount((doc[:-2] * terms + at)[whole], minlength=n * terms).reshape(n, terms)
    for k, mask in enumerate((SPACE[data], (data >= 65) & (data <= 90), (data >= 48) & (data <= 57),
                              data == 10, (data < 128) & ~SPACE[data] & ~_LETTER_OR_DIGIT[data])):
        out[:, terms + k] = np.bincount(doc[mask], minlength=n)
    return out


_LETTER_OR_DIGIT = np.zeros(256, bool)
_LETTER_OR_DIGIT[48:58] = _LETTER_OR_DIGIT[65:91] = _LETTER_OR_DIGIT[97:123] = True


def blocks(texts: pa.Array, terms: int) -> Iterator[np.ndarray]:
    """Term weights of the texts, in order, a bounded number of texts at a time."""
    for piece in pieces(texts):
        words = piece.words()
        hashes = words.hashes()
        again = np.flatnonzero(hashes[1:] == hashes[:-1]) + 1
        doc = np.searchsorted(words.first, again, side="right") - 1
        repeats = np.bincount(doc[again > words.first[doc]], minlength=piece.n) / np.maximum(words.counts, 1)
        for a in range(0, piece.n, ROWS):
            b = min(a + ROWS, piece.n)
            lo, hi = piece.offsets[a], piece.offsets[b]
            counts = term_counts(piece.data[lo:hi], piece.offsets[a:b + 1] - lo, terms)
            shares = counts[:, terms:] / np.maximum(piece.offsets[a + 1:b + 1] - piece.offsets[a:b], 1)[:, None]
            shares[:, 5] = repeats[a:b]
            np.log1p(counts, out=counts)
            length = np.linalg.norm(counts[:, :terms], axis=1)
            counts[:, terms:] = shares * length[:, None]        # of one order with the trigrams, whatever the text's length
            yield counts


@dataclass(frozen=True)
class Model:
    terms: int
    projection: np.ndarray     # terms x rank, inverse document frequency included
    vectors: np.ndarray        # labelled rows x rank, unit length
    labels: np.ndarray
    prior: float
    neighbours: int

    def score(self, weights: np.ndarray) -> np.ndarray:
        out = np.full(len(weights), self.prior)
        if not len(self.vectors):
            return out
        z = weights @ self.projection
        norm = np.linalg.norm(z, axis=1)
        some = norm > 1e-12
        near = np.round((z[some] / norm[some, None]) @ self.vectors.T, 5)
        k = min(self.neighbours, near.shape[1])
        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        vote = np.where(near >= np.maximum(least, 1e-5)[:, None], near, 0)     # ties at the last place all vote
        total = vote.sum(axis=1, dtype=np.float64)
        share = (vote @ self.labels).astype(np.float64)
        out[some] = np.where(total > 0, share / np.where(total > 0, total, 1), self.prior)
        return np.clip(out, 0, 1)


def _decompose(weights: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors by subspace iteration (seeded)."""
    rank = min(rank, *weights.shape)
    basis = np.random.default_rng(7).standard_normal((weights.shape[1], min(rank + 8, weights.shape[1])))
    basis = basis.astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(weights.T @ (weights @ basis))
    _, _, rows = np.linalg.svd(weights @ basis, full_matrices=False)
    return basis @ rows[:rank].T


def fit(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
        label_column: str = "quality", per_class: int = 1500, terms: int = 2048, rank: int = 64,
        neighbours: int = 15) -> Model:
    """Fit on at most ``per_class`` labelled documents of each class, chosen by a hash of the id."""
    known = (labels.select(ident(labels, id_column).alias("id"), ident(labels, label_column).cast("int").alias("label"))
             .where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label")))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    seeded = known.withColumn("h", F.xxhash64("id", F.lit(11)))
    chosen = None
    for label in (0, 1):
        part = seeded.where(F.col("label") == label).orderBy("h", "id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    texts = (docs.select(ident(docs, id_column).alias("id"), ident(docs, text_column).alias("text"))
             .join(F.broadcast(chosen.drop("h")), "id").groupBy("id", "label").agg(F.min("text").alias("text")))

    def weigh(batches):
        for batch in batches:
            rows = [w.astype(np.float16).tobytes() for block in blocks(batch.column("text"), terms) for w in block]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(rows, pa.binary())], ["id", "label", "w"])

    kind = dict(texts.dtypes)["id"]
    rows = sorted(texts.mapInArrow(weigh, f"id {kind}, label int, w binary").collect(), key=lambda r: r["id"])
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    width = terms + SHAPES
    if not rows:
        return Model(terms, np.zeros((width, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), prior, neighbours)
    weights = np.array([np.frombuffer(r["w"], np.float16) for r in rows]).astype(np.float32)
    rare = np.log((1 + len(weights)) / (1 + (weights > 0).sum(axis=0))).astype(np.float32) + 1
    weights *= rare
    norm = np.linalg.norm(weights, axis=1)
    some = norm > 0
    y = np.array([r["label"] for r in rows], np.float32)[some]
    weights = weights[some] / norm[some, None]
    if not len(weights):
        return Model(terms, np.zeros((width, 1), np.float32), np.zeros((0, 1), np.float32), y, prior, neighbours)
    axes = _decompose(weights, rank)
    vectors = weights @ axes
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]
    return Model(terms, (rare[:, None] * axes).astype(np.float32), vectors.astype(np.float32), y, prior, neighbours)


def score(docs: DataFrame, model: Model, *, text_column: str = "text", output: str = "score") -> DataFrame:
    """``docs`` with a column ``output`` (replaced if there): the weighted share of neighbours of class 1. One pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def vote(texts: pa.Array) -> pa.Array:
        m = shared.value
        parts = [m.score(block) for block in blocks(texts, m.terms)]
        return pa.array(np.concatenate(parts) if parts else np.empty(0))

    return docs.withColumn(output, vote(ident(docs, text_column)))
