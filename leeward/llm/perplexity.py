"""Log probabilities of texts under an interpolated modified Kneser-Ney bigram model, counted in Spark.

Tokens are the words of a text (A-Z lower-cased) and one end. A first shuffle brings the counted bigrams of each piece of text
together by context, a second one the words with their counts and numbers of contexts. Each reduce task writes its
range as sorted hash arrays into the shared folder; workers map those files into memory and look up the distinct
bigrams of a piece of text at a time. What the driver sees is one row of totals per range.

The files are named by range and replaced whole, so a task that runs again writes the same file. A shared folder that
no worker can map (another scheme than ``file``) is copied range by range into the worker's own folder first.

Null texts are empty: one token, the end. Without training tokens every probability is 1 / (words + 1), that is 1. Nulls in other
columns do not matter; repeated rows count again. No rows give no rows.
"""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leeward.llm.blobs import bucket_count, cut, planes, squeeze, unplanes, unsqueeze
from leeward.llm.repeats import bucket_of
from leeward.llm.shared import fresh_folder, ident
from leeward.llm.words import mix, pieces

END, BEGIN = np.uint64(1), np.uint64(2)           # no word hashes to them: a word's hash is 3 or more
BYTES_PER_BUCKET = 10 << 20
_BUCKET_SALT = np.uint64(0xC2B2AE3D27D4EB4F)
SCORES = "n_tokens long, n_known long, base_score double, score double"


def tokens(piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, context, token) of every token of a piece of text, in order; token hashes have 56 bits."""
    words = piece.words(lower=True)
    hashes = np.maximum(words.hashes() >> np.uint64(8), np.uint64(3))
    rows = np.repeat(np.arange(piece.n), words.counts + 1)
    last = np.cumsum(words.counts + 1) - 1
    token = np.full(len(rows), END, np.uint64)
    inside = np.ones(len(rows), bool)
    inside[last] = False
    token[inside] = hashes
    context = np.empty(len(rows), np.uint64)
    context[1:] = token[:-1]
    context[last[:-1] + 1] = BEGIN
    context[:1] = BEGIN
    return rows, context, token


def _home(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return bucket_of(mix(hashes ^ _BUCKET_SALT), buckets)


def pair_hash(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(context * np.uint64(0x9E3779B97F4A7C15) + mix(token))


def _sorted_counts(*keys: np.ndarray, weights: np.ndarray | None = None):
    """Distinct rows of ``keys`` (last key first in order) with their summed weights."""
    order = np.lexsort(keys)
    keys = [k[order] for k in keys]
    if not len(order):
        return [*keys, np.empty(0, np.int64)]
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    sums = np.diff(np.append(first, len(order))) if weights is None else np.add.reduceat(weights[order], first)
    return [*[k[first] for k in keys], sums]


def _send_pairs(buckets: int):
    def send(batches):
        for batch in batches:
            for piece in pieces(batch.column("text")):
                _, context, token = tokens(piece)
                home = _home(context, buckets)
                token, context, home, n = _sorted_counts(token, context, home)
                rows = [(b, squeeze(context[i:j]), planes(token[i:j]), planes(n[i:j].astype(np.uint32))) for b, i, j in cut(home)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3)]],
                    ["bucket", "contexts", "tokens", "counts"])
    return send


def _histogram(values: np.ndarray) -> np.ndarray:
    """How many values are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(values, 5), minlength=6)[1:5]


def _write(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """One file, put in place whole."""
    fs, path = pafs.FileSystem.from_uri(folder)
    part = f"{path}/.{name}-{os.getpid()}-{os.urandom(4).hex()}"
    with fs.open_output_stream(part) as out:
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes())
    fs.move(part, f"{path}/{name}")


def _keep_pairs(folder: str, buckets: int):
    """Reduce side of the first shuffle: write the range's bigrams and contexts, pass its words on."""
    def keep(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        home = rows[0]["bucket"]
        context = np.concatenate([unsqueeze(r["contexts"]) for r in rows])
        token = np.concatenate([unplanes(r["tokens"], np.uint64) for r in rows])
        n = np.concatenate([unplanes(r["counts"], np.uint32) for r in rows]).astype(np.int64)
        token, context, n = _sorted_counts(token, context, weights=n)
        first = np.concatenate([[0], np.flatnonzero(context[1:] != context[:-1]) + 1])
        stats = np.stack([np.add.reduceat(x, first) for x in (n, n == 1, n == 2, n >= 3)]).astype(np.int64)
        names = context[first]
        keys = pair_hash(context, token)
        order = np.argsort(keys, kind="stable")
        keys, many = keys[order], n[order]
        big = np.flatnonzero(many >= 255)
        _write(folder, f"pairs-{home}", [keys, names, stats, keys[big], many[big], np.minimum(many, 255).astype(np.uint8)])
        word, contexts = _sorted_counts(token)
        _, total = _sorted_counts(token, weights=n)
        to = _home(word, buckets)
        order = np.lexsort((word, to))
        word, contexts, total, to = word[order], contexts[order], total[order], to[order]
        out = [(b, squeeze(word[i:j]), planes(total[i:j].astype(np.int64)), planes(contexts[i:j].astype(np.int64)), None) for b, i, j in cut(to)]
        out.append((home, None, None, None, [home, len(keys), len(names), len(big), *_histogram(n).tolist()]))
        return pa.table([pa.array([r[0] for r in out], pa.int32()), *[pa.array([r[k] for r in out], pa.binary()) for k in (1, 2, 3)],
                         pa.array([r[4] for r in out], pa.list_(pa.int64()))], names=["bucket", "words", "totals", "contexts", "figures"])
    return keep


def _keep_words(folder: str):
    """Reduce side of the second shuffle: write the range's words, return the figures of all ranges."""
    def keep(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        told = [r["figures"] for r in rows if r["figures"] is not None]
        parts = [r for r in rows if r["words"] is not None]
        words = []
        if parts:
            word = np.concatenate([unsqueeze(r["words"]) for r in parts])
            total, contexts = (np.concatenate([unplanes(r[c], np.int64) for r in parts]) for c in ("totals", "contexts"))
            key, total = _sorted_counts(word, weights=total)
            _, contexts = _sorted_counts(word, weights=contexts)
            _write(folder, f"words-{parts[0]['bucket']}", [key, total, contexts])
            three = contexts >= 3
            words.append([parts[0]["bucket"], len(key), int(total.sum()), int(contexts.sum()), *_histogram(contexts).tolist(), int(three.sum())])
        return pa.table([pa.array(["pairs"] * len(told) + ["words"] * len(words)), pa.array([*told, *words], pa.list_(pa.int64()))],
                        names=["kind", "figures"])
    return keep


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of items seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 > 0 else 0.5
    out = [1 - 2 * y * n2 / n1 if n1 > 0 else 0.5, 2 - 3 * y * n3 / n2 if n2 > 0 else 1.0, 3 - 4 * y * n4 / n3 if n3 > 0 else 1.5]
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(out))


@dataclass(frozen=True)
class Model:
    folder: str
    buckets: int
    pairs: dict          # range -> (pairs, contexts, large counts)
    words: dict          # range -> words
    train_tokens: int
    vocabulary: int
    pair_discounts: tuple
    word_discounts: tuple
    word_contexts: int   # distinct bigrams
    word_floor: float    # probability mass left for the uniform distribution


def fit(docs: DataFrame, *, text_column: str = "text", bytes_per_bucket: int = BYTES_PER_BUCKET) -> Model:
    """Count a model from all texts of ``docs``."""
    buckets = bucket_count(docs, text_column, bytes_per_bucket)
    folder = fresh_folder(docs.sparkSession, "bigrams")
    sent = docs.select(ident(docs, text_column).alias("text")).mapInArrow(
        _send_pairs(buckets), "bucket int, contexts binary, tokens binary, counts binary")
    kept = sent.groupBy("bucket").applyInArrow(
        _keep_pairs(folder, buckets), "bucket int, words binary, totals binary, contexts binary, figures array<long>")
    figures = kept.groupBy("bucket").applyInArrow(_keep_words(folder), "kind string, figures array<long>").collect()
    pairs = {r["figures"][0]: tuple(r["figures"][1:4]) for r in figures if r["kind"] == "pairs"}
    words = {r["figures"][0]: r["figures"][1] for r in figures if r["kind"] == "words"}
    of_pairs = np.array([r["figures"][4:8] for r in figures if r["kind"] == "pairs"], np.int64).reshape(-1, 4).sum(axis=0)
    told = np.array([r["figures"][1:] for r in figures if r["kind"] == "words"], np.int64).reshape(-1, 8).sum(axis=0)
    down = discounts(told[3:7])
    left = down[0] * told[3] + down[1] * told[4] + down[2] * told[7]
    return Model(folder, buckets, pairs, words, int(told[1]), int(told[0]), discounts(of_pairs), down, int(told[2]),
                 float(left / told[2]) if told[2] else 1.0)


class Mapped:
    """The model's files in this worker, mapped when first asked for."""

    def __init__(self, model: Model):
        self.model = model
        self.files: dict[str, np.ndarray] = {}

    def _bytes(self, name: str) -> np.ndarray:
        if name not in self.files:
            fs, path = pafs.FileSystem.from_uri(self.model.folder)
            path = f"{path}/{name}"
            if not isinstance(fs, pafs.LocalFileSystem):
                own = f"{tempfile.mkdtemp()}/{name}"
                pafs.copy_files(path, own, source_filesystem=fs, destination_filesystem=pafs.LocalFileSystem())
                path = own
            self.files[name] = np.memmap(path, np.uint8, "r")
        return self.files[name]

    def _views(self, name: str, shapes) -> list[np.ndarray]:
        raw, at, out = self._bytes(name), 0, []
        for kind, n in shapes:
            size = np.dtype(kind).itemsize * n
            out.append(raw[at:at + size].view(kind))
            at += size
        return out

    def words(self, tokens_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, number of contexts) of distinct tokens."""
        count, contexts = np.zeros(len(tokens_), np.int64), np.zeros(len(tokens_), np.int64)
        for b, at in _by_home(_home(tokens_, self.model.buckets)):
            if b in self.model.words:
                n = self.model.words[b]
                keys, totals, wide = self._views(f"words-{b}", ((np.uint64, n), (np.int64, n), (np.int64, n)))
                place, hit = _find(keys, tokens_[at])
                count[at[hit]], contexts[at[hit]] = totals[place], wide[place]
        return count, contexts

    def pairs(self, context: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, [context's total, followers seen once, twice, more often]) of distinct bigrams."""
        count, stats = np.zeros(len(context), np.int64), np.zeros((4, len(context)), np.int64)
        hashes = pair_hash(context, token)
        for b, at in _by_home(_home(context, self.model.buckets)):
            if b in self.model.pairs:
                n, m, k = self.model.pairs[b]
                keys, names, own, large, much, small = self._views(
                    f"pairs-{b}", ((np.uint64, n), (np.uint64, m), (np.int64, 4 * m), (np.uint64, k), (np.int64, k), (np.uint8, n)))
                asked = at[np.argsort(hashes[at], kind="stable")]
                place, hit = _find(keys, hashes[asked])
                found = small[place].astype(np.int64)
                big = np.flatnonzero(found == 255)
                if len(big):
                    found[big] = much[np.searchsorted(large, hashes[asked[hit]][big])]
                count[asked[hit]] = found
                place, hit = _find(names, context[at])
                stats[:, at[hit]] = own.reshape(4, m)[:, place]
        return count, stats


def _by_home(home: np.ndarray):
    order = np.argsort(home, kind="stable")
    for b, i, j in cut(home[order]):
        yield b, order[i:j]


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of those of ``asked`` that are in ``keys``, and which ones those are."""
    place = np.searchsorted(keys, asked)
    inside = np.flatnonzero(place < len(keys))
    hit = inside[keys[place[inside]] == asked[inside]]
    return place[hit], hit


def _less(n: np.ndarray, down: tuple) -> np.ndarray:
    return n - np.array([0.0, *down])[np.minimum(n, 3)]


def _score_piece(piece, mapped: Mapped) -> list[np.ndarray]:
    m = mapped.model
    rows, context, token = tokens(piece)
    word, which = np.unique(token, return_inverse=True)
    count, contexts = mapped.words(word)
    base = np.log10((count + 0.5) / (m.train_tokens + 0.5 * (m.vocabulary + 1)))
    single = (_less(contexts, m.word_discounts) / m.word_contexts if m.word_contexts else 0.0) + m.word_floor / (m.vocabulary + 1)
    order = np.lexsort((which, context))
    new = np.ones(len(order), bool)
    new[1:] = (context[order][1:] != context[order][:-1]) | (which[order][1:] != which[order][:-1])
    pair = np.empty(len(order), np.int64)
    pair[order] = np.cumsum(new) - 1
    first = order[new]
    seen, (total, one, two, more) = mapped.pairs(context[first], token[first])
    d1, d2, d3 = m.pair_discounts
    lower = np.broadcast_to(single, len(word))[which[first]]
    some = np.maximum(total, 1)
    chance = np.where(total > 0, _less(seen, m.pair_discounts) / some + (d1 * one + d2 * two + d3 * more) / some * lower, lower)
    n = piece.n
    return [np.bincount(rows, minlength=n), np.bincount(rows, weights=count[which] > 0, minlength=n).astype(np.int64),
            np.bincount(rows, weights=base[which], minlength=n), np.bincount(rows, weights=np.log10(chance)[pair], minlength=n)]


def score(docs: DataFrame, model: Model, *, text_column: str = "text") -> DataFrame:
    """``docs`` with a column ``lm`` (n_tokens, n_known, base_score, score): one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(f"struct<{SCORES.replace(' ', ':').replace(',:', ',')}>")
    def judge(texts: pa.Array) -> pa.Array:
        mapped = Mapped(shared.value)
        parts = [_score_piece(p, mapped) for p in pieces(texts)]
        columns = [np.concatenate([p[k] for p in parts]) if parts else np.empty(0) for k in range(4)]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["n_tokens", "n_known", "base_score", "score"])

    return docs.withColumn("lm", judge(ident(docs, text_column)))
