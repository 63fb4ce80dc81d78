"""Repeated byte strings by a family of sorted suffix indexes that grows in levels.

A string of ``width`` bytes holds ``width - ANCHOR + 1`` runs of ``ANCHOR`` bytes; the one with the least hash (the first of equals)
is its anchor, so equal strings have equal anchors in equal places. Suffixes that start at anchors are the only ones indexed:
a new batch (a piece of text) becomes an array of its anchor suffixes in order of their leading bytes' hash, with a hash of all that
the strings of the anchor span. In the range a suffix belongs to, batches join the family: a batch is merged
with the newest level while that is no larger, and the scan of a merge finds long matches, suffixes that agree in the
whole span. The later one is decided, all its strings are repeats, and leaves the index. So levels grow geometrically and hold distinct spans.

What remains are anchors that occur with different spans (the ends of a repeat). Their strings are hashed one by one, from the
texts, and counted by hash; every occurrence but the first is a repeat. Strings are told apart by hashes of 56 bits
plus the bits of their range, so the width grows with the corpus.

Order is (id, text hash, start): rows with one id and different texts count as documents in order of a hash of their text. Rows equal in id and
text are one document. Null texts are empty; rows with a null id neither remove nor lose anything. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from leeward.llm.blobs import bucket_count, cut, planes, squeeze, unplanes, unsqueeze
from leeward.llm.repeats import bucket_of, doc_table, documents, spread, target_of, text_mark
from leeward.llm.shared import ident, staged, tidy, unused
from leeward.llm.words import _BYTE, BASES, mix, pieces, powers, rows_of

ANCHOR = 50
BYTES_PER_BUCKET = 16 << 20
SENT = "bucket int, docs binary, keys binary, spans binary, rows binary, lows binary, counts binary"
RANGES = "target int, asks boolean, docs binary, rows binary, lows binary, counts binary"


class Rolling:
    """Hashes of any run of bytes of a piece, from prefix sums."""

    def __init__(self, data: np.ndarray, base: np.uint64):
        self.up, self.down = powers(base, len(data))
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(_BYTE[data] * self.up[:len(data)], out=self.sums[1:])

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n] + np.uint64(width))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row: running minima from both ends of blocks of that width."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


def anchors(piece, width: int):
    """(row, low, count, anchor hash, second hash, span hash) of every anchor: strings low .. low + count - 1 share it."""
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), *[np.empty(0, np.uint64)] * 3
    if len(piece.data) < width:
        return none
    rolling, other = Rolling(piece.data, BASES[1]), Rolling(piece.data, BASES[2])
    hashes = rolling.all(ANCHOR)
    place = np.arange(len(hashes), dtype=np.uint64)
    least = sliding_least((hashes >> np.uint64(32) << np.uint64(32)) | place, width - ANCHOR + 1)
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(at))
    row = np.repeat(np.arange(piece.n), np.diff(piece.offsets))[:len(at)]
    inside = start + width <= piece.offsets[row + 1]
    start, at, row = start[inside], at[inside], row[inside]
    if not len(start):
        return none
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    low, at, row = start[first], at[first], row[first]
    span = mix(rolling.run(low, low + count - 1 + width) ^ mix((at - low).astype(np.uint64) + np.uint64(width)))
    return row, low - piece.offsets[row], count, hashes[at], other.run(at, at + ANCHOR), span


def split_firsts(ids, marks, lows, *keys) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys, then document and place; the first of each key, and those after it that are other occurrences."""
    order = np.lexsort((lows, marks, ids, *keys[::-1]))
    if not len(order):
        return order, order, order
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    head = np.flatnonzero(new)
    first = order[np.repeat(head, np.diff(np.append(head, len(order))))]
    other = (ids[order] != ids[first]) | (marks[order] != marks[first]) | (lows[order] != lows[first])
    return order[head], order[other], order


def range_rows(docs: np.ndarray, rows, lows, counts, asks: bool) -> list[tuple]:
    """A row per target: (target, asks, documents in it, row in that table, first start, number of starts)."""
    out = []
    if not len(rows):
        return out
    order = np.lexsort((lows, rows, docs[2][rows]))
    rows, lows, counts = rows[order], lows[order], counts[order]
    for t, a, b in cut(docs[2][rows]):
        own, local = np.unique(rows[a:b], return_inverse=True)
        out.append((t, asks, planes(docs[:, own].ravel()), planes(local.astype(np.uint32)), planes(lows[a:b].astype(np.uint32)),
                    planes(counts[a:b].astype(np.uint32))))
    return out


def _ranges_table(out: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.bool_()),
                     *[pa.array([r[k] for r in out], pa.binary()) for k in range(2, 6)]],
                    names=["target", "asks", "docs", "rows", "lows", "counts"])


def _sent_batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in out], pa.int32()), *[pa.array([r[k] for r in out], pa.binary()) for k in range(1, 7)]],
        ["bucket", "docs", "keys", "spans", "rows", "lows", "counts"])


def _send_anchors(width: int, buckets: int):
    def send(batches):
        for batch in batches:
            for piece in pieces(batch.column("text")):
                row, low, count, key, second, span = anchors(piece, width)
                if not len(row):
                    continue
                docs = doc_table(batch, piece.first, piece.n)
                home, key = bucket_of(second, buckets), key >> np.uint64(8)
                keep, lost, _ = split_firsts(docs[0][row], docs[1][row], low, home, key, span)
                table = planes(docs.ravel())
                home, row_, low_, count_ = home[keep], row[keep], low[keep], count[keep]
                key, span = key[keep], span[keep]
                out = [(b, table, squeeze(key[i:j]), planes(span[i:j]), planes(row_[i:j].astype(np.uint32)),
                        planes(low_[i:j].astype(np.uint32)), planes(count_[i:j].astype(np.uint32))) for b, i, j in cut(home)]
                out += [(t % buckets, d, None, None, r, s, c) for t, _, d, r, s, c in range_rows(docs, row[lost], low[lost], count[lost], False)]
                yield _sent_batch(out)
    return send


class Family:
    """Levels of a sorted index of distinct (anchor, span), the newest and smallest last."""

    def __init__(self, docs: np.ndarray):
        self.docs, self.levels, self.decided = docs, [], []

    def add(self, batch: list[np.ndarray]) -> None:
        """``batch``: anchor, span, row, low and count, ordered by the first two."""
        while self.levels and len(self.levels[-1][0]) <= len(batch[0]):
            batch = self.merge(self.levels.pop(), batch)
        self.levels.append(batch)

    def merge(self, one: list[np.ndarray], two: list[np.ndarray]) -> list[np.ndarray]:
        both = [np.concatenate(pair) for pair in zip(one, two)]
        key, span, row, low, _ = both
        keep, lost, _ = split_firsts(self.docs[0][row], self.docs[1][row], low, key, span)
        self.decided.append([x[lost] for x in both[2:]])
        return [x[keep] for x in both]

    def whole(self) -> list[np.ndarray]:
        while len(self.levels) > 1:
            self.levels.append(self.merge(self.levels.pop(), self.levels.pop()))
        return self.levels[0]


def _index(table: pa.Table) -> pa.Table:
    """One range: merge the batches level by level; ask for the strings of anchors with several spans."""
    out, docs, base, batches = [], [], 0, []
    for r in table.to_pylist():
        if r["keys"] is None:
            own = unplanes(r["docs"], np.int64).reshape(3, -1)
            out.append((int(own[2, 0]), False, r["docs"], r["rows"], r["lows"], r["counts"]))
            continue
        docs.append(unplanes(r["docs"], np.int64).reshape(3, -1))
        batches.append([unsqueeze(r["keys"]), unplanes(r["spans"], np.uint64), unplanes(r["rows"], np.uint32).astype(np.int64) + base,
                        unplanes(r["lows"], np.uint32), unplanes(r["counts"], np.uint32)])
        base += docs[-1].shape[1]
    if batches:
        family = Family(np.concatenate(docs, axis=1))
        for batch in batches:
            family.add(batch)
        key, _, row, low, count = family.whole()
        for lost in family.decided:
            out += range_rows(family.docs, *lost, False)
        same = key[1:] == key[:-1]
        several = np.zeros(len(key), bool)
        several[1:] |= same
        several[:-1] |= same
        out += range_rows(family.docs, row[several], low[several], count[several], True)
    return _ranges_table(out)


def gathered(table: pa.Table) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """(first starts, numbers of starts) of each (id, h)."""
    parts: dict[tuple[int, int], list] = {}
    columns = [table.column(c).to_pylist() for c in ("docs", "rows", "lows", "counts")]
    for docs, rows, lows, counts in zip(*columns):
        docs = unplanes(docs, np.int64).reshape(3, -1)
        rows, lows, counts = (unplanes(x, np.uint32) for x in (rows, lows, counts))
        for row, a, b in cut(rows):
            parts.setdefault((int(docs[0, row]), int(docs[1, row])), []).append((lows[a:b], counts[a:b]))
    return {k: (np.concatenate([p[0] for p in v]).astype(np.int64), np.concatenate([p[1] for p in v]).astype(np.int64))
            for k, v in parts.items()}


def _send_strings(width: int, buckets: int):
    """Hashes of the strings asked for, sent to their ranges."""
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, batches = gathered(right), []
        if asked:
            left = left.combine_chunks()
            for batch in left.to_batches():
                ids, marks = batch.column("id").to_pylist(), batch.column("h").to_pylist()
                for piece in pieces(batch.column("text")):
                    rows, starts = [], []
                    for i in range(piece.n):
                        found = asked.get((ids[piece.first + i], marks[piece.first + i]))
                        if found is not None:
                            own = spread(*found)
                            rows.append(np.full(len(own), i))
                            starts.append(own)
                    if not rows:
                        continue
                    rows, starts = np.concatenate(rows), np.concatenate(starts)
                    at = piece.offsets[rows] + starts
                    key = Rolling(piece.data, BASES[1]).run(at, at + width)
                    home = bucket_of(Rolling(piece.data, BASES[2]).run(at, at + width), buckets)
                    docs = doc_table(batch, piece.first, piece.n)
                    key = key >> np.uint64(8)
                    keep, lost, _ = split_firsts(docs[0][rows], docs[1][rows], starts, home, key)
                    table = planes(docs.ravel())
                    one = np.ones(len(rows), np.uint32)
                    out = [(b, table, squeeze(key[keep[i:j]]), None, planes(rows[keep[i:j]].astype(np.uint32)),
                            planes(starts[keep[i:j]].astype(np.uint32)), planes(one[keep[i:j]])) for b, i, j in cut(home[keep])]
                    out += [(t % buckets, d, None, None, r, s, c)
                            for t, _, d, r, s, c in range_rows(docs, rows[lost], starts[lost], one[lost], False)]
                    batches.append(_sent_batch(out))
        if batches:
            return pa.Table.from_batches(batches)
        return pa.Table.from_batches([_sent_batch([])])
    return send


def _decide(table: pa.Table) -> pa.Table:
    """One range of strings: every occurrence but the first."""
    out, docs, base, keys, rows, lows = [], [], 0, [], [], []
    for r in table.to_pylist():
        own = unplanes(r["docs"], np.int64).reshape(3, -1)
        if r["keys"] is None:
            out.append((int(own[2, 0]), False, r["docs"], r["rows"], r["lows"], r["counts"]))
            continue
        docs.append(own)
        keys.append(unsqueeze(r["keys"]))
        rows.append(unplanes(r["rows"], np.uint32).astype(np.int64) + base)
        lows.append(unplanes(r["lows"], np.uint32))
        base += own.shape[1]
    if docs:
        docs, keys, rows, lows = np.concatenate(docs, axis=1), np.concatenate(keys), np.concatenate(rows), np.concatenate(lows)
        _, lost, _ = split_firsts(docs[0][rows], docs[1][rows], lows, keys)
        out += range_rows(docs, rows[lost], lows[lost], np.ones(len(lost), np.uint32), False)
    return _ranges_table(out)


def _finish(names: list[str], extra: list[str], id_column: str, text_column: str, mark: str, width: int):
    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        found = gathered(right)
        kept, figures = [], []
        ids, marks = left.column(id_column).to_pylist(), left.column(mark).to_pylist()
        for key, text in zip(zip(ids, marks), left.column(text_column).cast(pa.large_binary()).to_pylist()):
            text = text or b""
            if key not in found:
                kept.append(text)
                figures.append((len(text), 0, 0))
                continue
            lows, counts = found[key]
            steps = np.zeros(len(text) + 1, np.int64)
            np.add.at(steps, lows, 1)
            np.add.at(steps, np.minimum(lows + counts - 1 + width, len(text)), -1)
            gone = np.cumsum(steps[:-1]) > 0
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            figures.append((len(text), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())))
        return pa.table([*[left.column(n) for n in names], pa.array(kept, pa.binary()),
                         *[pa.array([f[k] for f in figures], pa.int64()) for k in range(3)]],
                        names=[*names, *extra])
    return finish


def remove_repeats(docs: DataFrame, *, width: int = 100, id_column: str = "doc_id", text_column: str = "text",
                   bytes_per_bucket: int = BYTES_PER_BUCKET) -> DataFrame:
    """``docs`` with ``kept`` (the remaining bytes), ``n_bytes``, ``n_removed`` and ``n_spans``; a name that is taken gets ``_`` behind it."""
    buckets = bucket_count(docs, text_column, bytes_per_bucket)
    rows = documents(docs, id_column, text_column, buckets).where("id is not null")
    with tidy(docs.sparkSession):
        first = staged(rows.mapInArrow(_send_anchors(width, buckets), SENT).groupBy("bucket").applyInArrow(_index, RANGES), "anchors")
        asked = first.where("asks")
        strings = (rows.withColumn("target", F.col("t").cast("int")).groupBy("target").cogroup(asked.groupBy("target"))
                   .applyInArrow(_send_strings(width, buckets), SENT))
        second = staged(strings.groupBy("bucket").applyInArrow(_decide, RANGES), "strings")
    ranges = first.where("not asks").union(second)
    mark, target = unused(docs, "h"), unused(docs, "target")
    keyed = (docs.withColumn(mark, text_mark(ident(docs, text_column)))
             .withColumn(target, target_of(ident(docs, id_column).cast("long"), buckets).cast("int")))
    extra = [unused(docs, n) for n in ("kept", "n_bytes", "n_removed", "n_spans")]
    schema = StructType([*docs.schema.fields, StructField(extra[0], BinaryType()), *[StructField(n, LongType()) for n in extra[1:]]])
    return keyed.groupBy(target).cogroup(ranges.groupBy("target")).applyInArrow(
        _finish(docs.columns, extra, id_column, text_column, mark, width), schema)
