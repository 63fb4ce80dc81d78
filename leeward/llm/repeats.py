"""Repeated token windows across documents by Rabin-Karp hashing.

Map tasks hash every window of ``width`` words and send, per hash range, the sorted 56-bit hashes with the
place of each. The range ("bucket") comes from a second, independent polynomial, so a match agrees in
56 + log2(ranges) bits and the width grows with the corpus. A reduce task counts, within one range, the documents of each
hash and keeps the starts of windows whose words also start in a smaller id. Starts meet their texts again by
id; overlapping windows merge into maximal intervals.

Within a piece of text (``PIECE`` bytes) only the smallest id of a window goes to its range; the piece's other
documents already lose to it. So a passage or text that a third of all documents share sends one entry per piece.

Null texts are empty. Rows with a null id neither remove nor lose anything. Rows with one id and different texts are judged
apart and never against each other; rows equal in both get the same result. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from leeward.llm.blobs import bucket_count, cut, planes, squeeze, unplanes, unsqueeze
from leeward.llm.shared import ident, staged, tidy, unused
from leeward.llm.words import BASES, pieces, rows_of, runs

# One schema for both kinds of rows: hashes for a range (keys not null), or starts already decided.
SENT = "bucket int, docs binary, keys binary, rows binary, places binary"
STARTS = "target int, docs binary, rows binary, places binary"
BYTES_PER_BUCKET = 8 << 20


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def grouped_minimum(ids: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For entries sorted by ``keys``: the smallest id among the entries with the same keys."""
    if not len(ids):
        return ids
    change = np.zeros(len(ids) - 1, bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    first = np.concatenate([[0], np.flatnonzero(change) + 1])
    return np.repeat(np.minimum.reduceat(ids, first), np.diff(np.append(first, len(ids))))


def spread(lows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """low, low + 1, .., low + count - 1 for each range, in order."""
    return np.repeat(lows, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def starts_rows(docs: np.ndarray, rows: np.ndarray, places: np.ndarray) -> list[tuple]:
    """Decided starts, a row per target: (target, table of the documents in it, row in that table, place)."""
    out = []
    if not len(rows):
        return out
    order = np.lexsort((places, rows, docs[2][rows]))
    rows, places = rows[order], places[order]
    for t, a, b in cut(docs[2][rows]):
        own, local = np.unique(rows[a:b], return_inverse=True)
        out.append((t, planes(docs[:, own].ravel()), planes(local.astype(np.uint32)), planes(places[a:b].astype(np.uint32))))
    return out


def documents(docs: DataFrame, id_column: str, text_column: str, targets: int) -> DataFrame:
    """(id, h, t, text): ``h`` tells apart texts with one id, ``t`` is the group in which a document is put together again."""
    number = ident(docs, id_column).cast("long")
    return docs.select(number.alias("id"), text_mark(ident(docs, text_column)).alias("h"),
                       target_of(number, targets).cast("long").alias("t"), ident(docs, text_column).alias("text"))


def text_mark(text):
    """32 bits of a hash, which tell apart the few texts that may share an id."""
    return F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))


def target_of(number, targets: int):
    return F.pmod(F.xxhash64(number), F.lit(targets))


def doc_table(batch: pa.RecordBatch, first: int, n: int) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy()[first:first + n] for c in ("id", "h", "t")])


def _sender(width: int, buckets: int):
    def send(batches):
        for batch in batches:
            for piece in pieces(batch.column("text")):
                words = piece.words()
                hashes = words.hashes()
                at, keys = runs(hashes, words.first, width)
                if not len(at):
                    continue
                _, second = runs(hashes, words.first, width, BASES[2])
                bucket, keys = bucket_of(second, buckets), keys >> np.uint64(8)
                docs = doc_table(batch, piece.first, piece.n)
                rows = rows_of(words.first, at)
                places = at - words.first[rows]
                order = np.lexsort((keys, bucket))
                keys, bucket, rows, places = keys[order], bucket[order], rows[order], places[order]
                own = docs[0][rows]
                lost = own > grouped_minimum(own, keys, bucket)
                decided = starts_rows(docs, rows[lost], places[lost])
                kept = ~lost
                keys, bucket, rows, places = keys[kept], bucket[kept], rows[kept], places[kept]
                table = planes(docs.ravel())
                out = [(b, table, squeeze(keys[i:j]), planes(rows[i:j].astype(np.uint32)), planes(places[i:j].astype(np.uint32)))
                       for b, i, j in cut(bucket)]
                out += [(t % buckets, d, None, r, p) for t, d, r, p in decided]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in out], pa.int32()), *[pa.array([r[k] for r in out], pa.binary()) for k in range(1, 5)]],
                    ["bucket", "docs", "keys", "rows", "places"])
    return send


def decide(table: pa.Table) -> pa.Table:
    """One hash range: the starts of all windows that a smaller id has too."""
    docs, keys, rows, places, out, base = [], [], [], [], [], 0
    for r in table.to_pylist():
        own = unplanes(r["docs"], np.int64).reshape(3, -1)
        if r["keys"] is None:
            out.append((int(own[2, 0]), r["docs"], r["rows"], r["places"]))
            continue
        docs.append(own)
        keys.append(unsqueeze(r["keys"]))
        rows.append(unplanes(r["rows"], np.uint32).astype(np.int64) + base)
        places.append(unplanes(r["places"], np.uint32))
        base += own.shape[1]
    if docs:
        docs, keys, rows, places = np.concatenate(docs, axis=1), np.concatenate(keys), np.concatenate(rows), np.concatenate(places)
        order = np.argsort(keys, kind="stable")
        keys, rows, places = keys[order], rows[order], places[order]
        own = docs[0][rows]
        lost = own > grouped_minimum(own, keys)
        out += starts_rows(docs, rows[lost], places[lost])
    return pa.table([pa.array([r[0] for r in out], pa.int32()), *[pa.array([r[k] for r in out], pa.binary()) for k in (1, 2, 3)]],
                    names=["target", "docs", "rows", "places"])


def collected(table: pa.Table) -> dict[tuple[int, int], np.ndarray]:
    """Starts of each (id, h) from rows of ``STARTS``."""
    parts: dict[tuple[int, int], list[np.ndarray]] = {}
    for r in table.to_pylist():
        docs = unplanes(r["docs"], np.int64).reshape(3, -1)
        rows, places = unplanes(r["rows"], np.uint32), unplanes(r["places"], np.uint32)
        for row, a, b in cut(rows):
            parts.setdefault((int(docs[0, row]), int(docs[1, row])), []).append(places[a:b])
    return {k: np.unique(np.concatenate(v)).astype(np.int64) for k, v in parts.items()}


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of the items inside a window."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + width, n), -1)
    return np.cumsum(steps[:-1]) > 0


def _words_left(text: bytes, starts: np.ndarray | None, width: int) -> tuple[bytes, int, int]:
    words = text.split()
    if starts is None:
        return b" ".join(words), len(words), 0
    gone = covered(starts, width, len(words))
    return b" ".join([w for w, g in zip(words, gone.tolist()) if not g]), len(words), int(gone.sum())


def remove_repeats(docs: DataFrame, *, width: int = 50, id_column: str = "doc_id", text_column: str = "text",
                   bytes_per_bucket: int = BYTES_PER_BUCKET) -> DataFrame:
    """``docs`` with the words kept (joined by one space) as text, and ``n_words`` and ``n_removed``; a name that is taken gets ``_`` behind it."""
    buckets = bucket_count(docs, text_column, bytes_per_bucket)
    rows = documents(docs, id_column, text_column, buckets).where("id is not null")
    with tidy(docs.sparkSession):
        starts = staged(rows.mapInArrow(_sender(width, buckets), SENT).groupBy("bucket").applyInArrow(decide, STARTS), "starts")
    return apply_starts(docs, starts, lambda text, s: _words_left(text, s, width), buckets, id_column=id_column,
                        text_column=text_column, extra=(unused(docs, "n_words"), unused(docs, "n_removed")))


def apply_starts(docs: DataFrame, starts: DataFrame, rule, targets: int, *, id_column: str, text_column: str,
                 extra: tuple[str, ...]) -> DataFrame:
    """Bring the decided starts to their texts: ``rule(text, starts or None)`` gives the new text and the figures ``extra``."""
    mark, target = unused(docs, "h"), unused(docs, "target")
    rows = (docs.withColumn(mark, text_mark(ident(docs, text_column)))
            .withColumn(target, target_of(ident(docs, id_column).cast("long"), targets).cast("int")))
    names = docs.columns
    schema = StructType([*docs.schema.fields, *[StructField(n, LongType()) for n in extra]])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        found = collected(right)
        texts, figures = [], []
        ids, marks = left.column(id_column).to_pylist(), left.column(mark).to_pylist()
        for key, text in zip(zip(ids, marks), left.column(text_column).cast(pa.large_binary()).to_pylist()):
            new, *counts = rule(text or b"", found.get(key))
            texts.append(None if text is None else new)
            figures.append(counts)
        out = [pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(left.schema.field(n).type) if n == text_column
               else left.column(n) for n in names]
        out += [pa.array([f[k] for f in figures], pa.int64()) for k in range(len(extra))]
        return pa.table(out, names=[*names, *extra])

    return rows.groupBy(target).cogroup(starts.groupBy("target")).applyInArrow(finish, schema)
