"""N-gram Jaccard join: groups of documents whose sets of word n-grams are alike, exactly.

A document's set holds the hashes of its distinct runs of ``n`` words (A-Z lower-cased; a shorter text is one run).
Documents with the same set are one node. Two sets of sizes a <= b with similarity t or more differ in at most
(1 - t) / (1 + t) * (a + b) members, so if a hash deals the members into more parts than that, some part is equal. Every node
sends a hash of each part to the range of that hash; nodes that meet there, are near enough in size and in a histogram of
their members, and are not joined yet, get an edge. That leaves small groups outside which no link can exist.
Within a group the links are found by T-occurrence search (``toccurrence``) on the whole sets.

Part sizes follow size classes, and parts that are empty in both sets prove nothing: there are ``spare`` more parts
than the difference can touch, and the rare set with more empty parts than that sends its empty parts too.

Groups of copies are one node. A group of near copies with a third of all documents is cut into blocks of bounded size that
each find their own links; one document of the group's largest component then searches the other blocks, and after it the documents that
are still outside.

Null and empty texts have no set, and are linked with nothing. Rows with a null id take no part (null component). Rows
with one id and different texts are documents of their own. Repeated rows are copies. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leeward.llm.blobs import bucket_count, cut, planes, squeeze, unplanes, unsqueeze
from leeward.llm.graph import components
from leeward.llm.repeats import bucket_of, spread
from leeward.llm.shared import ident, staged, tidy, unused
from leeward.llm.toccurrence import Forest, Index, link_all
from leeward.llm.words import mix, pieces, rows_of, runs

SENT = "bucket int, nodes binary, sizes binary, cells binary, keys binary, rows binary, ids binary, marks binary"
MET = "a long, b long, id long, h long, n long, node long"
CELLS = 64                       # cells of a set's histogram; a larger set has more, about one for 16 members
BYTES_PER_BUCKET = 48 << 20      # bytes of text per range at similarity 0.9; a lower one has more parts and smaller ranges
BLOCK_MEMBERS = 1 << 20          # members of all sets of one block
_SALT = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Classes:
    """Size classes and part counts for similarity ``num / den``."""

    num: int
    den: int

    def bounds(self, largest: int) -> np.ndarray:
        """First size of each class; a class's sizes span a factor of den / num at most."""
        out = [1]
        while out[-1] <= largest:
            out.append(out[-1] * self.den // self.num + 1)
        return np.array(out, np.int64)

    def parts(self, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts and spare parts for pairs whose smaller set lies in each class (one more class at the end)."""
        longest = np.append(bounds[1:] - 1, bounds[-1] * self.den // self.num)
        differ = (self.den - self.num) * (longest + longest * self.den // self.num) // (self.den + self.num)
        spare = np.zeros(len(bounds), np.int64)
        for _ in range(3):
            parts = differ + 1 + spare
            empty = np.where(parts > 1, parts * np.exp(-bounds / parts), 0)
            spare = np.where(parts > 1, np.ceil(empty + 4 * np.sqrt(empty)), 0).astype(np.int64)
        return differ + 1 + spare, spare


def ngram_sets(piece, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-grams of each text, ordered by row and hash."""
    words = piece.words(lower=True)
    hashes = words.hashes()
    at, keys = runs(hashes, words.first, n)
    rows = rows_of(words.first, at)
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        whole = [mix(np.sum(hashes[words.first[r]:words.first[r + 1]] * np.arange(3, 3 + 2 * words.counts[r], 2, dtype=np.uint64),
                            dtype=np.uint64, keepdims=True) + np.uint64(words.counts[r]))[0] for r in short]
        rows, keys = np.append(rows, short), np.append(keys, np.array(whole, np.uint64))
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    return rows[new], keys[new]


def cell_counts(sizes: np.ndarray) -> np.ndarray:
    """Cells of each set's histogram: a power of two, so that a finer one folds into a coarser one."""
    return np.maximum(CELLS, 1 << np.ceil(np.log2(np.maximum(sizes, 1) / 16)).clip(0).astype(np.int64))


def _summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def part_hashes(rows: np.ndarray, keys: np.ndarray, sizes: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the parts of each set, as the smaller and as the larger of a pair."""
    bounds = classes.bounds(int(sizes.max()))
    parts, spare = classes.parts(bounds)
    own = np.searchsorted(bounds, sizes, side="right") - 1
    out_rows, out_keys = [], []
    for step in (0, 1):
        kind = own - step
        use = kind >= 0
        count = np.where(use, parts[np.maximum(kind, 0)], 0)
        member = use[rows]
        r, k = rows[member], keys[member]
        part = ((mix(k ^ _SALT) >> np.uint64(32)) * count[r].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        base = np.concatenate([[0], np.cumsum(count)])
        place = base[r] + part
        order = np.argsort(place, kind="stable")
        place, k = place[order], k[order]
        first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1]) if len(place) else np.empty(0, np.int64)
        sums = _summed(mix(k + _SALT), np.append(first, len(place)))
        place = place[first]
        full = np.bincount(rows_of(base, place), minlength=len(sizes)) if len(place) else np.zeros(len(sizes), np.int64)
        odd = np.flatnonzero(use & (count - full > spare[np.maximum(kind, 0)]))
        if len(odd):
            empties = [np.setdiff1d(np.arange(base[x], base[x + 1]), place, assume_unique=True) for x in odd]
            place = np.concatenate([place, *empties])
            sums = np.concatenate([sums, np.zeros(sum(map(len, empties)), np.uint64)])
        row = rows_of(base, place)
        salt = ((kind[row] + 1).astype(np.uint64) << np.uint64(40)) + (place - base[row]).astype(np.uint64)
        out_rows.append(row)
        out_keys.append(mix(sums + mix(salt)))
    return np.concatenate(out_rows), np.concatenate(out_keys)


def _sender(n: int, classes: Classes, buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column("id").to_numpy(), batch.column("h").to_numpy()
            for piece in pieces(batch.column("text")):
                rows, keys = ngram_sets(piece, n)
                first = np.searchsorted(rows, np.arange(piece.n + 1))
                sizes = np.diff(first)
                nodes = mix(_summed(mix(keys), first) + sizes.astype(np.uint64))
                nodes[sizes == 0] = 0
                out = [(piece.first % buckets, nodes.tobytes(), planes(sizes.astype(np.uint32)), None, None, None,
                        ids[piece.first:piece.first + piece.n].tobytes(), marks[piece.first:piece.first + piece.n].tobytes())]
                chosen = np.unique(nodes, return_index=True)[1]
                chosen = np.sort(chosen[sizes[chosen] > 0])
                if len(chosen):
                    slot = np.full(piece.n, -1)
                    slot[chosen] = np.arange(len(chosen))
                    kept = slot[rows] >= 0
                    r, k, s = slot[rows[kept]], keys[kept], sizes[chosen]
                    wide = cell_counts(s)
                    at = np.concatenate([[0], np.cumsum(wide)])
                    cells = np.bincount(at[r] + (k & (wide[r] - 1).astype(np.uint64)).astype(np.int64), minlength=at[-1])
                    cells = np.minimum(cells, 255).astype(np.uint8)      # at a mean of 16 no cell gets near 255
                    row, sent = part_hashes(r, k, s, classes)
                    bucket = bucket_of(mix(sent ^ _SALT), buckets)
                    order = np.lexsort((sent, bucket))
                    row, sent, bucket = row[order], sent[order] >> np.uint64(8), bucket[order]
                    for b, i, j in cut(bucket):
                        used, local = np.unique(row[i:j], return_inverse=True)
                        out.append((b, nodes[chosen[used]].tobytes(), planes(s[used].astype(np.uint32)),
                                    cells[spread(at[used], wide[used])].tobytes(),
                                    squeeze(sent[i:j]), planes(local.astype(np.uint32)), None, None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in out], pa.int32()), *[pa.array([x[c] for x in out], pa.binary()) for c in range(1, 8)]],
                    ["bucket", "nodes", "sizes", "cells", "keys", "rows", "ids", "marks"])
    return send


class Shapes:
    """Sizes and histograms of sets, the histograms in one array per number of cells."""

    def __init__(self, sizes: np.ndarray, cells: list[np.ndarray]):
        self.sizes = sizes
        self.wide = np.array([len(c) for c in cells], np.int64)
        self.place = np.zeros(len(cells), np.int64)
        self.tables = {}
        for w in np.unique(self.wide).tolist():
            own = np.flatnonzero(self.wide == w)
            self.place[own] = np.arange(len(own))
            self.tables[w] = np.stack([cells[i] for i in own])

    def folded(self, sets: np.ndarray, wide: int) -> np.ndarray:
        """Histograms of ``sets``, which have ``wide`` cells or more, with ``wide`` cells."""
        out = np.empty((len(sets), wide), np.int32)
        for w in np.unique(self.wide[sets]).tolist():
            own = self.wide[sets] == w
            out[own] = self.tables[w][self.place[sets[own]]].reshape(-1, w // wide, wide).sum(axis=1, dtype=np.int32)
        return out

    def least_differences(self, one: int, others: np.ndarray) -> np.ndarray:
        """What ``one`` and each of ``others`` differ in at least, from their histograms."""
        out = np.empty(len(others), np.int64)
        common = np.minimum(self.wide[one], self.wide[others])
        for w in np.unique(common).tolist():
            own = common == w
            out[own] = np.abs(self.folded(others[own], w) - self.folded(np.array([one]), w)).sum(axis=1)
        return out

    def near(self, one: int, others: np.ndarray, classes: Classes) -> np.ndarray:
        """Which of ``others`` may be alike to ``one``, by size and by the least difference that the histograms allow."""
        a, b = self.sizes[one], self.sizes[others]
        near = classes.num * np.maximum(a, b) <= classes.den * np.minimum(a, b)
        far = self.least_differences(one, others[near])
        near[near] = (classes.den + classes.num) * far <= (classes.den - classes.num) * (a + b[near])
        return near

    def middle(self, sets: np.ndarray) -> int:
        """The one of ``sets`` whose histogram is closest to their mean, which most near copies of one text lie around."""
        whole = self.folded(sets, int(self.wide[sets].min()))
        return int(sets[np.abs(whole - whole.mean(axis=0)).sum(axis=1).argmin()])


def _meeter(classes: Classes):
    def meet(table: pa.Table) -> pa.Table:
        nodes, sizes, cells, keys, rows, base, told = [], [], [], [], [], 0, []
        for r in table.to_pylist():
            if r["keys"] is None:
                told.append((np.frombuffer(r["ids"], np.int64), np.frombuffer(r["marks"], np.int64),
                             unplanes(r["sizes"], np.uint32).astype(np.int64), np.frombuffer(r["nodes"], np.int64)))
                continue
            nodes.append(np.frombuffer(r["nodes"], np.uint64))
            sizes.append(unplanes(r["sizes"], np.uint32).astype(np.int64))
            cells += np.split(np.frombuffer(r["cells"], np.uint8), np.cumsum(cell_counts(sizes[-1]))[:-1])
            keys.append(unsqueeze(r["keys"]))
            rows.append(unplanes(r["rows"], np.uint32) + np.uint32(base))
            base += len(nodes[-1])
        del table
        a, b = [], []
        if nodes:
            names, pick, same = np.unique(np.concatenate(nodes), return_index=True, return_inverse=True)
            sizes, cells = np.concatenate(sizes)[pick], [cells[i] for i in pick]
            keys, rows = np.concatenate(keys), same.astype(np.uint32)[np.concatenate(rows)]
            order = np.argsort(keys, kind="stable")
            keys, rows = keys[order], rows[order]
            twice = keys[1:] == keys[:-1]                       # most part hashes occur once and go here
            again = np.append(twice, False) | np.insert(twice, 0, False)
            keys, rows = keys[again], rows[again].astype(np.int64)
            order = np.lexsort((rows, keys))
            keys, rows = keys[order], rows[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
            keys, rows = keys[new], rows[new]
            first = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]).astype(np.int64)
            forest, shapes = Forest(len(names)), Shapes(sizes, cells)
            many = np.flatnonzero(np.diff(first) > 1)
            for x in many.tolist():
                group = rows[first[x]:first[x + 1]]
                _gather(group, forest, shapes, classes)
            root = np.array([forest.find(i) for i in range(len(names))])
            child = np.flatnonzero(root != np.arange(len(names)))
            a, b = names[child].view(np.int64), names[root[child]].view(np.int64)
        edges = len(a)
        info = [np.concatenate([t[c] for t in told]) if told else np.empty(0, np.int64) for c in range(4)]
        none = pa.nulls(edges, pa.int64())
        columns = [pa.concat_arrays([pa.array(a, pa.int64()), pa.nulls(len(info[0]), pa.int64())]),
                   pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(info[0]), pa.int64())]),
                   *[pa.concat_arrays([none, pa.array(c, pa.int64())]) for c in info]]
        return pa.table(columns, names=["a", "b", "id", "h", "n", "node"])
    return meet


def _gather(group: np.ndarray, forest: Forest, shapes: Shapes, classes: Classes) -> None:
    """Join the sets of one part hash that may be alike; a set in no one's reach is held against all others."""
    if len({forest.find(i) for i in group.tolist()}) == 1:
        return
    hub = shapes.middle(group)
    for i in group[shapes.near(hub, group, classes)].tolist():
        forest.join(hub, i)
    own = np.array([forest.find(i) for i in group.tolist()])
    roots, place, counts = np.unique(own, return_inverse=True, return_counts=True)
    largest = counts.argmax()
    for i in group[place != largest].tolist():
        for j in group[shapes.near(i, group, classes)].tolist():
            forest.join(i, j)


def _searcher(n: int, classes: Classes):
    """Links within one block; rows with ``asks`` are documents of other blocks that only search this one."""
    def search(table: pa.Table) -> pa.Table:
        names, asks = table.column("node").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False)
        sets: list[np.ndarray] = []
        for piece in pieces(table.column("text")):
            rows, keys = ngram_sets(piece, n)
            first = np.searchsorted(rows, np.arange(piece.n + 1))
            sets += [keys[first[i]:first[i + 1]] for i in range(piece.n)]
        stay = np.flatnonzero(~asks)
        links = []
        if not asks.any():
            if len(stay) > 1:
                links = link_all(sets, classes.num, classes.den)
        elif len(stay):
            index = Index([sets[i] for i in stay])
            forest = Forest(len(sets))
            for i in np.flatnonzero(asks).tolist():
                for j in index.search(sets[i], classes.num, classes.den):
                    if forest.join(i, int(stay[j])):
                        links.append((i, int(stay[j])))
        return pa.table([pa.array([names[i] for i, _ in links], pa.int64()), pa.array([names[j] for _, j in links], pa.int64())],
                        names=["a", "b"])
    return search


def groups(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id", text_column: str = "text",
           bytes_per_bucket: int | None = None, block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """(id, h, n_shingles, component_id) per row of ``docs``: the smallest id that links lead to; similarity is num / den or more."""
    classes = Classes(num, den)
    buckets = bucket_count(docs, text_column, bytes_per_bucket or BYTES_PER_BUCKET * den // (10 * max(1, den - num)))
    text = F.coalesce(ident(docs, text_column), F.lit(""))
    rows = docs.select(ident(docs, id_column).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    known = rows.where("id is not null")
    with tidy(docs.sparkSession):
        met = staged(known.mapInArrow(_sender(n, classes, buckets), SENT).groupBy("bucket").applyInArrow(_meeter(classes), MET), "met")
    info = met.where("node is not null").select("id", "h", "n", "node")
    reach = components(met.where("a is not null").select("a", "b"))
    first = info.where("n > 0").groupBy("node").agg(F.min(F.struct("id", "h")).alias("one"), F.max("n").alias("n"))
    members = (reach.join(first, "node").select("node", "root", F.col("one.id").alias("id"), F.col("one.h").alias("h"), "n"))
    blocks = (members.groupBy("root").agg(F.sum("n").alias("total"))
              .select("root", F.ceil(F.col("total") / block_members).cast("int").alias("blocks")))
    members = (members.join(blocks, "root")
               .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("n"))
    with tidy(docs.sparkSession):
        near = staged(_once(known, ["id", "h"]).join(members, ["id", "h"]).select("root", "block", "blocks", "node", "text"), "near")
    found = staged(near.withColumn("asks", F.lit(False)).groupBy("root", "block")
                   .applyInArrow(_searcher(n, classes), "a long, b long"), "links")
    wide = near.where("blocks > 1")
    if wide.limit(1).count():
        found = _across(wide, found, n, classes)
    joined = components(found)
    smallest = (joined.join(first, "node").groupBy("root").agg(F.min("one.id").alias("component_id")))
    of_node = joined.join(smallest, "root").select("node", "component_id")
    labels = (first.select("node", F.col("one.id").alias("least")).join(of_node, "node", "left")
              .select("node", F.coalesce("component_id", "least").alias("component_id")))
    told = info.distinct().join(labels, "node", "left").select(
        F.col("id").alias("i"), F.col("h").alias("g"), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"))
    return (rows.select("id", "h").join(told, (F.col("id") == F.col("i")) & (F.col("h") == F.col("g")), "left")
            .select("id", "h", F.coalesce("n_shingles", F.lit(0)).alias("n_shingles"), "component_id"))


def _once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One of the rows that agree in ``keys``; all but one per task are dropped before the shuffle."""
    place = unused(rows, "place")
    order = Window.partitionBy(*[ident(rows, k) for k in keys]).orderBy(F.lit(0))
    return rows.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)


def _across(wide: DataFrame, found: DataFrame, n: int, classes: Classes) -> DataFrame:
    """All links of groups in several blocks, from those within blocks.

    First one document of each group's largest component searches the other blocks, which joins their components where the group is one
    of near copies. Then the documents outside the largest component that is left search them.
    """
    own = wide.select("root", "block", "blocks", "node")
    for one in (True, False):
        label = components(found).withColumnRenamed("root", "label")
        labelled = own.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        counts = labelled.groupBy("root", "label").count()
        largest = counts.groupBy("root").agg(F.max(F.struct("count", "label")).alias("m")).select("root", F.col("m.label").alias("most"))
        asking = labelled.join(largest, "root").where("node = most" if one else "label != most").select("node")
        sent = (wide.join(asking, "node").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                .where("to != block").select("root", F.col("to").alias("block"), "node", "text", F.lit(True).alias("asks")))
        here = wide.select("root", "block", "node", "text", F.lit(False).alias("asks"))
        found = found.union(staged(here.union(sent).groupBy("root", "block").applyInArrow(_searcher(n, classes), "a long, b long"), "across"))
    return found


def keep_one(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id. Rows with a null id and without a set stay."""
    grouped = groups(docs, id_column=id_column, text_column=text_column, **settings)
    id_, mark = unused(docs, "i"), unused(docs, "h")
    lost = staged(grouped.where("n_shingles > 0 and id is not null and id != component_id").select(
        F.col("id").alias(id_), F.col("h").alias(mark)).distinct(), "near-copies")
    text_id = ident(docs, id_column)
    rows = docs.withColumn(mark, F.xxhash64(F.coalesce(ident(docs, text_column), F.lit(""))))
    single = _once(rows.where(text_id.isNotNull()), [id_column, mark])
    left = single.join(lost, (ident(single, id_column).cast("long") == F.col(id_)) & (single[mark] == lost[mark]), "left_anti")
    return left.drop(mark).union(docs.where(text_id.isNull()))
