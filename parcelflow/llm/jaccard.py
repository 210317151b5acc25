"""Exact n-gram Jaccard join of documents by count-vector R-trees.

A document is its set of distinct word n-grams. Equal sets are one node. A node is routed by
its prefix: of its n-gram numbers in ascending order the first size - need + 1, where need is
the least overlap with any partner; two linked nodes share one of these. Rare n-grams have
small numbers: all n-grams of the corpus are counted in COUNTERS hashed counters first, whose
logarithms lead the numbers (any order that holds for all documents is right). A pair counts in
the group of the first key it shares, so what precedes a key in either set is not in the other,
and the places of keys bound the overlap as well. A row of a key that no partner of a fitting size shares goes no
further. Of the nodes that share such a key, the numbers of n-grams in GROUPS hash groups are points of an R-tree; the
overlap of a node with a subtree, or another node, is at most the sum of the coordinates'
minima. Pairs that this bound leaves are held against lowest bits of finer counts (two sets
differ in at least as many n-grams as those do) before they leave the task, then against finer
counts still, and what is left is verified on the sets themselves.

Groups aren't joined pair by pair: a node that no earlier pivot reaches becomes a pivot, and
pivots are paired with all they reach. A pair of a group is untested only if pivots reached both of it. Only if
such nodes of a group lie in different components, a second round pairs these, with rows that carry the
finer counts: first no more pairs than would join all components that the counts leave, then, with
the components that come of those, all that remain.

Pivots find components, not all links. Links are counted afterwards: the sets of a component
are dealt into blocks, and the overlaps of all sets of two blocks are taken at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.llm import store
from parcelflow.llm.components import connected
from parcelflow.llm.sums import SUMS, emit, summed
from parcelflow.llm.words import Words, shingles, slices

GROUPS = 32
COUNTERS = 1 << 18
#: Groups of up to SMALL nodes are handled side by side, larger ones by an R-tree each.
SMALL = 32
#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_FULL = (1 << 16) - 1
LEAF, FAN = 32, 16
#: Finer counts are of FINE groups: a byte each for sets of LONG n-grams or more, else the lowest bit.
LONG, FINE = 2048, 2048
#: Rows of groups carry lowest bits of fewer counts: of LITTLE groups at least.
LITTLE = 64
#: Sets, and n-grams in them, that a block holds on average at most.
BLOCK, BLOCK_GRAMS, COLUMNS = 256, 1 << 20, 4096
_BASE = "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>, point binary, bits binary, fine binary"


def _grams(part: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    w = Words(pc.fill_null(part.column("text"), "")).lower()
    return shingles(w.hashes(), w.at, n)


def _sets(part: pa.RecordBatch, n: int, rank: np.ndarray) -> Iterator[np.ndarray]:
    """Each text's distinct n-gram numbers, ascending: a byte of the n-gram's counter, and 56 bits of its hash."""
    grams, bounds = _grams(part, n)
    lead = rank[grams & np.uint64(COUNTERS - 1)].astype(np.uint64)
    grams = (lead << np.uint64(56)) | (grams & np.uint64((1 << 56) - 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield np.unique(grams[a:b])


def _count(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount((_grams(part, n)[0] & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        yield from emit([total], "<i4")  # of one task

    return run


def ranks(text: DataFrame, n: int) -> np.ndarray:
    """For each counter a byte that grows with what it counts beyond the mean of all.

    Most n-grams are rare and fill all counters alike, so that these vary by the mean's square
    root; one of some times that many occurrences stands out.
    """
    total = summed(text.select("text").mapInArrow(_count(n), SUMS), "<i4")
    if total is None:
        return np.zeros(COUNTERS, np.uint8)
    beyond = np.maximum(0.0, total - total.mean()) / max(1.0, math.sqrt(total.mean()))
    return np.minimum(np.rint(8 * np.log2(1 + beyond)), 255).astype(np.uint8)


def _width(size: int, num: int, den: int) -> int:
    """The least number of groups whose lowest bits tell unrelated sets of size from linked ones by four standard deviations."""
    most = 2 * size * (den - num) / (den + num)  # that two linked sets may differ in
    width = LITTLE
    while width < FINE and width / 2 - 2 * math.sqrt(width) < most:
        width *= 2
    return width


def _base(n: int, num: int, den: int, rank: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                size, d1, d2, keys, points, bits, fine = [], [], [], [], [], [], []
                for s in _sets(part, n, rank):
                    digest = xxhash.xxh3_128_digest(s.astype("<u8").tobytes())
                    size.append(len(s))
                    d1.append(int.from_bytes(digest[:8], "little", signed=True))
                    d2.append(int.from_bytes(digest[8:], "little", signed=True))
                    keys.append(s[: len(s) - -(-num * len(s) // den) + 1] if len(s) else s)
                    points.append(np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS).clip(max=_FULL).astype("<u2").view(np.uint8).reshape(GROUPS, 2).T.tobytes())  # high bytes, mostly 0, lie together
                    counts = np.bincount((s & np.uint64(FINE - 1)).astype(np.int64), minlength=FINE)
                    small = counts.reshape(-1, _width(len(s), num, den)).sum(axis=0)
                    bits.append(np.packbits((small & 1).astype(np.uint8)).tobytes())
                    fine.append((counts.clip(max=255).astype(np.uint8) if len(s) >= LONG else np.packbits(counts & 1)).tobytes())
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                flat = np.concatenate(keys).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(points, pa.binary()), pa.array(bits, pa.binary()), pa.array(fine, pa.binary())],
                    ["doc_id", "n_shingles", "d1", "d2", "keys", "point", "bits", "fine"],
                )

    return run


def _set_rows(n: int, rank: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(_sets(part, n, rank))
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["node", "s"])

    return run


class RTree:
    """Bulk-loaded R-tree over points of counts; nodes keep their coordinates' maxima and the range of sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, num: int, den: int):
        self.num, self.den = num, den
        self.order = self._tile(points, sizes)
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        top, low, high = self.points, self.sizes, self.sizes
        step = LEAF
        while True:
            at = np.arange(0, len(top), step)
            top, low, high = np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high))
            if len(at) <= FAN:
                break
            step = FAN

    @staticmethod
    def _tile(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sort-tile-recursive order: slabs by size, tiles by the first half's count, then by the first group's."""
        order = np.argsort(sizes, kind="stable")
        slab = np.empty(len(order), dtype=np.int64)
        slab[order] = np.arange(len(order)) // max(LEAF * 16, 1)
        half = points[:, : points.shape[1] // 2].sum(axis=1, dtype=np.int64)
        order = np.lexsort((half, slab))
        tile = np.empty(len(order), dtype=np.int64)
        tile[order] = np.arange(len(order)) // (LEAF * 4)
        return np.lexsort((points[:, 0], tile, slab))

    def _may(self, q: np.ndarray, n: int, top: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether something of at least low and at most high n-grams, under top, can reach the ratio with q."""
        bound = np.minimum(top, q).sum(axis=1, dtype=np.int64)
        return (self.den * bound >= self.num * (n + low - bound)) & (self.den * n >= self.num * low) & (self.den * high >= self.num * n)

    def search(self, q: np.ndarray, n: int) -> np.ndarray:
        """Indexes of all points that may reach the ratio with q."""
        top, low, high = self.levels[-1]
        at = np.flatnonzero(self._may(q, n, top, low, high))
        for top, low, high in self.levels[-2::-1]:
            at = (at[:, None] * FAN + np.arange(FAN)).ravel()
            at = at[at < len(top)]
            at = at[self._may(q, n, top[at], low[at], high[at])]
        at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = at[at < len(self.points)]
        at = at[self._may(q, n, self.points[at], self.sizes[at], self.sizes[at])]
        return self.order[at]


class Fine:
    """Finer counts of many sets: bytes, or bits of so many groups; bits of more groups are folded to those of fewer."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        rows = column.to_pylist()
        self.kind = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        self.at, self.rows = np.zeros(len(rows), dtype=np.int64), {}
        for k in np.unique(self.kind).tolist():
            own = self.kind == k
            self.at[own] = np.arange(own.sum())
            self.rows[k] = np.frombuffer(b"".join(r for r in rows if len(r) == k), dtype=np.uint8 if k == FINE else np.uint64).reshape(int(own.sum()), -1)

    def apart(self, i: np.ndarray, other: Fine, j: np.ndarray) -> np.ndarray:
        """For rows i and other's rows j: n-grams that are in one set only, at least (0 for bytes and bits).

        A full byte stands for 255 or more, so its difference to another is a lower bound too.
        """
        out = np.zeros(len(i), dtype=np.int64)
        kinds = self.kind[i] * (2 * FINE) + other.kind[j]
        for both in np.unique(kinds).tolist():
            k, m = divmod(both, 2 * FINE)
            if (k == FINE) != (m == FINE):
                continue
            same = np.flatnonzero(kinds == both)
            for at in np.array_split(same, len(same) * max(k, m) // (4 << 20) + 1):
                a, b = self.rows[k][self.at[i[at]]], other.rows[m][other.at[j[at]]]
                if k == FINE:
                    out[at] = (np.maximum(a, b) - np.minimum(a, b)).sum(axis=1, dtype=np.int64)
                else:
                    least = min(a.shape[1], b.shape[1])
                    out[at] = np.bitwise_count(_folded(a, least) ^ _folded(b, least)).sum(axis=1, dtype=np.int64)
        return out


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Lowest bits of counts of groups as those of fewer groups (of width numbers), by halves."""
    while bits.shape[1] > width:
        bits = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]
    return bits


def _near(apart: np.ndarray, both: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets with both n-grams in all can reach the ratio if so many are in one of them only."""
    return den * (both - apart) >= num * (both + apart)


def _reach(size_a: np.ndarray, size_b: np.ndarray, overlap: np.ndarray, num: int, den: int) -> np.ndarray:
    return den * overlap >= num * (size_a + size_b - overlap)


def _large(node: np.ndarray, size: np.ndarray, rest: np.ndarray, point: np.ndarray, part: np.ndarray | None, fine: Fine, at: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of one group; at: the index of its first row in fine."""
    tree = RTree(point, size, num, den)
    a, b = [], []
    reached = np.zeros(len(node), dtype=bool)
    for i in range(len(node)):
        if part is None and reached[i]:
            continue
        got = tree.search(point[i], int(size[i]))
        got = got[_reach(size[i], size[got], np.minimum(rest[i], rest[got]), num, den)]
        if part is not None:
            got = got[part[got] > part[i]]
        got = got[_near(fine.apart(np.full(len(got), at + i), fine, at + got), size[i] + size[got], num, den)]
        reached[got] = True
        a.append(np.full(len(got), node[i]))
        b.append(node[got])
    return np.concatenate(a), np.concatenate(b)


def _forest(a: np.ndarray, b: np.ndarray, part_a: np.ndarray, part_b: np.ndarray) -> np.ndarray:
    """Which of the pairs, taken in their order, join components that no earlier one has joined."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    out = np.zeros(len(a), dtype=bool)
    for k, (x, y) in enumerate(zip(part_a.tolist(), part_b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            out[k] = True
    return out


def _pairs(num: int, den: int, again: str = "") -> Callable:
    """Of rows sorted by (group, node): candidate pairs a (the pivot), b and their group; again: only those of different components, a forest of them or all."""

    def work(key: np.ndarray, t: pa.Table) -> pa.RecordBatch | None:
        node, size = np.asarray(t.column("node")), np.asarray(t.column("n_shingles"))
        rest = size - np.asarray(t.column("pos"))  # n-grams from the key on
        part, fine = np.asarray(t.column("part")) if again else None, Fine(t.column("fine" if again else "bits"))
        point = np.frombuffer(b"".join(t.column("point").to_pylist()), dtype=np.uint8).reshape(-1, 2, GROUPS).astype(np.int64)
        point = point[:, 0] | point[:, 1] << 8
        point[point == _FULL] = 1 << 40  # a full counter bounds nothing
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        count = np.diff(edge)
        out_a, out_b, out_of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            x = np.minimum(np.minimum(point[i], point[j]).sum(axis=1), np.minimum(rest[i], rest[j]))
            return _reach(size[i], size[j], x, num, den)

        if part is None:
            reached = np.zeros(len(key), dtype=bool)
            at, end = edge[:-1][count <= SMALL].copy(), edge[1:][count <= SMALL]
            while len(at):  # at: the next pivot of each group
                first = edge[np.searchsorted(edge, at, side="right") - 1]
                n = end - first
                member = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                pivot = np.repeat(at, n)
                hit = np.flatnonzero((member != pivot) & near(pivot, member))
                hit = hit[_near(fine.apart(pivot[hit], fine, member[hit]), size[pivot[hit]] + size[member[hit]], num, den)]
                out_a.append(node[pivot[hit]])
                out_b.append(node[member[hit]])
                out_of.append(key[pivot[hit]])
                reached[member[hit]] = reached[at] = True
                at = at + 1
                while (skip := (at < end) & reached[np.minimum(at, len(key) - 1)]).any():
                    at = at + skip
                at, end = at[at < end], end[at < end]
        else:
            own = np.repeat(count, count)
            for d in range(1, min(SMALL, len(key))):
                i = np.flatnonzero((key[d:] == key[:-d]) & (own[d:] <= SMALL))
                i = i[part[i] != part[i + d]]
                i = i[near(i, i + d)]
                i = i[_near(fine.apart(i, fine, i + d), size[i] + size[i + d], num, den)]
                out_a.append(node[i])
                out_b.append(node[i + d])
        for k in np.flatnonzero(count > SMALL):
            s = slice(edge[k], edge[k + 1])
            a, b = _large(node[s], size[s], rest[s], point[s], None if part is None else part[s], fine, int(edge[k]), num, den)
            out_a.append(a)
            out_b.append(b)
            out_of.append(np.full(len(a), key[edge[k]]))
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        if not again:
            kept = np.flatnonzero(a != b)
            return pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (a, b, np.concatenate(out_of))], ["a", "b", "group"]) if len(kept) else None
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1)
        if again == "forest" and pair.shape[1]:
            ids, first = np.unique(node, return_index=True)
            of = lambda x: part[first[np.searchsorted(ids, x)]]
            pair = pair[:, _forest(pair[0], pair[1], of(pair[0]), of(pair[1]))]
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"]) if pair.shape[1] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.asarray(batch.column("group"))
            last = int(np.searchsorted(-(key != key[-1]).astype(np.int8), 0)) if key[0] != key[-1] else 0
            if last:  # the rows before belong to groups that are whole
                rest.append(batch.slice(0, last))
                t = pa.Table.from_batches(rest).combine_chunks()
                if (out := work(np.asarray(t.column("group")), t)) is not None:
                    yield out
                rest = []
            rest.append(batch.slice(last))
        if rest:
            t = pa.Table.from_batches(rest).combine_chunks()
            if (out := work(np.asarray(t.column("group")), t)) is not None:
                yield out

    return run


def _digest(s: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(s.astype("<u8").tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _told_sets(n: int, rank: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(_sets(part, n, rank))
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                told = np.array([_digest(s) for s in sets], dtype=np.int64).reshape(-1, 2)
                grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(told[:, 0]), pa.array(told[:, 1]), grams], ["d1", "d2", "s"])

    return run


def _block_links(num: int, den: int) -> Callable:
    """For all sets of two blocks (or of one): how many documents of the other block's sets link to each."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        lists = t.column("s").combine_chunks()
        size = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        owner = np.repeat(np.arange(len(size)), size)
        _, code, times = np.unique(np.asarray(pc.list_flatten(lists)), return_inverse=True, return_counts=True)
        shared = np.flatnonzero(times > 1)  # others are in no overlap
        place = np.full(len(times), -1)
        place[shared] = np.arange(len(shared))
        at = place[code]
        owner, at = owner[at >= 0], at[at >= 0]
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        one = np.asarray(t.column("lo")) == np.asarray(t.column("hi"))
        block = np.asarray(t.column("block"))
        left = np.flatnonzero(block == np.asarray(t.column("lo")))
        right = left if one.all() else np.flatnonzero(block == np.asarray(t.column("hi")))
        overlap = np.zeros((len(left), len(right)), dtype=np.int64)
        for a in range(0, len(shared), COLUMNS):
            x, y = np.searchsorted(at, [a, a + COLUMNS])
            has = np.zeros((len(size), min(COLUMNS, len(shared) - a)), dtype=np.float32)
            has[owner[x:y], at[x:y] - a] = 1
            overlap += (has[left] @ has[right].T).astype(np.int64)
        link = den * overlap >= num * (size[left][:, None] + size[right][None, :] - overlap)
        weight = np.asarray(t.column("weight"))
        if one.all():
            np.fill_diagonal(link, False)
            rows, count = left, link @ weight[right]
        else:
            rows, count = np.concatenate([left, right]), np.concatenate([link @ weight[right], link.T @ weight[left]])
        return pa.table({"d1": t.column("d1").take(pa.array(rows)), "d2": t.column("d2").take(pa.array(rows)), "c": pa.array(count.astype(np.int64))})

    return run


def _counted(scratch: store.Scratch, text: DataFrame, base: DataFrame, sets: DataFrame, parts: DataFrame, n: int, num: int, den: int, rank: np.ndarray) -> DataFrame:
    """e1, e2, n_links of every set: all links of its component, by documents, its own copies among them."""
    weights = base.where("n_shingles > 0").select("d1", "d2", "n_shingles", "doc_id").distinct().groupBy("d1", "d2", "n_shingles").agg(F.count(F.lit(1)).alias("weight"))
    sets = sets.join(weights, ["d1", "d2"]).join(parts.withColumnRenamed("node", "_p"), F.col("node") == F.col("_p"), "left")
    sets = scratch.put(sets.withColumn("root", F.coalesce("root", "node")).drop("_p"), "weights")
    blocks = sets.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("t")).where("m > 1")
    blocks = blocks.select(F.col("root").alias("r"), F.ceil(F.greatest(F.col("m") / BLOCK, F.col("t") / BLOCK_GRAMS)).alias("k"))
    linked = sets.join(blocks, F.col("root") == F.col("r")).select("d1", "d2", "node", "weight", "root", "k", F.pmod(F.xxhash64("d1", "d2"), F.col("k")).alias("block"))
    grams = text.join(linked.select(F.col("node").alias("w")).distinct(), F.col("doc_id") == F.col("w"), "left_semi").mapInArrow(_told_sets(n, rank), "d1 long, d2 long, s array<long>")
    rows = linked.drop("node")
    rows = scratch.put(rows.join(grams.dropDuplicates(["d1", "d2"]), ["d1", "d2"]), "grams")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    rows = rows.select("d1", "d2", "s", "weight", "block", "root", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    found = rows.groupBy("root", "lo", "hi").applyInArrow(_block_links(num, den), "d1 long, d2 long, c long").groupBy("d1", "d2").agg(F.sum("c").alias("c"))
    out = sets.join(found, ["d1", "d2"], "left")
    return scratch.put(out.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), (F.coalesce("c", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "counted")


def join(spark: SparkSession, docs: DataFrame, n: int, num: int, den: int, count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (if count_links) of each row of docs (doc_id, text).

    Two documents link when den * overlap >= num * union of their sets of n-word shingles (of
    lower-cased words; fewer words: all as one). component_id: smallest doc_id reachable;
    n_links: documents that the row's set links to, other than its own; a document of several
    different sets counts once for each of them. Defined cases: a null, empty or
    blank text has an empty set, links with nothing and is its own component; rows of one doc_id
    count as one document; a null doc_id is an id that comes before all others; a very long text is one
    set as any other; an empty table gives no rows; other columns, also of clashing names, are ignored.
    """
    scratch = store.Scratch(spark, "jaccard")
    text = docs.select(store.known_id().alias("doc_id"), "text")
    rank = ranks(text, n)
    base = scratch.put(text.mapInArrow(_base(n, num, den, rank), _BASE), "base")
    sets = base.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("node"))
    sets = scratch.put(sets, "sets")
    on_set = lambda x: (F.col("d1") == F.col(f"{x}1")) & (F.col("d2") == F.col(f"{x}2"))
    named = sets.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), "node")
    own = base.where("n_shingles > 0").join(named, on_set("e")).where("doc_id = node").dropDuplicates(["node", "d1", "d2"])
    nodes = scratch.put(own.select("node", "n_shingles", "keys", "point", "bits"), "nodes")
    fine = scratch.put(own.select("node", "n_shingles", "fine"), "fine")
    base = scratch.put(base.select("doc_id", "n_shingles", "d1", "d2"), "documents")
    scratch.drop("base")
    routed = scratch.put(_met(nodes.select(F.posexplode("keys").alias("pos", "group"), "node", "n_shingles"), num, den), "routed")
    pivoted = scratch.put(_candidates(routed, nodes, num, den), "pivoted")
    first = scratch.put(pivoted.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "first")
    reached = scratch.put(pivoted.select("group", F.col("b").alias("node")).distinct(), "reached")
    scratch.drop("pivoted")
    links = _verified(scratch, text, _refined(first, fine, num, den), n, num, den, rank, "first")
    parts = connected(spark, links.select("a", "b"), scratch)
    for again in ("forest", "all"):
        more = _second(scratch, routed, reached, nodes, fine, parts, num, den, first, again)
        if more.isEmpty():
            break
        first = first.unionByName(more)
        links = links.unionByName(_verified(scratch, text, more, n, num, den, rank, again))
        parts = connected(spark, links.select("a", "b"), scratch)
    member = base.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("d1")).alias("d1"), "d2").join(named.withColumnRenamed("node", "_node"), on_set("e"), "left")
    out = member.drop("e1", "e2").join(parts.withColumnRenamed("node", "_p"), F.col("_node") == F.col("_p"), "left")
    out = out.withColumn("root", F.coalesce("root", "_node", "doc_id"))
    columns = [store.given_id().alias("doc_id"), "n_shingles", store.given_id("root").alias("component_id")]
    if not count_links:
        return out.select(*columns)
    counted = _counted(scratch, text, base, sets, parts, n, num, den, rank)
    return out.join(counted, on_set("e"), "left").select(*columns, F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _met(keys: DataFrame, num: int, den: int) -> DataFrame:
    """Of keys (group, pos, node, n_shingles) the rows that can have a partner in their group, by the next smaller and the next larger size.

    No partner is larger than what the n-grams from the key on, all shared, allow.
    """
    size, line = F.col("n_shingles"), Window.partitionBy("group").orderBy("n_shingles")
    low, high, rest = F.lag("n_shingles").over(line), F.lead("n_shingles").over(line), size - F.col("pos")
    rows = keys.withColumn("_low", low).withColumn("_high", high)
    smaller = den * F.col("_low") >= num * size
    larger = (den * size >= num * F.col("_high")) & _reaches(rest, size + F.col("_high"), num, den)
    return rows.where(F.coalesce(smaller, F.lit(False)) | F.coalesce(larger, F.lit(False))).select("group", "pos", "node", "n_shingles")


def _with(rows: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """rows with columns of their nodes' sets."""
    more = nodes.select(F.col("node").alias("_m"), F.col("n_shingles").alias("_size"), *columns)
    return rows.join(more, (F.col("node") == F.col("_m")) & (F.col("n_shingles") == F.col("_size"))).drop("_m", "_size")


def _candidates(routed: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of a pivot a and a node b that it reaches, with their group."""
    rows = _with(routed, nodes, "point", "bits").select("group", "pos", "node", "n_shingles", "point", "bits").repartition("group").sortWithinPartitions("group", "node")
    return rows.mapInArrow(_pairs(num, den), "a long, b long, group long")


def _second(scratch: store.Scratch, routed: DataFrame, reached: DataFrame, nodes: DataFrame, fine: DataFrame, parts: DataFrame, num: int, den: int, tested: DataFrame, again: str) -> DataFrame:
    """Pairs of different components that pivots of their group have reached both; a forest of them, or all that aren't tested yet."""
    rows = reached.join(parts.select(F.col("node").alias("p"), "root"), F.col("node") == F.col("p"), "left")
    rows = scratch.put(rows.select("group", "node", F.coalesce("root", "node").alias("part")), f"parts-{again}")
    mixed = rows.groupBy("group").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select(F.col("group").alias("g"))
    hidden = scratch.put(rows.join(mixed, F.col("group") == F.col("g"), "left_semi").select(F.col("group").alias("g"), F.col("node").alias("h"), "part"), f"hidden-{again}")
    rows = routed.join(hidden, (F.col("group") == F.col("g")) & (F.col("node") == F.col("h")))
    rows = _with(_with(rows, nodes, "point"), fine, "fine")
    rows = rows.select("group", "pos", "node", "n_shingles", "point", "part", "fine").repartition("group").sortWithinPartitions("group", "node")
    pairs = rows.mapInArrow(_pairs(num, den, again), "a long, b long").distinct()
    more = scratch.put(pairs.join(tested, ["a", "b"], "left_anti"), f"more-{again}")
    scratch.drop(f"parts-{again}")
    scratch.drop(f"hidden-{again}")
    return more


def _fine(num: int, den: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = np.arange(batch.num_rows)
            apart = Fine(batch.column("fa")).apart(i, Fine(batch.column("fb")), i)
            both = np.asarray(batch.column("na")) + np.asarray(batch.column("nb"))
            yield batch.select(["a", "b"]).filter(pa.array(_near(apart, both, num, den)))

    return run


def _refined(pairs: DataFrame, fine: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) without those that the finer counts rule out."""
    side = lambda x: fine.select(F.col("node").alias(f"_{x}"), F.col("n_shingles").alias(f"n{x}"), F.col("fine").alias(f"f{x}"))
    rows = pairs.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b"))
    return rows.select("a", "b", "na", "nb", "fa", "fb").mapInArrow(_fine(num, den), "a long, b long").distinct()


def _verified(scratch: store.Scratch, text: DataFrame, pairs: DataFrame, n: int, num: int, den: int, rank: np.ndarray, name: str) -> DataFrame:
    """Of candidate pairs (a, b) those whose sets reach the ratio."""
    pairs = scratch.put(pairs, f"pairs-{name}")
    wanted = scratch.put(pairs.select(F.explode(F.array("a", "b")).alias("w")).distinct(), f"wanted-{name}")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    sets = scratch.put(text.join(wanted, F.col("doc_id") == F.col("w"), "left_semi").mapInArrow(_set_rows(n, rank), "node long, s array<long>"), f"sets-{name}")
    one = pairs.join(sets.select(F.col("node").alias("na"), F.col("s").alias("sa")), F.col("a") == F.col("na"))
    two = one.select("a", "b", "sa").join(sets.select(F.col("node").alias("nb"), F.col("s").alias("sb")), F.col("b") == F.col("nb"))
    links = scratch.put(two.where(_reaches(F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb"), num, den)).select("a", "b").distinct(), f"links-{name}")
    for x in (f"sets-{name}", f"wanted-{name}", f"pairs-{name}"):
        scratch.drop(x)
    return links


def _reaches(overlap: Column, both: Column, num: int, den: int) -> Column:
    return F.lit(den) * overlap >= F.lit(num) * (both - overlap)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark, store.table(spark, sf_dir, "documents"), 3, 90, 100, count_links=False)


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT o.a, o.b FROM o JOIN n p ON p.doc_id = o.a JOIN n q ON q.doc_id = o.b WHERE 100 * o.c >= 90 * (p.n + q.n - o.c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
