"""Benchmark decontamination: rare n-grams join passages to test items, Smith-Waterman alignment scores them.

Seeds are pairs of neighbouring words of an item, which a document may hold with one word between
them. An alignment of score s (of the highest possible, 1) leaves u words within it unmatched, t
outside it and i words put in, where 3u + 2t + i is at most B = 2(1-s) times the item's words; so it
loses at most 2u + t + i/2, hence 2B/3, of the item's pairs (one put-in word loses none). Each item
chooses its rarest pairs (by their words' counts over the test set and not over the corpus, where
the most leaked items would count as frequent), as many as make every such alignment hold some, and stretches of
documents that hold as many of them as the bound demands are aligned with the item. No alignment of
at least half the highest score is lost. Items of fewer than N words are found only as a whole, those of one word
by that word.

A test set of up to CHUNK_WORDS words is broadcast and looked up in the scan of the documents; a larger
one is joined: pairs of documents meet the chosen pairs in a shuffled equi-join, the stretches found go back
to their texts, and passages meet their items in another join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.llm import store
from parcelflow.llm.words import Words, mix, slices, text_of

N = 5
#: Words of test items that are broadcast at most; a larger test set is joined.
CHUNK_WORDS = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5
#: Distances at which a document's words count as neighbours.
REACH = (1, 2)
_FOUND = "doc_id long, item_id long, score double, first_word long, last_word long"
#: Pairs that are aligned side by side, and words of passages in them, at most (one pair at least).
_LANES, _CELLS = 256, 1 << 20
_FILTER = 1 << 24


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number of two words in order."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) ^ mix(b))


def doc_pairs(h: np.ndarray, at: np.ndarray, alone: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first word, number) of a slice's pairs, by distance; alone: also of single words, as pairs with themselves."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for d in (*REACH, *[0] * alone):
        first = np.flatnonzero(doc[: len(doc) - d] == doc[d:])
        yield first, pair(h[first], h[first + d])


def bounds(size: np.ndarray, n: int, min_score: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For items of these many words: least score, pairs to choose, pairs that a stretch must hold, words of an alignment at most."""
    least = np.where(size < n, 1.0, min_score)
    spare = 2 * (1 - least) * size
    pairs = np.maximum(size - 1, 1)
    sure = np.maximum(pairs - np.floor(2 * spare / 3 + 1e-9), 1).astype(np.int64)
    need = np.clip(sure // 4, 1, None)
    return least, pairs - sure + need, need, np.floor(size + spare + 1e-9).astype(np.int64)


def item_pairs(words: list[np.ndarray]) -> list[np.ndarray]:
    return [pair(w[:-1], w[1:]) if len(w) > 1 else pair(w, w) for w in words]


def _rarity(words: list[np.ndarray]) -> np.ndarray:
    """For each pair of each item how often its two words would meet by chance: the product of their counts over the items."""
    flat = np.concatenate([*words, np.zeros(0, np.uint64)])
    _, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
    count = times[inverse].astype(float) if len(flat) else np.zeros(0)
    at = np.cumsum([0, *(len(w) for w in words)])
    return np.concatenate([*(count[a : b - 1] * count[a + 1 : b] if b - a > 1 else count[a:b] ** 2 for a, b in zip(at[:-1], at[1:], strict=True)), np.zeros(0)])


def stretches_of(key: np.ndarray, hit: np.ndarray, need: np.ndarray, span: np.ndarray, low: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and past-last word of all stretches that an alignment could lie in.

    Hits are sorted by key (document and item), then place; low and past bound each hit's document.
    Long stretches are pieces of up to 4 spans; each starts a span before the last one ends, so an
    alignment lies in one.
    """
    to = np.arange(len(hit)) + need - 1
    some = np.flatnonzero(to < len(hit))
    some = some[(key[to[some]] == key[some]) & (hit[to[some]] - hit[some] < span[some])]
    k, s = key[some], span[some]
    first, last = np.maximum(hit[to[some]] + 1 - s, low[some]), np.minimum(hit[some] + s, past[some])
    new = np.ones(len(some), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (first[1:] > last[:-1])
    begin = np.flatnonzero(new)
    if len(begin):
        first, last, some, s = np.minimum.reduceat(first, begin), np.maximum.reduceat(last, begin), some[begin], s[begin]
    pieces = np.maximum(-(-(last - first - s) // (3 * s)), 1)
    piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    row, first, last, s = (np.repeat(x, pieces) for x in (some, first, last, s))
    return row, first + 3 * s * piece, np.minimum(first + 3 * s * piece + 4 * s, last)


class Items:
    """A bounded test set: sorted (pair, item) of the pairs that its items choose."""

    def __init__(self, ids: np.ndarray, words: list[np.ndarray], n: int, min_score: float):
        self.ids, self.words = ids, words
        size = np.array([len(w) for w in words], dtype=np.int64)
        self.least, choose, self.need, self.span = bounds(size, n, min_score)
        pairs = item_pairs(words)
        count = np.array([len(p) for p in pairs], dtype=np.int64)
        self.alone = bool((size == 1).any())
        item, flat = np.repeat(np.arange(len(words)), count), np.concatenate([*pairs, np.zeros(0, np.uint64)])
        order = np.lexsort((flat, _rarity(words), item))
        rank = np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
        chosen = order[rank < np.repeat(choose, count)]
        order = chosen[np.lexsort((item[chosen], flat[chosen]))]
        once = np.ones(len(order), dtype=bool)
        once[1:] = (flat[order][1:] != flat[order][:-1]) | (item[order][1:] != item[order][:-1])
        self.seeds, self.item = flat[order][once], item[order][once]
        self._filter = None

    def hits(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, item) of every pair in a slice's words that an item chooses."""
        if self._filter is None:
            self._filter = np.zeros(_FILTER, dtype=bool)
            self._filter[self.seeds & np.uint64(_FILTER - 1)] = True
        out = []
        for first, g in doc_pairs(h, at, self.alone):
            maybe = np.flatnonzero(self._filter[g & np.uint64(_FILTER - 1)])
            lo, hi = np.searchsorted(self.seeds, g[maybe], "left"), np.searchsorted(self.seeds, g[maybe], "right")
            k = hi - lo
            place = np.repeat(lo - (np.cumsum(k) - k), k) + np.arange(k.sum())
            out.append((np.repeat(first[maybe], k), self.item[place]))
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def stretches(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, item, first and past-last word of all stretches that an alignment could lie in."""
        hit, item = self.hits(h, at)
        doc = np.searchsorted(at, hit, side="right") - 1
        key = doc * len(self.words) + item
        order = np.lexsort((hit, key))
        key, hit, item, doc = key[order], hit[order], item[order], doc[order]
        row, first, last = stretches_of(key, hit, self.need[item], self.span[item], at[doc], at[doc + 1])
        return doc[row], item[row], first, last


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of pairs, side by side, and where in the passage each best alignment ends."""
    rows, cols = max(map(len, items)), max(map(len, passages))
    a, b = np.zeros((len(items), rows), np.uint64), np.zeros((len(items), cols), np.uint64)
    in_a, in_b = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    for i, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[i, : len(x)], in_a[i, : len(x)] = x, True
        b[i, : len(y)], in_b[i, : len(y)] = y, True
    above = np.zeros((len(items), cols + 1), dtype=np.int32)
    ramp = np.arange(cols, dtype=np.int32)
    best, end = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    for r in range(rows):
        same = (a[:, r : r + 1] == b) & in_a[:, r : r + 1] & in_b
        h = np.maximum(above[:, :-1] + np.where(same, MATCH, MISMATCH).astype(np.int32), above[:, 1:] + GAP)
        np.maximum(h, 0, out=h)
        h = np.maximum.accumulate(h - GAP * ramp, axis=1) + GAP * ramp  # gaps along the passage
        above[:, 1:] = h
        at = h.argmax(axis=1)
        top = h[np.arange(len(items)), at]
        better = top > best
        best, end = np.where(better, top, best), np.where(better, at, end)
    return best, end


def _lanes(size: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs to be aligned side by side, by the length of their passages."""
    order, k = np.argsort(size, kind="stable"), 0
    while k < len(order):
        some = order[k : k + _LANES]
        some = some[: np.searchsorted(size[some] * np.arange(1, len(some) + 1), _CELLS) + 1]
        k += len(some)
        yield some


def _search(shared, clean: bool = False) -> Callable:
    """Rows of _FOUND; or, clean, the rows (_row) of documents in which nothing is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        size = np.array([len(w) for w in items.words], dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "_row" if clean else "text"):
                w = Words(pc.fill_null(text_of(part) if clean else part.column("text"), "")).lower()
                h = w.hashes()
                doc, item, first, last = items.stretches(h, w.at)
                found = np.zeros(part.num_rows, dtype=bool)
                ids = np.zeros(part.num_rows, np.int64) if clean else np.asarray(part.column("doc_id"))
                for some in _lanes(last - first):
                    best, end = align([items.words[i] for i in item[some]], [h[x:y] for x, y in zip(first[some], last[some], strict=True)])
                    score = best / (MATCH * size[item[some]])
                    ok = score >= items.least[item[some]]
                    some, score, end = some[ok], score[ok], end[ok]
                    found[doc[some]] = True
                    if len(some) and not clean:
                        base = first[some] - w.at[doc[some]]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[doc[some]]), pa.array(items.ids[item[some]]), pa.array(score), pa.array(base), pa.array(base + end)], ["doc_id", "item_id", "score", "first_word", "last_word"])
                if clean:
                    yield part.select(["_row"]).filter(pa.array(~found))

    return run


def _words(texts: pa.Array) -> Words:
    return Words(pc.fill_null(texts, "")).lower()


def _bounded(items: DataFrame, n: int, min_score: float) -> Items:
    """items (item_id, text) of at most CHUNK_WORDS words, on the driver."""
    rows = [(r["item_id"], Words(pa.array([r["text"]])).lower().hashes()) for r in items.toLocalIterator()]
    return Items(np.array([i for i, _ in rows], dtype=np.int64), [w for _, w in rows], n, min_score)


def _item_words(n: int, min_score: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = _words(part.column("text"))
                h, size = w.hashes(), w.lengths()
                least, choose, need, span = bounds(size, n, min_score)
                words = [h[a:b] for a, b in zip(w.at[:-1], w.at[1:], strict=True)]
                cols = [part.column("item"), part.column("item_id"), pa.array(least), pa.array(choose), pa.array(need), pa.array(span), pa.array([x.view(np.int64) for x in words], pa.list_(pa.int64())), pa.array([x.view(np.int64) for x in item_pairs(words)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["item", "item_id", "least", "choose", "need", "span", "words", "pairs"])

    return run


def _doc_pairs(alone: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = _words(part.column("text"))
                node, doc = np.asarray(part.column("node")), w.doc()
                for first, g in doc_pairs(w.hashes(), w.at, alone):
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(node[doc[first]]), pa.array(first - w.at[doc[first]])], ["pair", "node", "place"])

    return run


def _stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (node, item, need, span, hits): rows (node, item, first, past); a document's end is cut when its text is at hand."""
    for batch in batches:
        hits = batch.column("hits")
        k = np.asarray(pc.list_value_length(hits)).astype(np.int64)
        row = np.repeat(np.arange(batch.num_rows), k)
        need, span = (np.asarray(batch.column(c))[row] for c in ("need", "span"))
        at, first, last = stretches_of(row, np.asarray(pc.list_flatten(hits)), need, span, np.zeros(len(row), np.int64), np.full(len(row), 1 << 62))
        keep = pa.array(row[at])
        yield pa.RecordBatch.from_arrays([batch.column("node").take(keep), batch.column("item").take(keep), pa.array(first), pa.array(last)], ["node", "item", "first", "past"])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (node, text, stretches): each stretch's words; bounded pieces, as a stretch is at most 4 spans long."""
    for batch in batches:
        for part in slices(batch, "text"):
            w = _words(part.column("text"))
            h = w.hashes().view(np.int64)
            rows = [(n, s["item"], s["first"], h[w.at[k] + s["first"] : min(w.at[k] + s["past"], w.at[k + 1])]) for k, (n, ss) in enumerate(zip(part.column("node").to_pylist(), part.column("stretches").to_pylist(), strict=True)) for s in ss]
            for a in range(0, len(rows), 1024):
                some = rows[a : a + 1024]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.int64()), pa.array([r[2] for r in some], pa.int64()), pa.array([r[3] for r in some], pa.list_(pa.int64()))], ["node", "item", "first", "passage"])


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = {c: [np.asarray(x.values).view(np.uint64) for x in batch.column(c)] for c in ("passage", "words")}
        first, least, size = np.asarray(batch.column("first")), np.asarray(batch.column("least")), np.array([len(w) for w in lists["words"]])
        span = np.array([len(p) for p in lists["passage"]])
        for some in _lanes(span):
            best, end = align([lists["words"][i] for i in some], [lists["passage"][i] for i in some])
            score = best / (MATCH * size[some])
            ok = score >= least[some]
            at = pa.array(some[ok])
            yield pa.RecordBatch.from_arrays([batch.column("node").take(at), batch.column("item_id").take(at), pa.array(score[ok]), pa.array(first[some[ok]]), pa.array(first[some[ok]] + end[ok])], ["node", "item_id", "score", "first_word", "last_word"])


def _joined(scratch: store.Scratch, docs: DataFrame, items: DataFrame, n: int, min_score: float) -> DataFrame:
    """node, item_id, score, first_word, last_word of docs (node, text) and items (item_id, text), of whatever size, by joins."""
    items = scratch.put(items.withColumn("item", F.monotonically_increasing_id()), "items")
    known = items.mapInArrow(_item_words(n, min_score), "item long, item_id long, least double, choose long, need long, span long, words array<long>, pairs array<long>")
    known = scratch.put(known, "item-words")
    times = known.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).cast("double").alias("times"))
    times = scratch.put(times, "times")
    of = lambda c: times.select(F.col("word").alias(c), F.col("times").alias(f"n{c}"))
    pairs = known.select("item", "choose", "need", "span", "words", F.posexplode("pairs").alias("k", "pair"))
    pairs = pairs.select("item", "choose", "need", "span", "pair", F.get("words", "k").alias("a"), F.coalesce(F.get("words", F.col("k") + 1), F.get("words", "k")).alias("b"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("na") * F.col("nb"), "pair"))
    seeds = scratch.put(pairs.join(of("a"), "a").join(of("b"), "b").withColumn("_r", rank).where("_r <= choose").select("pair", "item", "need", "span").distinct(), "seeds")
    alone = not known.where("size(words) = 1").isEmpty()
    hits = docs.mapInArrow(_doc_pairs(alone), "pair long, node long, place long").join(seeds, "pair")
    hits = hits.groupBy("node", "item").agg(F.max("need").alias("need"), F.max("span").alias("span"), F.sort_array(F.collect_list("place")).alias("hits")).where(F.size("hits") >= F.col("need"))
    found = hits.select("node", "item", "need", "span", "hits").mapInArrow(_stretch, "node long, item long, first long, past long")
    found = scratch.put(found.groupBy("node").agg(F.collect_list(F.struct("item", "first", "past")).alias("stretches")), "stretches")
    cut = docs.join(found, "node").select("node", "text", "stretches").mapInArrow(_passages, "node long, item long, first long, passage array<long>")
    both = cut.join(known.select("item", "item_id", "least", "words"), "item").select("node", "item_id", "least", "first", "passage", "words")
    return both.mapInArrow(_score, "node long, item_id long, score double, first_word long, last_word long")


def _usable(items: DataFrame) -> tuple[DataFrame, int]:
    """Test items with words, and how many words they have."""
    rows = items.where("text is not null").select(store.known_id("item_id").alias("item_id"), "text", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n")).where("n > 0")
    return rows.select("item_id", "text"), rows.agg(F.sum("n")).first()[0] or 0


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, n: int = N, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word of every pair whose alignment reaches min_score.

    score: best local alignment (match 2, mismatch -1, gap -1) over the item's highest possible;
    first_word, last_word: the passage searched and where the best alignment ends. A-Z don't
    differ from a-z. Whole for a min_score of 0.5 and more; below, alignments without a chosen pair
    are lost. Defined cases: null texts are empty; items of fewer than n words are reported
    only where all their words stand in a row; items without words never; rows of one doc_id or
    item_id count as one, with their best score (so do rows of a null one); items of equal score are
    all reported; very long texts are aligned in pieces of four times an alignment's longest stretch; an
    empty table gives no rows; other columns, also of clashing names, are ignored.
    """
    store.ship(spark)
    items, size = _usable(items)
    if size <= CHUNK_WORDS:
        found = docs.select(store.known_id().alias("doc_id"), "text").mapInArrow(_search(spark.sparkContext.broadcast(_bounded(items, n, min_score))), _FOUND)
    else:
        scratch = store.Scratch(spark, "decontamination")
        rows = scratch.put(docs.select(store.known_id().alias("doc_id"), "text").withColumn("node", F.monotonically_increasing_id()), "rows")
        found = rows.select("doc_id", "node").join(_joined(scratch, rows.select("node", "text"), items, n, min_score), "node")
    best = F.max(F.struct("score", (-F.col("first_word")).alias("a"), "last_word")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select(store.given_id().alias("doc_id"), store.given_id("item_id").alias("item_id"), F.col("m.score").alias("score"), (-F.col("m.a")).alias("first_word"), F.col("m.last_word").alias("last_word"))


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame, n: int = N, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs, all columns, in which no item reaches min_score; cases as in contaminated()."""
    store.ship(spark)
    items, size = _usable(items)
    if size <= CHUNK_WORDS:
        kind = docs.select(F.struct("*").alias("_row")).schema
        return store.packed(docs).mapInArrow(_search(spark.sparkContext.broadcast(_bounded(items, n, min_score)), True), kind).select("_row.*")
    scratch = store.Scratch(spark, "decontamination")
    rows = scratch.put(store.packed(docs, F.monotonically_increasing_id().alias("node")), "rows")
    found = _joined(scratch, rows.select("node", F.col("_row.text").alias("text")), items, n, min_score)
    return rows.join(scratch.put(found.select("node").distinct(), "found"), "node", "left_anti").select("_row.*")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, store.table(spark, sf_dir, "documents"), store.table(spark, sf_dir, "benchmark"))
