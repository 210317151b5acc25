"""Substring dedup: repeated word sequences across documents, by an FM-index per shard.

1. Every WINDOW-word window has a minimiser, the K-word sequence of the least number in it.
   Equal windows have equal minimisers at different places, so only windows whose minimiser
   occurs twice or more in the corpus can repeat.
2. Runs of such windows with one minimiser are segments; they go to the shard of their
   minimiser's number, so all occurrences of a window meet in one shard. Equal segments are
   sent once a batch and indexed once a shard: later copies are repeats as a whole, so they go
   anywhere, without their words. Segments of minimisers with more than HOT occurrences go window by window, by the window's number.
3. Each shard builds an FM-index over its segments and streams them through it backwards; a
   match of WINDOW words whose earliest place precedes its own is a repeat.
4. The covered words are taken out of the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm import store
from parcelflow.llm.fmindex import FMIndex
from parcelflow.llm.words import _BASE, Words, mix, slices

WINDOW, K = 20, 6
SHARD_WORDS, HOT = 400_000, 10_000
_PLACE = np.uint64((1 << 24) - 1)
_SEGMENTS = "shard int, g1 long, g2 long, doc_id long, tid long, start long, n int, body binary"
_RANGES = "doc_id long, tid long, start long, end long"


def _rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n words from each word on (also across documents)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total, factor = np.zeros(len(h) - n + 1, dtype=np.uint64), 1
    for k in range(n):
        factor = factor * _BASE % (1 << 64)
        total += h[k : k + len(total)] * np.uint64(factor)
    return mix(total)


def _minimisers(h: np.ndarray, at: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and minimiser's place of each window within documents, and the K-word numbers."""
    grams = _rolling(h, k)
    lens = np.maximum(np.diff(at) - window + 1, 0)
    ends = np.concatenate([[0], np.cumsum(lens)])
    starts = np.arange(ends[-1]) + np.repeat(at[:-1] - ends[:-1], lens)
    if not len(starts):
        return starts, starts, grams
    key = (grams & ~_PLACE) | (np.arange(len(grams), dtype=np.uint64) & _PLACE)
    span, size = window - k + 1, 1
    while size * 2 <= span:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < span:
        key = np.minimum(key[: len(key) - (span - size)], key[span - size :])
    place = starts + ((key[starts].astype(np.int64) - starts) & int(_PLACE))
    return starts, place, grams


def _emit_minimisers(window: int, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(pc.fill_null(part.column("text"), ""))
                _, place, grams = _minimisers(w.hashes(), w.at, window, k)
                place = place[np.concatenate([[True], place[1:] != place[:-1]])] if len(place) else place
                doc = np.searchsorted(w.at, place, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(grams[place].view(np.int64)), part.column("doc_id").take(pa.array(doc))], ["h", "doc_id"])

    return run


def _numbers(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers of each stretch of words first..last."""
    out = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        base = (_BASE + 2 * salt) % (1 << 64) | 1
        powers = [np.full(len(h) + 1, np.uint64(b)) for b in (base, pow(base, -1, 1 << 64))]
        for p in powers:
            p[0] = 1
            np.multiply.accumulate(p, out=p)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)) * powers[0][:-1], dtype=np.uint64)])
        out.append(mix((total[last] - total[first]) * powers[1][first] + (last - first).astype(np.uint64) * np.uint64(salt)))
    return out[0], out[1]


def _earliest(g1: np.ndarray, g2: np.ndarray, n: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the index of the earliest row (doc, start) of its group of equal (g1, g2, n), and whether that is strictly before."""
    order = np.lexsort((start, doc, n, g2, g1))
    new = np.concatenate([[True], (g1[order][1:] != g1[order][:-1]) | (g2[order][1:] != g2[order][:-1]) | (n[order][1:] != n[order][:-1])])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    first = np.empty(len(order), dtype=np.int64)
    first[order] = head
    return first, (doc[first] != doc) | (start[first] != start)


def _emit_segments(shards: int, window: int, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                w = Words(pc.fill_null(part.column("text"), ""))
                h = w.hashes()
                starts, place, grams = _minimisers(h, w.at, window, k)
                if not len(starts):
                    continue
                doc = np.searchsorted(w.at, starts, side="right") - 1
                own = mix(grams[place] ^ mix(doc.astype(np.uint64) + np.uint64(1)))

                def told(column: str, own: np.ndarray = own, part: pa.RecordBatch = part) -> np.ndarray:
                    lists = pc.fill_null(part.column(column), [])
                    values = np.asarray(lists.flatten()).view(np.uint64)
                    owner = np.repeat(np.arange(len(lists), dtype=np.uint64), np.asarray(pc.list_value_length(lists)))
                    return np.isin(own, mix(values ^ mix(owner + np.uint64(1))))

                live, hot = told("repeated"), told("hot")
                new = np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]) | hot
                first = np.flatnonzero(new)
                last = np.concatenate([first[1:], [len(starts)]]) - 1
                keep = live[first] | hot[first]
                first, last = first[keep], last[keep]
                if not len(first):
                    continue
                a, b, doc = starts[first], starts[last] + window, doc[first]
                g1, g2 = _numbers(h, a, b)
                by = np.where(hot[first], g1, grams[place[first]])
                ids, tids = np.asarray(part.column("doc_id"))[doc], np.asarray(part.column("tid"))[doc]
                at, n = a - w.at[doc], b - a
                _, later = _earliest(g1, g2, n, ids, at)
                raw = w.buf.tobytes()
                body = [None if x else raw[s:e] for x, s, e in zip(later.tolist(), w.start[a].tolist(), w.end[b - 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((np.where(later, mix(ids.astype(np.uint64) ^ mix(a.astype(np.uint64))), mix(by)) % np.uint64(shards)).astype(np.int32)), pa.array(g1.view(np.int64)), pa.array(g2.view(np.int64)), pa.array(ids), pa.array(tids),
                        pa.array(at), pa.array(n.astype(np.int32)), pa.array(body, pa.binary()),
                    ],
                    ["shard", "g1", "g2", "doc_id", "tid", "start", "n", "body"],
                )

    return run


def _ranges(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, dtype=np.int64)) for c in columns], ["doc_id", "tid", "start", "end"])


def shard_repeats(t: pa.Table, window: int) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated words in one shard's segments."""
    g1, g2, doc, tid, start = (np.asarray(t.column(c)) for c in ("g1", "g2", "doc_id", "tid", "start"))
    n = np.asarray(t.column("n")).astype(np.int64)
    first, later = _earliest(g1, g2, n, doc, start)
    yield _ranges(doc[later], tid[later], start[later], start[later] + n[later])
    left = np.flatnonzero(~later)
    left = left[np.lexsort((tid[left], start[left], doc[left]))]
    _, one = np.unique(first[left], return_index=True)
    segment = np.sort(one)  # a representative of each text, in order of (doc_id, start)
    index = left[segment]
    w = Words(t.column("body").combine_chunks().take(pa.array(index)).cast(pa.string()))
    _, symbol = np.unique(w.hashes(), return_inverse=True)
    text = np.insert(symbol + 1, w.at[:-1], 0)
    begin = w.at[:-1] + 1 + np.arange(len(index))
    end = begin + np.diff(w.at)
    fm = FMIndex(text, window)
    places, firsts = fm.earliest(text, begin, end)
    seg, seg0 = np.searchsorted(begin, places, side="right") - 1, np.searchsorted(begin, firsts, side="right") - 1
    d, d0 = doc[index][seg], doc[index][seg0]
    s, s0 = start[index][seg] + places - begin[seg], start[index][seg0] + firsts - begin[seg0]
    repeat = (d0 < d) | ((d0 == d) & (s0 < s))
    order = np.flatnonzero(repeat)[np.argsort(places[repeat], kind="stable")]
    places, seg = places[order], seg[order]
    new = np.concatenate([[True], (places[1:] != places[:-1] + 1) | (seg[1:] != seg[:-1])]) if len(places) else np.zeros(0, bool)
    a = np.flatnonzero(new)
    b = np.concatenate([a[1:], [len(places)]])[: len(a)] - 1
    group = seg[a]
    low, high = places[a] - begin[group], places[b] - begin[group] + window
    # all rows with this text at this (doc_id, start): repeated rows share what holds for one
    member = np.argsort(first[left], kind="stable")
    key = first[left][member]
    lo, hi = np.searchsorted(key, first[index[group]], "left"), np.searchsorted(key, first[index[group]], "right")
    k = hi - lo
    take = left[member[np.repeat(lo - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())]] if len(k) else np.zeros(0, np.int64)
    yield _ranges(doc[take], tid[take], start[take] + np.repeat(low, k), start[take] + np.repeat(high, k))


def _shards(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            copies = batch.filter(pc.is_null(batch.column("body")))
            if copies.num_rows:
                s = np.asarray(copies.column("start"))
                yield _ranges(np.asarray(copies.column("doc_id")), np.asarray(copies.column("tid")), s, s + np.asarray(copies.column("n")))
            batch = batch.filter(pc.is_valid(batch.column("body")))
            if not batch.num_rows:
                continue
            shard = np.asarray(batch.column("shard"))
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if rest and rest[0].column("shard")[0].as_py() != shard[a]:
                    yield from shard_repeats(pa.Table.from_batches(rest), window)
                    rest = []
                rest.append(batch.slice(a, b - a))
        if rest:
            yield from shard_repeats(pa.Table.from_batches(rest), window)

    return run


def _kept(with_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            texts, found = batch.column("text"), batch.column("found")
            for t, tid, ranges in zip(texts, batch.column("tid").to_pylist(), found, strict=True):
                words = t.as_buffer().to_pybytes().split() if t.is_valid else []
                keep = words
                if ranges.is_valid:
                    off = np.zeros(len(words) + 1, dtype=np.int64)
                    for r in ranges.as_py():
                        if r["tid"] == tid:
                            off[r["start"]] += 1
                            off[r["end"]] -= 1
                    gone = np.cumsum(off)[:-1] > 0
                    keep = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
                joined = b" ".join(keep)
                out.append((len(words), len(words) - len(keep), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None))
            n, gone, digest, text = zip(*out, strict=True) if out else ((), (), (), ())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(text, pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def dedup(spark: SparkSession, docs: DataFrame, window: int = WINDOW, k: int = K, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with_text, kept of each row of docs (doc_id, text).

    A word goes if a window of `window` consecutive words that covers it also starts earlier
    (smaller doc_id, or the same and an earlier start). Words are taken as they are; kept words
    are joined by one space. Words are told apart by 64-bit numbers. Defined cases: a null text
    has no words; rows of one doc_id don't repeat each other at equal starts; a null doc_id comes
    before all others; texts shorter than a window stay whole; a very long text is cut into segments as
    any other; an empty table gives no rows; other columns, also of clashing names, are ignored.
    """
    scratch = store.Scratch(spark, "substrings")
    text = docs.select(store.known_id().alias("doc_id"), "text", F.xxhash64("text").alias("tid"))
    mins = text.select("doc_id", "text").mapInArrow(_emit_minimisers(window, k), "h long, doc_id long")
    many = mins.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("h").alias("_h"), (F.col("c") > HOT).alias("is_hot"))
    seen = mins.join(many, F.col("h") == F.col("_h")).groupBy("doc_id").agg(
        F.collect_set(F.when(~F.col("is_hot"), F.col("h"))).alias("repeated"), F.collect_set(F.when(F.col("is_hot"), F.col("h"))).alias("hot")
    )
    seen = scratch.put(seen, "seen").withColumnRenamed("doc_id", "_id")
    total = seen.agg(F.coalesce(F.sum(F.size("repeated") + window * F.size("hot")), F.lit(0))).first()[0]
    shards = max(1, -(-total * 3 * window // 2 // SHARD_WORDS))
    marked = text.join(seen, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "tid", "repeated", "hot")
    segments = marked.mapInArrow(_emit_segments(shards, window, k), _SEGMENTS)
    ranges = segments.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_shards(window), _RANGES)
    ranges = scratch.put(ranges, "ranges")
    found = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("tid", "start", "end")).alias("found")).withColumnRenamed("doc_id", "_id")
    out = text.join(found, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "tid", "found")
    out = out.mapInArrow(_kept(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
    return out.withColumn("doc_id", store.given_id())


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, store.table(spark, sf_dir, "documents"), with_text=False)


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM v),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM r WHERE k > 1),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
y AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) FILTER (WHERE c.i IS NULL) AS kept, count(c.i) AS gone
  FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN y ON d.doc_id = y.doc_id
"""
