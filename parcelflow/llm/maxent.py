"""Hashed maximum-entropy language model with a class-factored softmax.

The HEAD most frequent words are modelled one by one, in CLASSES classes of equal size; all
other words by TAIL classes of word endings. P(word | before) is P(class | before) times
P(word | class, before), the latter a softmax for head words and the smoothed relative
frequency for others. Features are the word before and the one before that (a skip), of tail words
their class, and both (an n-gram) by the words' own numbers, hashed to rows of weights. Their
number grows with the root of the vocabulary (table_rows), between LEAST_ROWS and MOST_ROWS.

All counts come from every training document. Weights are trained by distributed gradient
updates: each training document belongs to one of ROUNDS rounds; a task starts from the round's
weights and takes a gradient step (observed less expected feature counts, Adagrad's step sizes)
for each batch of its tokens; then each row of weights becomes the mean of all tasks', weighted
by how many tokens of a task have the row's feature. The driver holds no more than the weights.
Scoring adds rows of sparse features in numpy batches. Frequencies are broadcast only for
words with more than a 1/SHARE of all tokens, so at most SHARE words; others are joined.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm import store
from parcelflow.llm.sums import SUMS, emit, summed
from parcelflow.llm.words import Words, mix, slices

CLASSES, SLOTS, TAIL = 32, 32, 32
HEAD, KINDS = CLASSES * SLOTS, CLASSES + TAIL
SHARE = 1 << 20
LEAST_ROWS, MOST_ROWS = 1 << 12, 1 << 17
FEATURES, ROUNDS = 3, 3
RATE = 0.1
PAD = HEAD + TAIL
END = np.uint64(0x452821E638D01377)
_BATCH, _FLUSH = 8192, 1 << 20


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and tail classes of all tokens (words of the lower-cased texts, each text's end), and bounds by text."""
    w = Words(pc.fill_null(texts, "")).lower()
    h, at = w.hashes(), w.at[1:]
    buf = np.concatenate([w.buf, [np.uint8(0)]])
    pair = buf[w.end - 1].astype(np.uint64) | (np.where(w.end - w.start > 1, buf[w.end - 2], 0).astype(np.uint64) << np.uint64(8))
    kind = (mix(pair + np.uint64(1)) % np.uint64(TAIL)).astype(np.int64)
    return np.insert(h, at, END), np.insert(kind, at, 0), w.at + np.arange(len(w.at))


def table_rows(vocabulary: int) -> int:
    """Rows of weights for classes; those for words are twice as many."""
    return min(MOST_ROWS, max(LEAST_ROWS, 1 << math.ceil(math.log2(4 * math.sqrt(max(1, vocabulary))))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def merged(parts: list) -> tuple:
        h, k, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        codes, unique = pd.factorize(h)
        first = np.zeros(len(unique), dtype=np.int64)
        first[codes[::-1]] = k[::-1]
        return unique, first, np.bincount(codes, weights=c, minlength=len(unique)).astype(np.int64)

    def rows(x: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int32)), pa.array(x[2])], ["h", "kind", "c"])

    for batch in batches:
        for part in slices(batch, "text"):
            h, k, _ = tokens(part.column("text"))
            new = merged([(h, k, np.ones(len(h)))])
            total = new if total is None else merged([total, new])
            if len(total[0]) > _FLUSH:
                yield rows(total)
                total = None
    if total is not None:
        yield rows(total)


def _encode(shared) -> Callable:
    """Per document: counts and logs of words with a broadcast frequency, codes of all tokens, numbers of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, head = shared.value
        logs = np.log10(count + 0.5)
        for batch in batches:
            for part in slices(batch, "text"):
                h, kind, at = tokens(part.column("text"))
                codes, unique = pd.factorize(h)
                place = np.minimum(np.searchsorted(known, unique), max(len(known) - 1, 0))
                found = known[place] == unique if len(known) else np.zeros(len(unique), bool)
                model = np.where(found, head[place], -1) if len(known) else np.full(len(unique), -1)
                log = np.where(found, logs[place], 0.0) if len(known) else np.zeros(len(unique))
                is_known, m = found[codes], model[codes]
                by_doc = lambda x: np.add.reduceat(x, at[:-1]) if len(x) else np.zeros(0)  # noqa: E731  each document has its end
                rest = h[~is_known]
                bounds = np.concatenate([[0], np.cumsum(by_doc((~is_known).astype(np.int64)))]).astype(np.int32)
                code = np.where(m >= 0, m, HEAD + kind).astype("<u2")
                packed = lambda width, x, n=part.num_rows, at=at: pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((width * at).astype(np.int32)), pa.py_buffer(x)])
                data, words = packed(2, code), packed(4, (h >> np.uint64(32)).astype("<u4"))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("rid"), part.column("doc_id"), part.column("held_out"), part.column("round"), pa.array(np.diff(at)), pa.array(by_doc(is_known.astype(np.int64))),
                        pa.array(by_doc(log[codes])), pa.array(by_doc(np.where(m >= 0, log[codes], 0.0))), data, words, pa.ListArray.from_arrays(pa.array(bounds), pa.array(rest.view(np.int64))),
                    ],
                    ["rid", "doc_id", "held_out", "round", "n_tokens", "n_known", "log_known", "log_head", "codes", "words", "rest"],
                )

    return run


_CODED = "rid long, doc_id long, held_out boolean, round int, n_tokens long, n_known long, log_known double, log_head double, codes binary, words binary, rest array<long>"


class Model:
    """Weights: kinds (rows x KINDS) and words (2 * rows x SLOTS), with biases; place of each head word."""

    def __init__(self, kind_bias: np.ndarray, word_bias: np.ndarray, place: np.ndarray, rows: int = LEAST_ROWS, rate: float | None = None):
        self.kind_bias, self.word_bias, self.place = kind_bias.astype(np.float32), word_bias.astype(np.float32), place
        self.rate = RATE if rate is None else rate
        self.kinds = np.zeros((rows, KINDS), dtype=np.float32)
        self.words = np.zeros((2 * rows, SLOTS), dtype=np.float32)

    def contexts(self, code: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Class, slot (-1 in the tail) and the numbers of the three features of each token; word: 32 bits of its number."""
        i = np.arange(len(code)) - np.repeat(at[:-1], np.diff(at))
        before = lambda x, k, pad: np.where(i >= k, np.concatenate([np.zeros(k, x.dtype), x[:-k]])[: len(x)], pad).astype(np.uint64)
        one, two = before(code, 1, PAD), before(code, 2, PAD)
        w = word.astype(np.uint64) + np.uint64(1)  # 0: before the text
        pair = mix(before(w, 1, 0)) + before(w, 2, 0)
        place = np.concatenate([self.place, (CLASSES + np.arange(TAIL)) * SLOTS])[code]
        kind = place // SLOTS
        slot = np.where(code < HEAD, place % SLOTS, -1)
        return kind, slot, [mix(one * np.uint64(8) + np.uint64(1)), mix(two * np.uint64(8) + np.uint64(2)), mix(pair * np.uint64(8) + np.uint64(3))]

    @staticmethod
    def _softmax(bias: np.ndarray, weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        s = weights[rows[0]]
        for r in rows[1:]:
            s += weights[r]
        s += bias
        s -= s.max(axis=1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=1, keepdims=True)
        return s

    def batches(self, code: np.ndarray, word: np.ndarray, at: np.ndarray) -> Iterator[tuple]:
        """Of consecutive tokens: range, class probabilities and rows, and the same of the head words among them."""
        kind, slot, feats = self.contexts(code, word, at)
        for a in range(0, len(code), _BATCH):
            s = slice(a, a + _BATCH)
            rows = [(f[s] % np.uint64(len(self.kinds))).astype(np.int64) for f in feats]
            p = self._softmax(self.kind_bias, self.kinds, rows)
            head = np.flatnonzero(slot[s] >= 0)
            k = kind[s][head]
            wide = [(mix(f[s][head] + k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(len(self.words))).astype(np.int64) for f in feats]
            q = self._softmax(self.word_bias[k], self.words, wide)
            yield s, kind[s], rows, p, head, slot[s][head], wide, q

    def log10(self, code: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """By document, the log10 of the probabilities of classes and of head words in them."""
        out = np.zeros(len(code))
        for s, kind, _, p, head, slot, _, q in self.batches(code, word, at):
            v = np.log10(np.maximum(p[np.arange(len(kind)), kind], 1e-30).astype(np.float64))
            v[head] += np.log10(np.maximum(q[np.arange(len(head)), slot], 1e-30).astype(np.float64))
            out[s] = v
        return np.add.reduceat(out, at[:-1]) if len(code) else np.zeros(len(at) - 1)

    def train(self, code: np.ndarray, word: np.ndarray, at: np.ndarray, seen: list[np.ndarray], squares: list[np.ndarray]) -> None:
        """A gradient step for each batch; adds to the tokens seen by each row and to the sums of squared gradients."""
        for _, kind, rows, p, _, slot, wide, q in self.batches(code, word, at):
            for k, (weights, features, target, prob) in enumerate(((self.kinds, rows, kind, p), (self.words, wide, slot, q))):
                if not len(target):
                    continue
                prob[np.arange(len(target)), target] -= 1  # expected less observed
                g = np.zeros_like(weights)
                for r in features:
                    seen[k] += np.bincount(r, minlength=len(weights))
                    _gather(g, r, prob)
                squares[k] += g * g
                weights -= self.rate * g / np.sqrt(squares[k] + 1e-6)


def _gather(into: np.ndarray, rows: np.ndarray, p: np.ndarray) -> None:
    if not len(rows):
        return
    order = np.argsort(rows.astype(np.uint16) if len(into) <= 1 << 16 else rows, kind="stable")
    r = rows[order]
    at = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    into[r[at]] += np.add.reduceat(p[order], at, axis=0)


def _decoded(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents, codes, word numbers (if there) and bounds of a few documents at once."""
    raw, words = batch.column("codes"), batch.column("words") if "words" in batch.schema.names else None
    n = pc.binary_length(raw).to_numpy(zero_copy_only=False) // 2
    ends, at = np.cumsum(n), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        code = np.frombuffer(b"".join(raw[at:to].to_pylist()), dtype="<u2").astype(np.int64)
        word = np.frombuffer(b"".join(words[at:to].to_pylist()), dtype="<u4") if words is not None else np.zeros(0, np.uint32)
        yield slice(at, to), code, word, np.concatenate([[0], np.cumsum(n[at:to])])
        at = to


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each head word follows each of the first 32 words and of the tail's classes."""
    total = np.zeros(HEAD * 64)
    for batch in batches:
        for _, code, _, at in _decoded(batch):
            before = np.concatenate([[PAD], code[:-1]])
            before[at[:-1][at[:-1] < len(code)]] = PAD
            near = np.where(before < 32, before, np.where((before >= HEAD) & (before < PAD), before - HEAD + 32, -1))
            ok = (code < HEAD) & (near >= 0)
            total += np.bincount(code[ok] * 64 + near[ok], minlength=HEAD * 64)
    yield from emit([total])


def _trained(shared) -> Callable:
    """For each task its rows of weights times the tokens that have them, and those numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start: Model = shared.value
        model = Model(start.kind_bias, start.word_bias, start.place, len(start.kinds), start.rate)
        model.kinds[:], model.words[:] = start.kinds, start.words
        seen = [np.zeros(len(model.kinds)), np.zeros(len(model.words))]
        squares = [np.zeros_like(model.kinds), np.zeros_like(model.words)]
        for batch in batches:
            for _, code, word, at in _decoded(batch):
                model.train(code, word, at, seen, squares)
        yield from emit([model.kinds * seen[0][:, None], model.words * seen[1][:, None], *seen], "<f4")

    return run


def _score(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tail_log = shared.value
        for batch in batches:
            out = []
            for _, code, word, at in _decoded(batch):
                own = np.where(code >= HEAD, tail_log[np.clip(code - HEAD, 0, TAIL - 1)], 0.0)
                out.append(model.log10(code, word, at) - (np.add.reduceat(own, at[:-1]) if len(code) else 0))
            names = [n for n in batch.schema.names if n not in ("codes", "words")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(np.concatenate(out) if out else np.zeros(0))], [*names, "log_model"])

    return run


def _split(near: np.ndarray) -> np.ndarray:
    """Places of head words: halves by the main direction in which the neighbours differ, again and again."""
    x = np.log1p(near)
    x = x - x.mean(axis=1, keepdims=True)
    groups = [np.arange(HEAD)]
    while len(groups) < CLASSES:
        out = []
        for g in groups:
            y = x[g] - x[g].mean(axis=0)
            _, vectors = np.linalg.eigh(y.T @ y)
            axis = vectors[:, -1] * (1 if vectors[np.argmax(np.abs(vectors[:, -1])), -1] > 0 else -1)
            order = g[np.argsort(np.round(y @ axis, 9), kind="stable")]
            out += [np.sort(order[: len(g) // 2]), np.sort(order[len(g) // 2 :])]
        groups = out
    place = np.zeros(HEAD, dtype=np.int64)
    for k, g in enumerate(groups):
        place[g] = k * SLOTS + np.arange(len(g))
    return place


def score(spark: SparkSession, docs: DataFrame, held_out_of: int = 5, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text).

    Documents with crc32(doc_id as text) mod held_out_of equal to held_out are left out of
    everything that is learnt. base_score: add-half unigrams; score: the model's log10
    probability. Words are told apart by 64-bit hashes. Defined cases: a null text is empty and
    has only its end; a null doc_id counts as an empty text in the fold; rows of one doc_id are
    scored one by one; a very long text is one sequence; without training documents every token
    is unknown; an empty table gives no rows; other columns, also of clashing names, are ignored.
    """
    scratch = store.Scratch(spark, "maxent")
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    out = (crc % held_out_of) == held_out
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", out.alias("held_out"), F.when(out, -1).otherwise(F.floor(crc / held_out_of) % ROUNDS).cast("int").alias("round"))
    words = rows.where(~F.col("held_out")).select("text").mapInArrow(_count, "h long, kind int, c long").groupBy("h").agg(F.first("kind").alias("kind"), F.sum("c").alias("c"))
    words = scratch.put(words, "words")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = words.where(F.col("c") * SHARE > n).select("h", "kind", "c").toPandas().sort_values(["c", "h"], ascending=[False, True])
    head_rank = np.where(np.arange(len(frequent)) < HEAD, np.arange(len(frequent)), -1)
    head = frequent.iloc[:HEAD]
    known = frequent["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    count = frequent["c"].to_numpy(np.int64)
    tail = {r["kind"]: (r["t"], r["v"]) for r in words.groupBy("kind").agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("v")).collect()}
    mass = np.array([tail.get(k, (0, 0)) for k in range(TAIL)], dtype=np.float64)
    np.subtract.at(mass[:, 0], head["kind"].to_numpy(int), head["c"].to_numpy(float))
    np.subtract.at(mass[:, 1], head["kind"].to_numpy(int), 1.0)
    tail_mass = mass[:, 0] + 0.5 * (mass[:, 1] + 1)

    shared = spark.sparkContext.broadcast((known[order], count[order], head_rank[order]))
    ided = rows.withColumn("rid", F.monotonically_increasing_id())
    coded = scratch.put(ided.mapInArrow(_encode(shared), _CODED), "coded", by="round")

    near = summed(coded.where("round >= 0").select("codes").mapInArrow(_neighbours, SUMS))
    near = np.zeros((HEAD, 64)) if near is None else near.reshape(HEAD, 64)
    place = _split(near)
    own = np.full(HEAD, 1e-9)
    own[: len(head)] = head["c"].to_numpy(float) + 0.5
    by_place = np.full(HEAD, 1e-9)
    by_place[place] = own
    by_place = by_place.reshape(CLASSES, SLOTS)
    kinds = np.concatenate([by_place.sum(axis=1), tail_mass])
    model = Model(np.log(kinds / kinds.sum()), np.log(by_place / by_place.sum(axis=1, keepdims=True)), place, table_rows(v))
    shapes = [model.kinds.shape, model.words.shape, (len(model.kinds), 1), (len(model.words), 1)]
    for r in range(ROUNDS):
        got = summed(coded.where(F.col("round") == r).select("codes", "words").mapInArrow(_trained(spark.sparkContext.broadcast(model)), SUMS), "<f4")
        if got is not None:
            by_kind, by_word, n_kinds, n_words = (x.reshape(k) for x, k in zip(np.split(got, np.cumsum([math.prod(k) for k in shapes])[:-1]), shapes, strict=True))
            model.kinds = np.where(n_kinds > 0, by_kind / np.maximum(n_kinds, 1), model.kinds).astype(np.float32)
            model.words = np.where(n_words > 0, by_word / np.maximum(n_words, 1), model.words).astype(np.float32)

    final = spark.sparkContext.broadcast((model, np.log10(tail_mass)))
    kept = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "log_known", "log_head"]
    scored = coded.select(*kept, "codes", "words").mapInArrow(_score(final), _CODED.replace(" codes binary, words binary, rest array<long>", " log_model double").replace(" round int,", ""))
    rest = coded.select("rid", F.explode("rest").alias("w"))
    logs = rest.join(words.select("h", "c"), F.col("w") == F.col("h"), "left").groupBy("rid").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("log_rest"), F.count("c").alias("n_rest")
    ).withColumnRenamed("rid", "_rid")
    every = F.col("log_known") + F.coalesce("log_rest", F.lit(0.0))
    return scored.join(logs, F.col("rid") == F.col("_rid"), "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("n_rest", F.lit(0))).alias("n_known"), F.lit(int(n)).alias("train_tokens"),
        (every - F.col("n_tokens") * math.log10(n + 0.5 * (v + 1))).alias("base_score"), (F.col("log_model") + every - F.col("log_head")).alias("score"),
    )


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, store.table(spark, sf_dir, "documents"))
