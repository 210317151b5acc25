"""Quality rules whose cutoffs keep the risk of rejecting good documents under control.

Each rule is a whole-number feature of a document and the side on which it is bad, with a
fixed grid of cutoffs. A document's level is the largest index of a cutoff that it meets under
any rule; to reject from a level on uses that cutoff of all rules at once. For each stratum,
labelled documents give exact counts of good documents at or beyond each level; a level may be
used if the Clopper-Pearson upper bound of the rate of good documents that the rules reject
together is at most the allowed rate. Bounds are corrected for all strata (Bonferroni); levels
are tested in a fixed order, from the one that rejects fewest, up to the first that fails, which
needs no further correction. So with the given confidence no stratum loses more than the allowed
rate. Among allowed levels the one that rejects most bad documents is taken, if it rejects any;
rules without which it rejects as many stay unused, which only lowers the risk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parcelflow.llm import store
from parcelflow.llm.words import Words, covered, slices, text_of, window_starts, windows

STRATA = ("de", "en", "es", "fr")
OTHER = "other"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1

FEATURES = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"


@dataclass(frozen=True)
class Rule:
    """Rejects when the feature is at least (high) or at most (not high) a cutoff of the grid."""

    name: str
    feature: str
    high: bool
    grid: tuple[int, ...]


_PER_MILLE = tuple(range(20, 1001, 20))
RULES = (
    Rule("symbols", "1000 * n_symbols div greatest(n_words, 1)", True, tuple(range(20, 2001, 40))),
    Rule("dup_lines", "1000 * n_dup_lines div greatest(n_lines, 1)", True, _PER_MILLE),
    Rule("repeats", "1000 * n_repeat_words div greatest(n_words, 1)", True, _PER_MILLE),
    Rule("long_words", "100 * word_chars div greatest(n_words, 1)", True, tuple(range(500, 1500, 20))),
    Rule("short_words", "100 * word_chars div greatest(n_words, 1)", False, tuple(range(100, 500, 10))),
    Rule("upper", "1000 * n_upper div greatest(word_chars, 1)", True, _PER_MILLE),
)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns but text, and the features; without a text column that of _row counts."""
    for batch in batches:
        for part in slices(batch, "text" if "text" in batch.schema.names else "_row"):
            texts = pc.fill_null(part.column("text") if "text" in part.schema.names else text_of(part), "")
            w = Words(texts)
            n, chars = w.lengths(), w.code_points()
            total = lambda table, w=w: np.diff(np.concatenate([[0], np.cumsum(table[w.buf])])[w.base])
            symbols, upper = total(_SYMBOL), total(_UPPER)
            h = w.hashes()
            grams, bounds = windows(h, w.at, 3)
            owner = np.repeat(np.arange(part.num_rows), np.diff(bounds))
            again = _repeated(grams, owner)
            flags = covered(window_starts(w.at, 3)[again], 3, len(h))
            repeats = np.diff(np.concatenate([[0], np.cumsum(flags)])[w.at])
            dup, lines = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
            for i, t in enumerate(texts.to_pylist()):
                if "\n" in t:
                    kept = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
                    lines[i], dup[i] = len(kept), len(kept) - len(set(kept))
                else:
                    lines[i] = n[i] > 0
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in part.schema.names if c != "text"), *(pa.array(np.asarray(x, dtype=np.int64)) for x in (n, chars, symbols, dup, repeats, lines, upper))],
                [*(c for c in part.schema.names if c != "text"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"],
            )


def _repeated(grams: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which grams their owner has twice or more."""
    order = np.lexsort((grams, owner))
    g, o = grams[order], owner[order]
    same = (g[1:] == g[:-1]) & (o[1:] == o[:-1])
    out = np.zeros(len(grams), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _stratum() -> Column:
    return F.when(F.col("lang").isin(*STRATA), F.col("lang")).otherwise(OTHER).alias("stratum")


def features(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _stratum(), "text").mapInArrow(_features, FEATURES)


def upper_bound(bad: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the rate at which bad or fewer of n have a probability of delta."""
    if bad >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(bad + 1)]

    def tail(p: float) -> float:
        terms = [c + k * math.log(p) + (n - k) * math.log1p(-p) for k, c in enumerate(logs)]
        top = max(terms)
        return top + math.log(math.fsum(math.exp(t - top) for t in terms))

    low, high = bad / n, 1.0 - 1e-12
    low = max(low, 1e-15)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > math.log(delta) else (low, mid)
    return high


def cutoffs(counts: list, risk: float, confidence: float, rules: tuple[Rule, ...] = RULES, strata: tuple[str, ...] = (*STRATA, OTHER)) -> dict[str, dict[str, int]]:
    """counts: rows (stratum, rule, cutoff index, good, bad), of documents whose level is the index (-1: none), met under the rule."""
    delta = (1 - confidence) / len(strata)
    levels = max(len(r.grid) for r in rules)
    out: dict[str, dict[str, int]] = {}
    for s in strata:
        good, bad = np.zeros(levels + 1, int), np.zeros((len(rules), levels + 1), int)
        for row in counts:
            if row["stratum"] == s:
                good[row["cut"] + 1] += row["good"]
                bad[row["rule"], row["cut"] + 1] += row["bad"]
        n = int(good.sum())
        good_beyond, bad_beyond = good[::-1].cumsum()[::-1], bad[:, ::-1].cumsum(axis=1)[:, ::-1]
        best = None
        for c in range(levels)[::-1]:  # from the level that rejects fewest
            g, b = int(good_beyond[c + 1]), int(bad_beyond[:, c + 1].sum())
            if not n or upper_bound(g, n, delta) > risk:
                break
            if b > (best[0] if best else 0):
                best = (b, c)
        if best:
            c = best[1]
            out[s] = {r.name: r.grid[c] if r.high else r.grid[::-1][c] for k, r in enumerate(rules) if c < len(r.grid) and bad_beyond[k, c + 1]}
    return out


def _met(r: Rule) -> Column:
    """Index of the strictest cutoff that a document meets, -1 if none; the grid is evenly spaced."""
    step, x = r.grid[1] - r.grid[0], F.expr(r.feature)
    at = F.floor((x - r.grid[0]) / step) if r.high else F.floor((F.lit(r.grid[-1]) - x) / step)
    return F.greatest(F.lit(-1), F.least(F.lit(len(r.grid) - 1), at)).cast("int")


def choose(feats: DataFrame, labels: DataFrame, risk: float, confidence: float, rules: tuple[Rule, ...] = RULES) -> dict[str, dict[str, int]]:
    """Cutoffs from all labelled documents that pass the base rules; only counts reach the driver."""
    named = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("quality").alias("quality"))
    seen = feats.where(~base_failed()).join(named, F.col("doc_id") == F.col("_id"))
    met = F.array_max(F.array(*(F.struct(_met(r).alias("cut"), F.lit(k).alias("rule")) for k, r in enumerate(rules))))
    rows = seen.select("stratum", "quality", met.alias("m")).groupBy("stratum", "m.rule", "m.cut").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    return cutoffs([r.asDict() for r in rows.collect()], risk, confidence, rules)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rejected(cut: dict[str, dict[str, int]], rules: tuple[Rule, ...] = RULES) -> Column:
    out = F.lit(False)
    for s, by in cut.items():
        for r in rules:
            if r.name in by:
                x = F.expr(r.feature)
                out = out | ((F.col("stratum") == s) & ((x >= by[r.name]) if r.high else (x <= by[r.name])))
    return out


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, risk: float = 0.01, confidence: float = 0.95) -> DataFrame:
    """FEATURES, base_failed and kept for each row of docs (doc_id, lang, text).

    risk: allowed rate of rejected good documents in a stratum; confidence: that it holds in all
    of them. Strata are STRATA and OTHER (any other or no language). Defined cases: a null text
    is empty and fails the base rules; repeated rows are judged one by one; several labels of a
    document count as good if one is; labels that are neither 0 nor 1 are ignored; without
    labels, or with too few for the bound, only the base rules reject; an empty table gives no
    rows; other columns are ignored.
    """
    scratch = store.Scratch(spark, "quality")
    feats = scratch.put(features(docs), "features")
    cut = choose(feats, labels, risk, confidence)
    return feats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected(cut))


def keep(spark: SparkSession, docs: DataFrame, labels: DataFrame, risk: float = 0.01, confidence: float = 0.95) -> DataFrame:
    """The rows of docs, all columns, that judge() keeps. Features are made twice, which is cheaper than a join of texts."""
    store.ship(spark)
    cut = choose(features(docs), labels, risk, confidence)
    rows = store.packed(docs, _stratum())
    kind = StructType(list(rows.schema))
    for name in FEATURES.replace(" long", "").split(", ")[2:]:
        kind = kind.add(name, "long")
    return rows.mapInArrow(_features, kind).where(~base_failed() & ~rejected(cut)).select("_row.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark, store.table(spark, sf_dir, "documents"), store.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
