"""Nearest neighbours of bit codes: multi-index hashing as an equi-join, exact by the pigeonhole bound, or blocks of codes scanned in tasks.

Hashing pays where the radius is small; at wide ones, where pieces with all their flips meet much of all
pairs, blocks of queries and of codes meet once each and a task counts the bits that differ, with no row for a pair.

A code of 64 bits is cut into pieces. Two codes within a radius differ by at most radius/pieces bits in
some piece, so a query looks its pieces up with all flips of so many bits, and codes that share
a looked-up piece meet in an equi-join. A pair counts at the first piece that brings it, so none
comes twice. Equal codes are searched once, whatever their number.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.sources.scratch import Scratch
from parcelflow.sources.shipping import ship

BITS = 64
#: Codes of a block at least, and blocks of a side at most: 64 x 64 groups, each code is sent to 64 of them.
SIDE, MOST_BLOCKS = 4096, 64
#: Share of all pairs that may meet in a piece before blocks are scanned instead.
SPARSE = 0.01


def sign_code(vector: Column) -> Column:
    """The signs of up to 64 numbers as bits, the first one lowest."""
    bits = F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _cuts(pieces: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each piece."""
    at = [BITS * k // pieces for k in range(pieces + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(at)]


def _piece(code: Column, low: int, n: int) -> Column:
    return F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << n) - 1)).cast("int")


def _flips(n: int, most: int) -> list[int]:
    return [sum(1 << b for b in some) for k in range(most + 1) for some in itertools.combinations(range(n), k)]


def within(queries: DataFrame, codes: DataFrame, keys: list[str], radius: int, pieces: int) -> DataFrame:
    """keys, q, code, distance of all pairs of queries (keys, q) and codes (keys, code), both distinct, that differ by at most radius bits."""
    cuts, most = _cuts(pieces), radius // pieces
    flipped = lambda k, low, n: F.transform(F.array(*map(F.lit, _flips(n, most))), lambda x: F.struct(F.lit(k).alias("_k"), _piece(F.col("q"), low, n).bitwiseXOR(x).alias("_v")))
    asked = F.flatten(F.array(*(flipped(k, low, n) for k, (low, n) in enumerate(cuts))))
    held = F.array(*(F.struct(F.lit(k).alias("_k"), _piece(F.col("code"), low, n).alias("_v")) for k, (low, n) in enumerate(cuts)))
    left = queries.select(*keys, "q", F.explode(asked).alias("_p")).select(*keys, "q", "_p._k", "_p._v")
    right = codes.select(*keys, "code", F.explode(held).alias("_p")).select(*keys, "code", "_p._k", "_p._v")
    met = left.join(right, [*keys, "_k", "_v"]).withColumn("distance", distance(F.col("q"), F.col("code"))).where(F.col("distance") <= radius)
    apart = [F.bit_count(_piece(F.col("q"), low, n).bitwiseXOR(_piece(F.col("code"), low, n))) > most for low, n in cuts]
    first = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, apart[:k], F.col("_k") == k) for k in range(pieces)])
    return met.where(first).select(*keys, "q", "code", "distance")


def two_nearest(near: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """For each q its first two neighbours by (distance, id): keys, q, best, first_distance, second, second_distance.

    near: as within() gives it; ids: (keys, code, id), of each code its two smallest ids at most.
    """
    rows = near.join(ids, [*keys, "code"])
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "q").orderBy("distance", "id"))).where("_r <= 2")
    pick = lambda k, c: F.max(F.when(F.col("_r") == k, F.col(c)))
    return rows.groupBy(*keys, "q").agg(pick(1, "id").alias("best"), pick(1, "distance").alias("first_distance"), pick(2, "id").alias("second"), pick(2, "distance").alias("second_distance"))


def met_share(radius: int, pieces: int) -> float:
    """The share of pairs of random codes that within() brings together."""
    return sum(len(_flips(n, radius // pieces)) / 2**n for _, n in _cuts(pieces))


def _two(q: np.ndarray, codes: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of queries and codes, and their distances, that hold each query's two nearest codes within reach, ties included; a few more come as well."""
    rows, wide, part = 16, 8192, 256
    both, far = np.empty((rows, wide), np.uint64), np.empty((rows, wide), np.uint8)
    for i in range(0, len(q), rows):
        own = q[i : i + rows, None]
        bound = np.full(len(own), reach, np.uint8)
        for j in range(0, len(codes), wide):
            some = codes[None, j : j + wide]
            x, d = both[: len(own), : some.shape[1]], far[: len(own), : some.shape[1]]
            np.bitwise_count(np.bitwise_xor(own, some, out=x), out=d)
            least = np.minimum.reduceat(d, np.arange(0, d.shape[1], part), axis=1)
            if least.shape[1] > 1:  # two parts hold codes as near as the second least of the parts' minima
                bound = np.minimum(bound, np.partition(least, 1, axis=1)[:, 1])
            if (least.min(axis=1) <= bound).any():
                r, c = np.nonzero(d <= bound[:, None])
                yield i + r, j + c, d[r, c]


def _scan(reach: int, keys: list[str]):
    def scan(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        names = [*keys, "q", "code", "distance"]
        if asked.empty or held.empty:
            return pd.DataFrame({n: [] for n in names})
        q, codes = asked["q"].to_numpy().view(np.uint64), held["code"].to_numpy().view(np.uint64)
        found = list(_two(q, codes, reach))
        at, to, far = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(3))
        order = np.lexsort((far, at))
        at, to, far = at[order], to[order], far[order]
        first = np.searchsorted(at, at)  # where a query's rows begin; codes no farther than its second one stay
        second = np.minimum(first + 1, np.maximum(np.searchsorted(at, at, side="right") - 1, 0))
        stay = far <= far[second]
        at, to, far = at[stay], to[stay], far[stay]
        rows = asked[[*keys, "q"]].iloc[at].reset_index(drop=True)
        return rows.assign(code=held["code"].to_numpy()[to], distance=far.astype(np.int32))[names]

    return scan


def nearest(queries: DataFrame, codes: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """keys, q, code, distance of each query's two nearest codes at most reach bits away, and of some more; ties come all.

    Blocks of queries meet blocks of codes, each pair of blocks in a task of its own; a task keeps what may be
    among the first two, so rows grow with queries and blocks and not with pairs.
    """
    def blocks(rows: DataFrame, out: str) -> DataFrame:
        n = F.least(F.lit(MOST_BLOCKS), F.ceil(F.count(F.lit(1)) / SIDE)).cast("int")
        return rows.groupBy(*keys).agg(n.alias(out))

    def met(rows: DataFrame, n: DataFrame) -> DataFrame:
        return rows.join(n, keys) if keys else rows.crossJoin(n)

    ship(queries.sparkSession)
    nq, nt = blocks(queries, "_nq"), blocks(codes, "_nt")
    n = nq.join(nt, keys) if keys else nq.crossJoin(nt)
    number = lambda c, k: F.pmod(F.xxhash64(c), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    left = met(queries, n).select(*keys, "q", number("q", "_nq").alias("_bq"), every("_nt").alias("_bt"))
    right = met(codes, n).select(*keys, "code", number("code", "_nt").alias("_bt"), every("_nq").alias("_bq"))
    at = [*keys, "_bq", "_bt"]
    schema = [f for f in queries.schema.fields if f.name in keys]
    told = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "q long, code long, distance int"])
    return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(_scan(reach, keys), told)


def matches(scratch: Scratch, queries: DataFrame, train: DataFrame, keys: list[str], most: int, ratio: float, pieces: int = 6) -> DataFrame:
    """Of queries and train (keys, id, code): each query whose nearest neighbour differs by at most most bits, with its second neighbour and whether it is distinct.

    distinct: the nearest is closer than ratio times the second. Only a second within most/ratio bits can
    change that, so it is searched no further (null: none there), and only for queries that have a
    nearest. Ties go to the smaller id; codes without a partner give no row.
    """
    train = scratch.put(train.where("code is not null").withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "code").orderBy("id"))).where("_r <= 2").drop("_r"), "train")
    codes = train.select(*keys, "code").distinct()
    asked = scratch.put(queries.where("code is not null").select(*keys, "id", F.col("code").alias("q")), "queries")
    reach = int(most / ratio)
    more = max(1, min(pieces + 2, reach + 1))
    if met_share(reach, more) > SPARSE:
        wide = scratch.put(nearest(scratch.put(asked.select(*keys, "q").distinct(), "asked"), scratch.put(codes, "codes"), keys, reach), "wide")
    else:
        close = scratch.put(within(asked.select(*keys, "q").distinct(), codes, keys, most, pieces), "close")
        wide = scratch.put(within(close.select(*keys, "q").distinct(), codes, keys, reach, more), "wide")
    found = two_nearest(wide, train, keys).where(F.col("first_distance") <= most)
    clear = F.col("second_distance").isNull() | (F.col("first_distance") < ratio * F.col("second_distance"))
    return asked.join(found, [*keys, "q"]).select(*keys, "id", "best", "first_distance", "second", "second_distance", clear.alias("distinct"))
