"""A homography from matched points with outliers, by voting: minimal samples are rows, solved in closed form, scored in one aggregation.

Samples are fixed quadruples of a pair's matches in their order, so a rerun finds the same. Four points
and their images give the projective bases A and B; B adj(A) maps one to the other. The
expressions are plain arithmetic, which Spark, SQL and numpy read alike.

Pairs of up to CHUNK matches are one row each, whose hypotheses are made, scored and forgotten in a task; of larger
ones the matches meet the hypotheses in a join.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.functions.boxes import project
from parcelflow.sources.scratch import Scratch
from parcelflow.sources.shipping import ship

#: Matches of a pair, the first ones, that samples are drawn from: 70 samples of four.
FIRST = 8
#: Least area (twice a triangle's) of any three points of a sample.
FLAT = 1e-6
#: Matches of a pair that one row holds, and errors that a task holds at a time.
CHUNK, HELD = 1024, 1 << 20


def samples(first: int = FIRST) -> list[tuple[int, int, int, int]]:
    return list(itertools.combinations(range(1, first + 1), 4))


def _adjugate(m: list[list[str]]) -> list[list[str]]:
    minor = lambda r, c: [[m[i][j] for j in range(3) if j != c] for i in range(3) if i != r]
    sign = lambda r, c: "" if (r + c) % 2 == 0 else "-"
    two = lambda n: f"({n[0][0]} * {n[1][1]} - {n[0][1]} * {n[1][0]})"
    return [[f"({sign(r, c)}{two(minor(c, r))})" for c in range(3)] for r in range(3)]


def steps(p: str, q: str) -> list[dict[str, str]]:
    """Named expressions, each step using those before: h0..h8 from points {p}x1..{p}y4 and their images {q}x1..{q}y4, flat: the least area."""
    out: list[dict[str, str]] = [{}, {}, {}, {}]
    for s in (p, q):
        m = [[f"{s}x{k}" for k in (1, 2, 3)], [f"{s}y{k}" for k in (1, 2, 3)], ["1.0", "1.0", "1.0"]]
        adj = _adjugate(m)
        for k in range(3):  # the weights that make the three points and the fourth a basis
            out[0][f"{s}w{k}"] = f"({adj[k][0]} * {s}x4 + {adj[k][1]} * {s}y4 + {adj[k][2]})"
        tri = lambda a, b, c, s=s: f"abs(({s}x{b} - {s}x{a}) * ({s}y{c} - {s}y{a}) - ({s}x{c} - {s}x{a}) * ({s}y{b} - {s}y{a}))"
        out[0][f"{s}flat"] = "least(" + ", ".join(tri(*t) for t in itertools.combinations((1, 2, 3, 4), 3)) + ")"
        for r in range(3):
            for k in range(3):
                out[1][f"{s}m{r}{k}"] = f"({m[r][k]} * {s}w{k})"
    adj = _adjugate([[f"{p}m{r}{k}" for k in range(3)] for r in range(3)])
    for r in range(3):
        for c in range(3):
            out[2][f"{p}a{r}{c}"] = adj[r][c]
            out[3][f"h{3 * r + c}"] = "(" + " + ".join(f"{q}m{r}{k} * {p}a{k}{c}" for k in range(3)) + ")"
    out[3]["flat"] = f"least({p}flat, {q}flat)"
    return out


def hypotheses(scratch: Scratch, matches: DataFrame, keys: list[str], first: int = FIRST) -> DataFrame:
    """keys, sample, h (nine numbers) of each sample of the first matches (keys, place from 1, sx, sy, tx, ty) whose points span."""
    wide = matches.where(F.col("place") <= first).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("place", F.struct("sx", "sy", "tx", "ty")))).alias("m"))  # first entries at most
    table = F.array(*(F.struct(F.lit(k).alias("sample"), F.array(*map(F.lit, s)).alias("p")) for k, s in enumerate(samples(first))))
    rows = wide.select(*keys, "m", F.inline(table)).where(F.forall("p", lambda k: F.map_contains_key("m", k)))
    pick = lambda k, c: F.element_at("m", F.col("p")[k - 1])[c]
    rows = rows.select(*keys, "sample", *(pick(k, f"{s}{c}").cast("double").alias(f"{s}{c}{k}") for s in "st" for c in "xy" for k in (1, 2, 3, 4)))
    for k, step in enumerate(steps("s", "t")):
        rows = rows.select("*", *(F.expr(e).alias(n) for n, e in step.items()))
        rows = scratch.put(rows, f"step-{k}") if k == 1 else rows  # else the last step would hold the first ones many times over
    return rows.where(F.col("flat") > FLAT).select(*keys, "sample", F.array(*(f"h{k}" for k in range(9))).alias("h"))


def errors(rows: DataFrame) -> Column:
    """How far a match's projected source lies from its target; null where the projection has no value."""
    h = [F.col("h")[k] for k in range(9)]
    x, y = project(h, F.col("sx"), F.col("sy"))
    far = F.sqrt((x - F.col("tx")) * (x - F.col("tx")) + (y - F.col("ty")) * (y - F.col("ty")))
    return F.when(h[6] * F.col("sx") + h[7] * F.col("sy") + h[8] != 0, far)


def _percentile(values: np.ndarray, start: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Of sorted stretches (from start, n long each, not empty) the linear percentile."""
    at = (n - 1) * p
    low, high = np.floor(at), np.ceil(at)
    a, b = values[start + low.astype(np.int64)], values[start + high.astype(np.int64)]
    return np.where(low == high, a, (high - at) * a + (at - low) * b)


def _best(place: np.ndarray, xy: dict[str, np.ndarray], row: np.ndarray, rows: int, radius: float, first: int) -> tuple:
    """Of matches in the order of their rows: rows with a hypothesis, its sample, h, inliers, median and 95th percentile of their errors."""
    table = np.array(samples(first)) - 1
    at = np.full((rows, first), -1)
    early = np.flatnonzero((place >= 1) & (place <= first))
    at[row[early], place[early] - 1] = early
    r, k = np.nonzero((at >= 0)[:, table].all(axis=2))
    own = at[r[:, None], table[k]]
    names = {f"{s}{c}{i + 1}": xy[f"{s}{c}"][own[:, i]] for s in "st" for c in "xy" for i in range(4)}
    names |= {"abs": np.abs, "least": lambda *v: reduce(np.minimum, v)}
    with np.errstate(all="ignore"):
        for step in steps("s", "t"):
            names |= {n: eval(e, {"__builtins__": {}}, names) for n, e in step.items()}  # noqa: S307  expressions of steps() only
        good = names["flat"] > FLAT
        r, k, h = r[good], k[good], np.stack([names[f"h{i}"][good] for i in range(9)])
        n = np.bincount(row, minlength=rows)
        begin = np.cumsum(n) - n

        def far(r: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            of = np.repeat(np.arange(len(r)), n[r])
            m = np.arange(len(of)) - np.repeat(np.cumsum(n[r]) - n[r], n[r]) + begin[r][of]
            h, sx, sy = h[:, of], xy["sx"][m], xy["sy"][m]
            w = h[6] * sx + h[7] * sy + h[8]
            x, y = (h[0] * sx + h[1] * sy + h[2]) / w - xy["tx"][m], (h[3] * sx + h[4] * sy + h[5]) / w - xy["ty"][m]
            return of, np.where(w != 0, np.sqrt(x * x + y * y), np.inf)

        of, error = far(r, h)
        inliers = np.bincount(of[error < radius], minlength=len(r))
        order = np.lexsort((k, -inliers, r))
        order = order[np.unique(r[order], return_index=True)[1]]
        r, k, h, inliers = r[order], k[order], h[:, order], inliers[order]
        of, error = far(r, h)
        of, error = of[error < radius], error[error < radius]
        error = error[np.lexsort((error, of))]
        some, start = inliers > 0, np.cumsum(inliers) - inliers
        told = [np.full(len(r), np.nan) for _ in range(2)]
        for out, p in zip(told, (0.5, 0.95), strict=True):
            out[some] = _percentile(error, start[some], inliers[some], p)
    return r, k, h.T, inliers, n[r], *told


def _voting(radius: float, first: int):
    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pa.compute.list_value_length(whole["m"]).to_numpy(zero_copy_only=False)
            cost = np.cumsum(sizes * len(samples(first)))
            cuts = [0, *np.flatnonzero(np.diff(cost // HELD)) + 1, whole.num_rows]
            for a, b in itertools.pairwise(cuts):
                if a == b:
                    continue
                batch = whole.slice(a, b - a)
                m = batch["m"].flatten()
                column = lambda n, m=m: m.field(n).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(b - a), sizes[a:b])
                r, k, h, inliers, n, median, p95 = _best(column("place"), {c: column(c) for c in ("sx", "sy", "tx", "ty")}, row, b - a, radius, first)
                keys = batch.drop_columns(["m"]).take(pa.array(r))
                h = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1) * 9, pa.int32()), pa.array(h.reshape(-1)))
                null = lambda v: pa.array(v, pa.float64(), from_pandas=True)
                columns = [*keys.columns, pa.array(k, pa.int32()), pa.array(inliers, pa.int64()), pa.array(n, pa.int64()), h, null(median), null(p95)]
                yield pa.RecordBatch.from_arrays(columns, [*keys.schema.names, "sample", "inliers", "matches", "h", "median_error", "p95_error"])

    return votes


def vote(scratch: Scratch, matches: DataFrame, keys: list[str], radius: float = 3.0, first: int = FIRST) -> DataFrame:
    """For each pair the hypothesis with most inliers (error below radius; of equals the least sample): keys, sample, h, matches, inliers, median_error and p95_error of inliers.

    Pairs without four points that span give no row.
    """
    ship(matches.sparkSession)
    double = lambda *c: [F.col(x).cast("double").alias(x) for x in c]
    point = F.struct(F.col("place").cast("long").alias("place"), *double("sx", "sy", "tx", "ty"))
    chunks = matches.groupBy(*keys, F.floor((F.col("place") - 1) / CHUNK).alias("_c")).agg(F.collect_list(point).alias("m"))  # CHUNK entries at most
    chunks = scratch.put(chunks, "chunks")
    large = chunks.where("_c > 0").select(*keys).distinct()
    told = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in matches.select(*keys).schema.fields), "sample int, inliers long, matches long, h array<double>, median_error double, p95_error double"])
    if large.isEmpty():
        return chunks.select(*keys, "m").mapInArrow(_voting(radius, first), told)
    large = scratch.put(large, "large")
    small = chunks.join(large, keys, "left_anti").select(*keys, "m").mapInArrow(_voting(radius, first), told)
    return small.unionByName(_vote_joined(scratch, chunks.join(large, keys, "left_semi").select(*keys, F.inline("m")), keys, radius, first))


def _vote_joined(scratch: Scratch, matches: DataFrame, keys: list[str], radius: float, first: int) -> DataFrame:
    """As vote(): matches meet a pair's at most C(first, 4) hypotheses, and counts are combined in map tasks."""
    tried = scratch.put(hypotheses(scratch, matches, keys, first), "hypotheses")
    met = matches.join(tried, keys).withColumn("error", errors(matches))
    good = F.coalesce(F.col("error") < radius, F.lit(False))
    score = met.groupBy(*keys, "sample").agg(F.count_if(good).alias("inliers"), F.count(F.lit(1)).alias("matches"))
    best = score.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("inliers"), "sample"))).where("_r = 1").drop("_r")
    best = scratch.put(best.join(tried, [*keys, "sample"]), "best")
    inside = matches.join(best, keys).withColumn("error", errors(matches)).where(F.col("error") < radius)
    told = inside.groupBy(*keys).agg(F.median("error").alias("median_error"), F.percentile("error", 0.95).alias("p95_error"))
    return best.join(told, keys, "left")
