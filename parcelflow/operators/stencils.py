"""Stencils on planes cut into tiles: only border strips travel to neighbours, array functions do the rest.

A tile is one row (keys, ty, tx) that holds each plane as an array of rows. with_halo() gives it
margins of r pixels: each tile sends strips of its own border to its eight neighbours, which
join them by their key; tiles themselves stay where they were made. Beyond the frame margins are null, so
aggregates that skip nulls are clipped at the frame's edge, and frames may have any size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE = 256
_AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]


def _range(n: Column) -> Column:
    """0 to n - 1, nothing for 0."""
    return F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)


def tiles(rows: DataFrame, keys: list[str], planes: list[str], side: int = SIDE) -> DataFrame:
    """rows (keys, y, planes as arrays from x = 0) as tiles of side x side, smaller ones at the right and below: keys, ty, tx, planes."""
    tx = F.explode(F.sequence(F.lit(0), ((F.size(planes[0]) - 1) / side).cast("int")))
    cut = rows.select(*keys, "y", *planes, tx.alias("tx")).select(*keys, F.floor(F.col("y") / side).cast("int").alias("ty"), "tx", "y", *(F.slice(p, F.col("tx") * side + 1, F.lit(side)).alias(p) for p in planes))
    made = cut.groupBy(*keys, "ty", "tx").agg(F.sort_array(F.collect_list(F.struct("y", *planes))).alias("_t"))  # side rows at most
    return made.select(*keys, "ty", "tx", *(F.col(f"_t.{p}").alias(p) for p in planes))


def _end(a: Column, r: int) -> Column:
    return F.slice(a, F.greatest(F.size(a) - r, F.lit(0)) + 1, F.lit(r))


def _strip(plane: str, dy: int, dx: int, r: int) -> Column:
    """What the neighbour at (dy, dx) needs of a tile's plane."""
    part = {1: lambda a: _end(a, r), -1: lambda a: F.slice(a, 1, r), 0: lambda a: a}
    rows = part[dy](F.col(plane))
    return rows if dx == 0 else F.transform(rows, part[dx])


def with_halo(cut: DataFrame, keys: list[str], planes: list[str], r: int) -> DataFrame:
    """Tiles with h, w (their own size) and planes of (h + 2r) x (w + 2r), null beyond the frame; r is at most the tiles' side."""
    place = [*keys, "ty", "tx"]
    sent = F.array(*(F.struct((F.col("ty") + dy).alias("ty"), (F.col("tx") + dx).alias("tx"), F.lit(k).alias("k"), *(_strip(p, dy, dx, r).alias(p) for p in planes)) for k, (dy, dx) in enumerate(_AROUND)))
    sent = cut.select(*keys, F.explode(sent).alias("s")).select(*keys, "s.*").where("ty >= 0 and tx >= 0")
    got = sent.groupBy(*place).agg(*(F.first(F.when(F.col("k") == k, F.struct(*planes)), ignorenulls=True).alias(f"_n{k}") for k in range(8)))
    all_ = cut.join(got, place, "left").withColumn("h", F.size(planes[0])).withColumn("w", F.size(F.col(planes[0])[0]))

    def padded(p: str) -> Column:
        near = {(-dy, -dx): F.col(f"_n{k}")[p] for k, (dy, dx) in enumerate(_AROUND)}
        before = lambda a, i: F.get(a, i - F.lit(r) + F.coalesce(F.size(a), F.lit(0)))  # noqa: E731  the last of a lies next to the tile
        after = lambda a, i: F.get(a, i)
        line = lambda row, pick, n: F.transform(F.sequence(F.lit(0), n - 1), lambda j: pick(row, j))
        whole = lambda left, mid, right: F.concat(line(left, before, F.lit(r)), line(mid, after, F.col("w")), line(right, after, F.lit(r)))
        band = lambda dy, pick: F.transform(F.sequence(F.lit(0), F.lit(r - 1)), lambda i: whole(pick(near[dy, -1], i), pick(near[dy, 0], i), pick(near[dy, 1], i)))
        middle = F.transform(F.col(p), lambda row, i: F.concat(line(F.get(near[0, -1], i), before, F.lit(r)), row, line(F.get(near[0, 1], i), after, F.lit(r))))
        return F.concat(band(-1, before), middle, band(1, after))

    return all_.select(*place, "h", "w", *(padded(p).alias(p) for p in planes))


def total(a: Column) -> Column:
    """Sum of what isn't null."""
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + F.coalesce(v.cast("long"), F.lit(0)))


def present(a: Column) -> Column:
    return F.size(F.array_compact(a)).cast("long")


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x evaluated once, however often lambdas in body read it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def moving(plane: Column, r: int, h: Column, w: Column, fold: Callable[[Column], Column], again: Callable[[Column], Column] | None = None) -> Column:
    """fold over the square of radius r around each of h x w pixels of a plane with margins of r: along rows, then (by again, fold if none) along columns."""
    flat = F.transform(plane, lambda row: F.transform(_range(w), lambda j: fold(F.slice(row, j + 1, F.lit(2 * r + 1)))))
    return let(flat, lambda f: F.transform(_range(h), lambda i: let(F.slice(f, i + 1, F.lit(2 * r + 1)), lambda rows: F.transform(_range(w), lambda j: (again or fold)(F.transform(rows, lambda row: F.get(row, j)))))))


def each(h: Column, w: Column, value: Callable[[Column, Column], Column]) -> Column:
    """value(i, j) for each of h x w pixels; planes that it reads are bound by let()."""
    return F.transform(_range(h), lambda i: F.transform(_range(w), lambda j: value(i, j)))


def at(plane: Column, i: Column, j: Column) -> Column:
    return F.get(F.get(plane, i), j)


def square(plane: Column, i: Column, j: Column) -> Column:
    """The 3 x 3 values around pixel (i, j) of a plane with margins of 1, row by row."""
    return F.flatten(F.transform(F.slice(plane, i + 1, F.lit(3)), lambda row: F.slice(row, j + 1, F.lit(3))))


def core(plane: Column, k: int, h: Column, w: Column) -> Column:
    """A plane without k pixels of its margins: h x w of it."""
    return F.transform(F.slice(plane, F.lit(k + 1), h), lambda row: F.slice(row, F.lit(k + 1), w))


def sobel(plane: Column, h: Column, w: Column) -> Column:
    """Gradient magnitude of a plane with margins of 1: a quarter of the Sobel sums' length, 0 to 255; 0 at the frame's border."""

    def value(s: Column) -> Column:
        v = [F.get(s, F.lit(k)) for k in range(9)]
        gx = (v[2] + 2 * v[5] + v[8] - v[0] - 2 * v[3] - v[6]).cast("double")
        gy = (v[6] + 2 * v[7] + v[8] - v[0] - 2 * v[1] - v[2]).cast("double")
        size = F.floor(F.sqrt(gx * gx + gy * gy) / 4 + 0.5)
        return F.when(size.isNull(), 0).otherwise(F.least(F.lit(255), size)).cast("long")

    return let(plane, lambda p: each(h, w, lambda i, j: let(square(p, i, j), value)))


def nearest(plane: Column, other: Column, h: Column, w: Column) -> Column:
    """For each pixel of a plane the least difference to other's 3 x 3 pixels around it; both have margins of 1, nulls count as missing."""
    return let(plane, lambda p: let(other, lambda o: each(h, w, lambda i, j: let(at(p, i + 1, j + 1), lambda v: F.array_min(F.transform(square(o, i, j), lambda u: F.abs(v - u)))))))


def eroded(mask: Column, h: Column, w: Column) -> Column:
    """Minimum of the 3 x 3 square; 0 next to what is beyond the frame, null beyond it."""
    value = lambda s: F.when(F.exists(s, lambda v: v.isNull()), F.lit(0)).otherwise(F.array_min(s))
    return let(mask, lambda m: each(h, w, lambda i, j: F.when(at(m, i + 1, j + 1).isNotNull(), let(square(m, i, j), value))))


def dilated(mask: Column, h: Column, w: Column) -> Column:
    return let(mask, lambda m: each(h, w, lambda i, j: F.when(at(m, i + 1, j + 1).isNotNull(), F.array_max(square(m, i, j)))))


def pixels(done: DataFrame, keys: list[str], values: list[str], side: int = SIDE) -> DataFrame:
    """Tiles without margins as rows of pixels (keys, y, x, values), for results that ask for them."""
    lines = done.select(*keys, "ty", "tx", F.posexplode(F.arrays_zip(*values)).alias("_i", "_r"))
    dots = lines.select(*keys, "ty", "tx", "_i", F.posexplode(F.arrays_zip(*(F.col(f"_r.{v}").alias(v) for v in values))).alias("_j", "_v"))
    return dots.select(*keys, (F.col("ty") * side + F.col("_i")).cast("long").alias("y"), (F.col("tx") * side + F.col("_j")).cast("long").alias("x"), *(F.col(f"_v.{v}").alias(v) for v in values))
