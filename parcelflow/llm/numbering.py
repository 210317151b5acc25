"""Positions of rows within their group, by range partitions: no group is one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.llm.store import Scratch


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_pos becomes a row's place among the rows of its _g in this task; equal _g lie together."""
    last, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column("_g")
        new = np.ones(len(g), bool)
        new[1:] = pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)
        new[0] = last is None or g[0].as_py() != last
        at = np.arange(len(g))
        start = np.maximum.accumulate(np.where(new, at, -1))
        pos = np.where(start >= 0, at - start, at + n)
        last, n = g[-1].as_py(), int(pos[-1]) + 1
        yield batch.set_column(batch.schema.get_field_index("_pos"), "_pos", pa.array(pos, pa.int64()))


def numbered(scratch: Scratch, name: str, df: DataFrame, order: list[str], cuts: list[Column], keep: list[str]) -> DataFrame:
    """_g, keep and _pos: the row's place (from 0) among the rows of its _g by order (nulls first).

    _g must not be null. cuts: what the range partitions are cut by besides _g: columns that never
    fall along order, short ones, as samples of them reach the driver. Rows are sorted within range
    partitions and numbered there; a group that began in earlier partitions (one at most a
    partition) gets what they hold of it added. The rows come sorted by (_g, order) within a task.
    """
    n = width(scratch.spark)
    rows = df.repartitionByRange(n, "_g", *cuts).sortWithinPartitions("_g", *order)
    rows = rows.select("_g", *keep, F.spark_partition_id().alias("_part"), F.lit(0).cast("long").alias("_pos"))
    rows = scratch.put(rows.mapInArrow(_local, rows.schema), name)
    seen = rows.groupBy("_g", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    begun = seen.withColumn("_before", before).where("_before > 0").select(F.col("_g").alias("_bg"), F.col("_part").alias("_bpart"), "_before")
    rows = rows.join(F.broadcast(begun), (F.col("_part") == F.col("_bpart")) & (F.col("_g") == F.col("_bg")), "left")
    return rows.select("_g", *keep, (F.col("_pos") + F.coalesce("_before", F.lit(0))).alias("_pos"))


def crc32_sql(x: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII string: bytes and eight shifts each, from left to right."""
    steps = f"list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({x}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"xor(list_reduce({steps}, lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"
