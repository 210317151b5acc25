"""Shared scratch tables, code shipping and reading of input tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.sources.shipping import ship

__all__ = ["NULL_ID", "Scratch", "given_id", "known_id", "packed", "shared_dir", "ship", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stands for a null doc_id inside operators that need an order: it comes first.
NULL_ID = -(1 << 63)


def known_id(c: str = "doc_id") -> Column:
    return F.coalesce(F.col(c).cast("long"), F.lit(NULL_ID))


def given_id(c: str = "doc_id") -> Column:
    return F.nullif(F.col(c), F.lit(NULL_ID).cast("long"))


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """All columns as one struct _row, so that no name clashes with an operator's own, and more."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *more)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or (unset, in one process) an own one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """Tables of one query below the shared folder; they go when the application ends or by drop()."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        ship(spark)
        fs, path = self._fs(self.root)
        fs.deleteOnExit(path)

    def _fs(self, p: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(p)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def put(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Writes df (in folders by a column, if asked) and reads it back: cuts the lineage and survives lost executors."""
        path = f"{self.root}/{name}"
        out = df.write.mode("overwrite").option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        fs, path = self._fs(f"{self.root}/{name}")
        fs.delete(path, True)
