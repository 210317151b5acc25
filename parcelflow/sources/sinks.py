"""Writers: exports, debug runs, reports, inserts and truncation of stored entities, all by Spark's writers."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The entities in the order in which they can be emptied, and half the side of a default parcel in degrees.
ENTITIES = ("inspection_notes", "satellite_images", "alerts", "buildings", "parcels", "inspectors", "departments", "users")
HALF = 0.00035


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """A header and all cells in quotes; quotes inside are doubled, nulls are empty; one folder of files, rows in their order."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]
    rows.select(*cells).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_json(report: DataFrame, path: str) -> None:
    """A report, one object a line; nulls are written."""
    report.write.mode("overwrite").option("ignoreNullFields", False).json(path)


class DebugRun:
    """Stages of a run as Parquet tables below a folder of its own; off by default, then nothing is written."""

    def __init__(self, folder: str, on: bool = False):
        self.path = f"{folder}/{datetime.now(timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}" if on else None

    def stage(self, rows: DataFrame, name: str) -> DataFrame:
        """rows, also written (then read back, so that the stage isn't computed twice)."""
        if self.path is None:
            return rows
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return rows.sparkSession.read.schema(rows.schema).parquet(f"{self.path}/{name}")


def with_default_polygon(parcels: DataFrame) -> DataFrame:
    """parcels (lat, lng, polygon or null); a missing polygon is a square around the point."""
    ring = F.array(*(F.struct((F.col("lat") + dy * HALF).alias("lat"), (F.col("lng") + dx * HALF).alias("lng")) for dy, dx in ((-1, -1), (-1, 1), (1, 1), (1, -1))))
    return parcels.withColumn("polygon", F.coalesce("polygon", ring))


BUCKETS = 16


def write_batch(rows: DataFrame, key: str, path: str, batch: str) -> None:
    """Writes the rows of one batch below path, in folders by batch and bucket of the key.

    Only this batch's folders are overwritten, so a rerun of a failed or repeated job leaves no row
    twice, and nothing that other batches have written is touched. Buckets of the batch that no
    longer have rows are left as they were: a batch's name stands for its input.
    """
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int")
    out = rows.withColumn("batch", F.lit(batch)).withColumn("bucket", bucket)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(path)


def winners(rows: DataFrame, key: str, newest: bool) -> DataFrame:
    """One row of each key: that of the first batch (or the newest), of equals the one whose columns come first in order."""
    own = [c for c in rows.columns if c not in ("batch", "bucket")]
    best = F.col("batch").desc() if newest else F.col("batch").asc()
    told = [F.to_json(F.struct(*own)).asc()]
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(best, *told))).where("_r = 1").select(*own)


def stored(spark: SparkSession, path: str, like: str, key: str, newest: bool = False) -> DataFrame:
    """The stored rows (schema: like), one of each key: the first batch's (inserts) or the newest's (patches, write-backs)."""
    return winners(stored_table(spark, path, spark.createDataFrame([], f"{like}, batch string, bucket int")), key, newest)


def upsert(rows: DataFrame, key: str, path: str, batch: str) -> None:
    """Rows that replace those of their key from earlier batches (by name) when they are read with newest; of two rows of one key the first in order."""
    write_batch(winners(rows.withColumn("batch", F.lit(batch)), key, True), key, path, batch)


def insert_parcels(parcels: DataFrame, path: str, batch: str = "0") -> DataFrame:
    """Inserts valid rows (parcel_id, owner_name, area_m2, lat, lng, polygon) that are new by parcel_id; returns those refused, with errors.

    Of several rows of one parcel_id the first in the order of all columns is taken; batches count in the
    order of their names. Inserting a batch again changes nothing.
    """
    spark = parcels.sparkSession
    rules = {
        "parcel_id": F.coalesce(F.length(F.trim("parcel_id")), F.lit(0)) > 0, "owner_name": F.coalesce(F.length(F.trim("owner_name")), F.lit(0)) > 0, "area_m2": F.coalesce(F.col("area_m2") > 0, F.lit(False)),
        "lat": F.coalesce(F.col("lat").between(-90, 90), F.lit(False)), "lng": F.coalesce(F.col("lng").between(-180, 180), F.lit(False)),
    }
    rows = with_default_polygon(parcels).withColumn("errors", F.array_compact(F.array(*(F.when(~ok, F.lit(k)) for k, ok in rules.items()))))
    good = winners(rows.where(F.size("errors") == 0).drop("errors").withColumn("batch", F.lit(batch)), "parcel_id", False)
    known = stored_table(spark, path, good.withColumn("batch", F.lit("")).withColumn("bucket", F.lit(0)))
    write_batch(good.join(known.where(F.col("batch") != batch).select("parcel_id").distinct(), "parcel_id", "left_anti").select(*good.columns), "parcel_id", path, batch)
    return rows.where(F.size("errors") > 0)


def stored_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The stored rows; none if nothing is stored yet."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], like.schema)
    return spark.read.schema(like.schema).parquet(path)


def truncate(spark: SparkSession, root: str, schemas: dict[str, str]) -> list[str]:
    """Empties the given entities (schemas by name) below root, those that refer to others first; returns their order."""
    order = [e for e in ENTITIES if e in schemas] + sorted(set(schemas) - set(ENTITIES))
    for e in order:
        spark.createDataFrame([], schemas[e]).write.mode("overwrite").parquet(f"{root}/{e}")
    return order
