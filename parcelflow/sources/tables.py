"""Entities of parcel monitoring as views over the driver's tables.

Each adapter is one narrow projection, so Spark prunes columns and pushes filters to the
scan. ``SQL`` has the same views as common table expressions for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Enumerations of the data model, in declaration order.
ALERT_TYPES = ("NEW_BUILDING", "EXPANDED_BUILDING", "POSSIBLE_ILLEGAL_CONSTRUCTION", "LAND_USE_CHANGE", "ROAD_CHANGE", "WATER_CANAL_ENCROACHMENT")
ALERT_STATUSES = ("NEW", "UNDER_REVIEW", "FIELD_INSPECTION", "RESOLVED")
OPEN_STATUSES = ALERT_STATUSES[:3]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files, as they lie compressed, for one partition of its shuffle.
PART_BYTES = 8 << 20


def gathered(rows: DataFrame, *keys: str) -> DataFrame:
    """rows, those of equal keys in one partition; larger inputs make more partitions, so a task's share doesn't grow with them.

    A number given isn't coalesced to that of cores again; more than the cores are given from so many parts on.
    """
    spark = rows.sparkSession
    size = int(str(rows._jdf.queryExecution().analyzed().collectLeaves().head().stats().sizeInBytes()))
    n = -(-size // PART_BYTES)
    return rows.repartition(max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys) if n > spark.sparkContext.defaultParallelism else rows.repartition(*keys)


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def departments(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("department_id"), F.col("n_name").alias("department_name"))


def parcels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(
        k.alias("parcel_key"), F.format_string("P-%09d", k).alias("parcel_id"), (k % 97 + 1).cast("string").alias("house_number"),
        F.col("c_mktsegment").alias("street_name"), F.concat(F.lit("Hamlet "), (k % 5).cast("string")).alias("hamlet"), F.col("c_name").alias("owner_name"),
        F.col("c_acctbal").alias("area_m2"), (k % 2400).alias("gps_lat_e4"), F.col("c_nationkey").alias("department_id"),
    )


def buildings(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "customer").agg(F.count(F.lit(1)).alias("_n"))
    return read(spark, d, "part").crossJoin(n).select(
        F.col("p_partkey").alias("building_key"), (F.col("p_partkey") % F.col("_n")).alias("parcel_key"), (F.col("p_size") % 4 + 1).alias("floors"), F.col("p_retailprice").alias("footprint_m2")
    )


def alerts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select(
        k.alias("alert_key"), pick(ALERT_TYPES, k % 6).alias("type"), pick(ALERT_STATUSES, k % 4).alias("status"), (72 + (k % 5) * 5).alias("confidence_pct"),
        F.col("o_custkey").alias("parcel_key"), (k % 25).alias("department_id"), F.col("o_orderdate").alias("detected_at"),
    )


def notes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("alert_key"), F.concat(F.lit("Inspector "), F.col("l_suppkey").cast("string")).alias("author"), F.col("l_shipdate").alias("created_at")
    )


def proposals(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a pair in native pixels (frame 1000 x 1000), several a pair; of equal ids the least row."""
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    small = (p % 7 == 0) & (s % 2 == 0)
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("pair_id"), "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_returnflag")
    return gathered(rows, "pair_id").select(  # few numbers are sent, and what follows by pair needs no other exchange
        "pair_id", (p * 1000000 + s * 100 + n).alias("proposal_id"),
        ((p * 37) % 500).alias("left"), ((s * 53 + p) % 500).alias("top"),
        F.when(small, 12 + p % 9).otherwise(60 + p % 180).alias("width"), F.when(small, 9 + s % 7).otherwise(50 + s % 160).alias("height"),
        F.round(F.col("l_discount") * 1000 + p % 97).cast("long").alias("confidence_e3"), pick(("building", "road", "removed shed", "vegetation"), p % 4).alias("change_type"),
        pick(("deterministic", "frontier_global", "frontier_tile", "deterministic_and_frontier"), (p + s) % 4).alias("source"), small.alias("small_object"), F.col("l_returnflag").alias("flag"),
        F.when(s % 31 == 0, "old shed").otherwise("open field").alias("before_text"), F.when(p % 37 == 0, "shed demolished").otherwise("field with house").alias("after_text"), ((p + s) % 50).cast("double").alias("removal"),
    ).withColumn("removal", F.col("removal") / 100).groupBy("pair_id", "proposal_id").agg(F.min(F.struct("left", "top", "width", "height", "confidence_e3", "change_type", "source", "small_object", "flag", "before_text", "after_text", "removal")).alias("p")).select("pair_id", "proposal_id", "p.*")


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


SQL = f"""
departments AS (SELECT n_nationkey AS department_id, n_name AS department_name FROM nation),
parcels AS (
  SELECT c_custkey AS parcel_key, printf('P-%09d', c_custkey) AS parcel_id, (c_custkey % 97 + 1)::VARCHAR AS house_number, c_mktsegment AS street_name,
         'Hamlet ' || (c_custkey % 5) AS hamlet, c_name AS owner_name, c_acctbal AS area_m2, c_custkey % 2400 AS gps_lat_e4, c_nationkey AS department_id FROM customer),
buildings AS (
  SELECT p_partkey AS building_key, p_partkey % (SELECT count(*) FROM customer) AS parcel_key, p_size % 4 + 1 AS floors, p_retailprice AS footprint_m2 FROM part),
alerts AS (
  SELECT o_orderkey AS alert_key, {_list(ALERT_TYPES)}[o_orderkey % 6 + 1] AS type, {_list(ALERT_STATUSES)}[o_orderkey % 4 + 1] AS status,
         72 + (o_orderkey % 5) * 5 AS confidence_pct, o_custkey AS parcel_key, o_orderkey % 25 AS department_id, o_orderdate AS detected_at FROM orders),
notes AS (SELECT l_orderkey AS alert_key, 'Inspector ' || l_suppkey AS author, l_shipdate AS created_at FROM lineitem),
proposals AS (
  SELECT DISTINCT ON (pair_id, proposal_id) * FROM (SELECT * FROM (
    SELECT l_orderkey AS pair_id, l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS proposal_id,
      (l_partkey * 37) % 500 AS "left", (l_suppkey * 53 + l_partkey) % 500 AS top,
      CASE WHEN l_partkey % 7 = 0 AND l_suppkey % 2 = 0 THEN 12 + l_partkey % 9 ELSE 60 + l_partkey % 180 END AS width,
      CASE WHEN l_partkey % 7 = 0 AND l_suppkey % 2 = 0 THEN 9 + l_suppkey % 7 ELSE 50 + l_suppkey % 160 END AS height,
      round(l_discount * 1000 + l_partkey % 97)::BIGINT AS confidence_e3, ['building', 'road', 'removed shed', 'vegetation'][l_partkey % 4 + 1] AS change_type,
      ['deterministic', 'frontier_global', 'frontier_tile', 'deterministic_and_frontier'][(l_partkey + l_suppkey) % 4 + 1] AS source,
      l_partkey % 7 = 0 AND l_suppkey % 2 = 0 AS small_object, l_returnflag AS flag,
      CASE WHEN l_suppkey % 31 = 0 THEN 'old shed' ELSE 'open field' END AS before_text, CASE WHEN l_partkey % 37 = 0 THEN 'shed demolished' ELSE 'field with house' END AS after_text, ((l_partkey + l_suppkey) % 50)::DOUBLE / 100 AS removal
    FROM lineitem) ORDER BY "left", top, width, height, confidence_e3, change_type, source, small_object, flag, before_text, after_text, removal))
"""
