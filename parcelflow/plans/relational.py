"""Parcel and alert reporting: scans, searches, nested includes, counts, trends, export, writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.plans.registry import query
from parcelflow.sources import tables as T

WITH = f"WITH {T.SQL}\n"
OPEN = "('NEW', 'UNDER_REVIEW', 'FIELD_INSPECTION')"
MONTH = "yyyy-MM"


@query("dashboard_stats", WITH + f"""
SELECT (SELECT count(*) FROM parcels) AS total_parcels, count(*) AS total_alerts, count(*) FILTER (status IN {OPEN}) AS pending, count(*) FILTER (status = 'RESOLVED') AS resolved FROM alerts""")
def dashboard_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counters in one pass over alerts and one over parcels."""
    n = T.parcels(spark, d).agg(F.count(F.lit(1)).alias("total_parcels"))
    return n.crossJoin(T.alerts(spark, d).agg(
        F.count(F.lit(1)).alias("total_alerts"), F.count_if(F.col("status").isin(*T.OPEN_STATUSES)).alias("pending"), F.count_if(F.col("status") == "RESOLVED").alias("resolved")
    ))


def _trend(spark: SparkSession, d: str) -> DataFrame:
    return T.alerts(spark, d).groupBy(F.date_format("detected_at", MONTH).alias("month")).agg(F.count(F.lit(1)).alias("alerts"))


_TREND = "trend AS (SELECT strftime(detected_at, '%Y-%m') AS month, count(*) AS alerts FROM alerts GROUP BY 1)"


@query("monthly_trend", WITH + f", {_TREND} SELECT * FROM trend ORDER BY month")
def monthly_trend(spark: SparkSession, d: str) -> DataFrame:
    return _trend(spark, d).orderBy("month")


@query("trend_delta", WITH + f""", {_TREND}
SELECT month, alerts, CASE WHEN coalesce(lag(alerts) OVER w, 0) = 0 THEN 0 ELSE floor((alerts - lag(alerts) OVER w) * 100.0::DOUBLE / lag(alerts) OVER w + 0.5)::BIGINT END AS delta_pct FROM trend WINDOW w AS (ORDER BY month)""")
def trend_delta(spark: SparkSession, d: str) -> DataFrame:
    """Period over period; the number of months is small whatever the alerts."""
    before = F.lag("alerts").over(Window.orderBy("month"))
    share = F.floor((F.col("alerts") - before) * F.lit(100.0) / before + 0.5).cast("long")
    return _trend(spark, d).select("month", "alerts", F.when(F.coalesce(before, F.lit(0)) == 0, F.lit(0).cast("long")).otherwise(share).alias("delta_pct"))


@query("rates_and_peak", WITH + f""", {_TREND},
c AS (SELECT count(*) FILTER (status IN {OPEN}) AS p, count(*) FILTER (status = 'RESOLVED') AS r, count(*) AS n FROM alerts)
SELECT CASE WHEN p + r > 0 THEN floor(100.0::DOUBLE * r / (p + r) + 0.5)::BIGINT ELSE 0 END AS resolution_rate,
  CASE WHEN (SELECT count(*) FROM parcels) > 0 THEN round(100.0::DOUBLE * n / (SELECT count(*) FROM parcels), 1) ELSE 0 END AS change_rate,
  (SELECT month FROM trend ORDER BY alerts DESC, month LIMIT 1) AS peak_month FROM c""")
def rates_and_peak(spark: SparkSession, d: str) -> DataFrame:
    both = F.col("pending") + F.col("resolved")
    peak = _trend(spark, d).agg(F.min_by("month", F.struct(-F.col("alerts"), F.col("month"))).alias("peak_month"))
    return dashboard_stats(spark, d).crossJoin(peak).select(
        F.when(both > 0, F.floor(F.lit(100.0) * F.col("resolved") / both + 0.5)).otherwise(0).cast("long").alias("resolution_rate"),
        F.when(F.col("total_parcels") > 0, F.round(F.lit(100.0) * F.col("total_alerts") / F.col("total_parcels"), 1)).otherwise(0.0).alias("change_rate"), "peak_month",
    )


def search(parcels: DataFrame, text: str) -> DataFrame:
    """Any of four columns contains the trimmed text, whatever its case; an empty text finds all."""
    text = text.strip().lower()
    if not text:
        return parcels
    return parcels.where(reduce(lambda a, b: a | b, [F.lower(F.col(c)).contains(text) for c in ("parcel_id", "owner_name", "street_name", "house_number")]))


@query("parcel_search", WITH + """
SELECT p.parcel_id, p.owner_name, p.street_name, concat_ws(', ', p.house_number, p.street_name, p.hamlet) AS address, count(b.building_key) AS n_buildings, coalesce(sum(b.floors), 0)::BIGINT AS floors
FROM parcels p LEFT JOIN buildings b USING (parcel_key)
WHERE contains(lower(parcel_id), 'mach') OR contains(lower(owner_name), 'mach') OR contains(lower(street_name), 'mach') OR contains(lower(house_number), 'mach')
GROUP BY ALL ORDER BY parcel_id""")
def parcel_search(spark: SparkSession, d: str) -> DataFrame:
    """Search with nested buildings; an empty list stays."""
    found = search(T.parcels(spark, d), " MACH ")
    own = T.buildings(spark, d).join(found.select("parcel_key"), "parcel_key", "left_semi").groupBy("parcel_key").agg(F.collect_list(F.struct("building_key", "floors", "footprint_m2")).alias("buildings"))
    found = found.join(own, "parcel_key", "left")
    floors = F.aggregate("buildings", F.lit(0).cast("long"), lambda a, b: a + b["floors"])
    return found.select(
        "parcel_id", "owner_name", "street_name", F.concat_ws(", ", "house_number", "street_name", "hamlet").alias("address"),
        F.coalesce(F.size("buildings"), F.lit(0)).cast("long").alias("n_buildings"), F.coalesce(floors, F.lit(0)).alias("floors"),
    ).orderBy("parcel_id")


@query("alerts_by_type", WITH + """
SELECT alert_key, type, status, confidence_pct, detected_at FROM alerts WHERE type = 'ROAD_CHANGE' ORDER BY detected_at DESC, alert_key""")
def alerts_by_type(spark: SparkSession, d: str, kind: str = "ROAD_CHANGE") -> DataFrame:
    rows = T.alerts(spark, d).select("alert_key", "type", "status", "confidence_pct", "detected_at")
    return (rows.where(F.col("type") == kind) if kind else rows).orderBy(F.desc("detected_at"), "alert_key")


@query("narrow_scan", WITH + "SELECT detected_at FROM alerts ORDER BY detected_at")
def narrow_scan(spark: SparkSession, d: str) -> DataFrame:
    return T.alerts(spark, d).select("detected_at").orderBy("detected_at")


@query("point_lookup", WITH + "SELECT * FROM alerts WHERE alert_key = 42")
def point_lookup(spark: SparkSession, d: str, key: int = 42) -> DataFrame:
    """The filter reaches the scan as a predicate on the key."""
    return T.alerts(spark, d).where(F.col("alert_key") == key)


@query("alert_detail", WITH + """,
n AS (SELECT alert_key, count(*) AS n_notes, max(created_at) AS last_note_at, arg_max(author, (created_at, author)) AS last_author FROM notes GROUP BY 1)
SELECT a.alert_key, a.type, p.parcel_id, p.owner_name, d.department_name, coalesce(n_notes, 0) AS n_notes, last_note_at, last_author
FROM alerts a JOIN parcels p USING (parcel_key) JOIN departments d ON d.department_id = a.department_id LEFT JOIN n USING (alert_key)""")
def alert_detail(spark: SparkSession, d: str) -> DataFrame:
    """Two N:1 includes and one ordered 1:N include, summed up before the join so rows don't multiply."""
    notes = T.notes(spark, d).groupBy("alert_key").agg(
        F.count(F.lit(1)).alias("n_notes"), F.max("created_at").alias("last_note_at"), F.max_by("author", F.struct("created_at", "author")).alias("last_author")
    )
    rows = T.alerts(spark, d).join(T.parcels(spark, d).select("parcel_key", "parcel_id", "owner_name"), "parcel_key")
    rows = rows.join(T.departments(spark, d), "department_id").join(notes, "alert_key", "left")
    return rows.select("alert_key", "type", "parcel_id", "owner_name", "department_name", F.coalesce("n_notes", F.lit(0)).alias("n_notes"), "last_note_at", "last_author")


@query("monthly_report", WITH + """
SELECT type, department_name, count(*) AS alerts FROM alerts JOIN departments USING (department_id) JOIN parcels USING (parcel_key)
GROUP BY GROUPING SETS ((type), (department_name), ())""")
def monthly_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts by type, by department and in all; over all time, as the report has it."""
    rows = T.alerts(spark, d).join(T.parcels(spark, d).select("parcel_key"), "parcel_key").join(T.departments(spark, d), "department_id")
    return rows.groupingSets([["type"], ["department_name"], []], "type", "department_name").agg(F.count(F.lit(1)).alias("alerts")).select("type", "department_name", "alerts")


def csv_cell(c) -> F.Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


@query("alerts_export", WITH + """
SELECT a.alert_key, '"' || concat_ws('","', a.alert_key, a.type, a.status, a.confidence_pct, replace(p.parcel_id, '"', '""'), replace(p.owner_name, '"', '""'), replace(d.department_name, '"', '""'), p.house_number || ' ' || p.street_name || ', ' || p.hamlet,
  strftime(a.detected_at, '%Y-%m-%dT%H:%M:%S.000Z')) || '"' AS line
FROM alerts a JOIN parcels p USING (parcel_key) JOIN departments d ON d.department_id = a.department_id ORDER BY a.detected_at DESC, a.alert_key""")
def alerts_export(spark: SparkSession, d: str) -> DataFrame:
    rows = T.alerts(spark, d).join(T.parcels(spark, d).select("parcel_key", "parcel_id", "owner_name", "house_number", "street_name", "hamlet"), "parcel_key").join(T.departments(spark, d), "department_id")
    rows = rows.withColumn("location", F.concat("house_number", F.lit(" "), "street_name", F.lit(", "), "hamlet"))
    at = F.date_format("detected_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    cells = [csv_cell(F.col(c)) for c in ("alert_key", "type", "status", "confidence_pct", "parcel_id", "owner_name", "department_name", "location")]
    return rows.orderBy(F.desc("detected_at"), "alert_key").select("alert_key", F.concat_ws(",", *cells, csv_cell(at)).alias("line"))


# Department by type; labels and titles by type, labels by status.
ROUTES = {"LAND_USE_CHANGE": 1, "WATER_CANAL_ENCROACHMENT": 2, "ROAD_CHANGE": 3}
LABELS = {
    "NEW_BUILDING": "Công trình mới", "EXPANDED_BUILDING": "Mở rộng công trình", "POSSIBLE_ILLEGAL_CONSTRUCTION": "Nghi xây dựng không phép",
    "LAND_USE_CHANGE": "Thay đổi mục đích đất", "ROAD_CHANGE": "Thay đổi đường giao thông", "WATER_CANAL_ENCROACHMENT": "Lấn chiếm kênh rạch",
}
TITLES = {
    "NEW_BUILDING": "Phát hiện công trình mới", "EXPANDED_BUILDING": "Dấu hiệu mở rộng công trình", "POSSIBLE_ILLEGAL_CONSTRUCTION": "Nghi vấn xây dựng không phép",
    "LAND_USE_CHANGE": "Biến động mục đích sử dụng đất", "ROAD_CHANGE": "Thay đổi hạ tầng giao thông", "WATER_CANAL_ENCROACHMENT": "Nghi vấn lấn chiếm kênh rạch",
}
STATUS_LABELS = {"NEW": "Mới", "UNDER_REVIEW": "Đang rà soát", "FIELD_INSPECTION": "Kiểm tra thực địa", "RESOLVED": "Đã xử lý"}


def looked_up(values: dict, key: str) -> F.Column:
    """From a small fixed map; null for what it doesn't hold."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col(key)]


def _case(values: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


@query("department_routing", WITH + f"""
SELECT type, CASE type WHEN 'LAND_USE_CHANGE' THEN 1 WHEN 'WATER_CANAL_ENCROACHMENT' THEN 2 WHEN 'ROAD_CHANGE' THEN 3 ELSE 0 END AS department_index, coalesce({_case(LABELS, 'type')}, type) AS label, {_case(TITLES, 'type')} AS title,
  coalesce({_case(STATUS_LABELS, 'status')}, status) AS status_label, count(*) AS alerts FROM alerts GROUP BY ALL""")
def department_routing(spark: SparkSession, d: str) -> DataFrame:
    """Look-ups in small fixed maps; a missing label falls back to the code."""
    rows = T.alerts(spark, d).select(
        "type", F.coalesce(looked_up(ROUTES, "type"), F.lit(0)).alias("department_index"), F.coalesce(looked_up(LABELS, "type"), F.col("type")).alias("label"), looked_up(TITLES, "type").alias("title"),
        F.coalesce(looked_up(STATUS_LABELS, "status"), F.col("status")).alias("status_label"),
    )
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("alerts"))


@query("printable_report", WITH + f"SELECT type, coalesce({_case(LABELS, 'type')}, type) AS label, count(*) AS alerts FROM alerts GROUP BY 1, 2")
def printable_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts by type under the labels that readers see."""
    counts = T.alerts(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("alerts"))
    return counts.select("type", F.coalesce(looked_up(LABELS, "type"), F.col("type")).alias("label"), "alerts")


_FORM = """, form AS (SELECT parcel_id, house_number, street_name, hamlet, CASE WHEN parcel_key % 23 = 0 THEN ' ' ELSE (120 + parcel_key)::VARCHAR END AS land_lot_number, 'TBD-' || (1 + parcel_key % 4) AS map_sheet_number, owner_name, area_m2::VARCHAR AS area_m2,
  CASE WHEN parcel_key % 17 = 0 THEN NULL ELSE 'garden' END AS land_use_type, gps_lat_e4::VARCHAR AS gps_lat, CASE WHEN parcel_key % 19 = 0 THEN 'east' ELSE (parcel_key % 90)::VARCHAR END AS gps_lng FROM parcels)"""
REQUIRED = ("parcel_id", "house_number", "street_name", "hamlet", "land_lot_number", "map_sheet_number", "owner_name", "land_use_type")


@query("parcel_validation", WITH + _FORM + """
SELECT parcel_id, array_to_string(list_filter([""" + ", ".join(f"CASE WHEN coalesce(length({c}), 0) = 0 THEN '{c}' END" for c in REQUIRED) + """,
  CASE WHEN NOT coalesce(try_cast(area_m2 AS DOUBLE) > 0, false) THEN 'area_m2' END, CASE WHEN try_cast(gps_lat AS DOUBLE) IS NULL THEN 'gps_lat' END, CASE WHEN try_cast(gps_lng AS DOUBLE) IS NULL THEN 'gps_lng' END], lambda x: x IS NOT NULL), ',') AS errors FROM form""")
def parcel_validation(spark: SparkSession, d: str) -> DataFrame:
    """The rules of a new parcel as a list of the fields that break them, instead of exceptions: rejected rows stay for a quarantine."""
    k = F.col("parcel_key")
    form = T.parcels(spark, d).select(
        "parcel_id", "house_number", "street_name", "hamlet", F.when(k % 23 == 0, " ").otherwise((120 + k).cast("string")).alias("land_lot_number"), F.concat(F.lit("TBD-"), 1 + k % 4).alias("map_sheet_number"), "owner_name",
        F.col("area_m2").cast("string").alias("area_m2"), F.when(k % 17 != 0, "garden").alias("land_use_type"), F.col("gps_lat_e4").cast("string").alias("gps_lat"), F.when(k % 19 == 0, "east").otherwise((k % 90).cast("string")).alias("gps_lng"),
    )
    number = lambda c: F.col(c).try_cast("double")
    broken = {c: F.coalesce(F.length(c), F.lit(0)) == 0 for c in REQUIRED} | {"area_m2": ~F.coalesce(number("area_m2") > 0, F.lit(False)), "gps_lat": number("gps_lat").isNull(), "gps_lng": number("gps_lng").isNull()}
    return form.select("parcel_id", F.array_join(F.array_compact(F.array(*(F.when(v, F.lit(c)) for c, v in broken.items()))), ",").alias("errors"))


@query("parcel_patch", WITH + """,
patch AS (SELECT parcel_key, CASE WHEN parcel_key % 2 = 0 THEN 'New owner ' || parcel_key END AS owner_name, NULL::DOUBLE AS area_m2 FROM parcels WHERE parcel_key % 10 < 3)
SELECT p.parcel_id, coalesce(q.owner_name, p.owner_name) AS owner_name, coalesce(q.area_m2, p.area_m2) AS area_m2, q.parcel_key IS NOT NULL AS touched FROM parcels p LEFT JOIN patch q USING (parcel_key)""")
def parcel_patch(spark: SparkSession, d: str) -> DataFrame:
    """Partial update: a field that the patch leaves out keeps its value (copy on write)."""
    base, k = T.parcels(spark, d), F.col("parcel_key")
    patch = base.where(k % 10 < 3).select("parcel_key", F.when(k % 2 == 0, F.concat(F.lit("New owner "), k.cast("string"))).alias("new_owner"), F.lit(None).cast("double").alias("new_area"), F.lit(True).alias("hit"))
    return base.join(patch, "parcel_key", "left").select("parcel_id", F.coalesce("new_owner", "owner_name").alias("owner_name"), F.coalesce("new_area", "area_m2").alias("area_m2"), F.coalesce("hit", F.lit(False)).alias("touched"))


_IMAGES = """, images AS (
  SELECT l_orderkey AS alert_key, CASE r % 2 WHEN 1 THEN 'before' ELSE 'after' END AS kind, l_shipdate AS captured_at FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber) AS r FROM lineitem))"""


def images(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber")
    rows = T.read(spark, d, "lineitem").withColumn("r", F.row_number().over(order))
    return rows.select(F.col("l_orderkey").alias("alert_key"), F.when(F.col("r") % 2 == 1, "before").otherwise("after").alias("kind"), F.col("l_shipdate").alias("captured_at"))


@query("image_pick", WITH + _IMAGES + """
SELECT alert_key, min(captured_at) FILTER (kind = 'before') AS before_at, min(captured_at) FILTER (kind = 'after') AS after_at,
  coalesce(min(captured_at) FILTER (kind = 'after') > min(captured_at) FILTER (kind = 'before'), false) AS usable FROM images GROUP BY 1""")
def image_pick(spark: SparkSession, d: str) -> DataFrame:
    """The first image of each kind; a pair is usable if the later is strictly later."""
    at = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("captured_at")))
    rows = images(spark, d).groupBy("alert_key").agg(at("before").alias("before_at"), at("after").alias("after_at"))
    return rows.withColumn("usable", F.coalesce(F.col("after_at") > F.col("before_at"), F.lit(False)))


@query("replace_images", WITH + _IMAGES + """,
fresh AS (SELECT DISTINCT alert_key, unnest(['before', 'after']) AS kind, TIMESTAMP '2030-01-01' AS captured_at FROM images WHERE alert_key % 50 = 0)
SELECT * FROM images i WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.alert_key = i.alert_key AND f.kind = i.kind) UNION ALL SELECT * FROM fresh""")
def replace_images(spark: SparkSession, d: str) -> DataFrame:
    """Delete and insert as one new state: what isn't replaced, and the replacement."""
    old = images(spark, d)
    fresh = old.where("alert_key % 50 = 0").select("alert_key").distinct().select("alert_key", F.explode(F.array(F.lit("before"), F.lit("after"))).alias("kind"), F.expr("timestamp_ntz'2030-01-01'").alias("captured_at"))
    return old.join(fresh, ["alert_key", "kind"], "left_anti").unionByName(fresh)


@query("alert_writeback", WITH + """
SELECT alert_key, CASE WHEN alert_key % 7 = 0 THEN 'UNDER_REVIEW' ELSE status END AS status, CASE WHEN alert_key % 7 = 0 THEN 91 ELSE confidence_pct END AS confidence_pct FROM alerts""")
def alert_writeback(spark: SparkSession, d: str) -> DataFrame:
    """An analysis sets status and confidence of its alerts; any status may follow any other."""
    hit = F.col("alert_key") % 7 == 0
    return T.alerts(spark, d).select("alert_key", F.when(hit, "UNDER_REVIEW").otherwise(F.col("status")).alias("status"), F.when(hit, 91).otherwise(F.col("confidence_pct")).alias("confidence_pct"))


@query("note_insert", WITH + """
SELECT alert_key, author, count(*) AS notes FROM (SELECT alert_key, author FROM notes UNION ALL SELECT alert_key, 'Duty officer' FROM alerts WHERE alert_key % 100 = 3) GROUP BY 1, 2""")
def note_insert(spark: SparkSession, d: str) -> DataFrame:
    """Append with a default author."""
    new = T.alerts(spark, d).where("alert_key % 100 = 3").select("alert_key", F.coalesce(F.lit(None).cast("string"), F.lit("Duty officer")).alias("author"))
    return T.notes(spark, d).select("alert_key", "author").unionByName(new).groupBy("alert_key", "author").agg(F.count(F.lit(1)).alias("notes"))


@query("json_response", WITH + "SELECT alert_key, to_json({'alert_key': alert_key, 'type': type, 'status': status}) AS body FROM alerts WHERE status = 'NEW'")
def json_response(spark: SparkSession, d: str) -> DataFrame:
    return T.alerts(spark, d).where("status = 'NEW'").select("alert_key", F.to_json(F.struct("alert_key", "type", "status")).alias("body"))


@query("group_count_map", WITH + "SELECT status, to_json(map_from_entries(list((type, n) ORDER BY type))) AS counts FROM (SELECT status, type, count(*) AS n FROM alerts GROUP BY 1, 2) GROUP BY 1")
def group_count_map(spark: SparkSession, d: str) -> DataFrame:
    rows = T.alerts(spark, d).groupBy("status", "type").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("status").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n"))))).alias("counts"))


@query("alert_includes", WITH + _IMAGES + """,
n AS (SELECT alert_key, string_agg(author, ';' ORDER BY created_at DESC, author) AS notes FROM notes GROUP BY 1), i AS (SELECT alert_key, string_agg(kind, ';' ORDER BY captured_at, kind) AS images FROM images GROUP BY 1)
SELECT alert_key, type, coalesce(notes, '') AS notes, coalesce(images, '') AS images FROM alerts LEFT JOIN n USING (alert_key) LEFT JOIN i USING (alert_key)""")
def alert_includes(spark: SparkSession, d: str) -> DataFrame:
    """An alert with all its notes, newest first, and all its images, oldest first; each list is made before the join."""
    notes = T.notes(spark, d).groupBy("alert_key").agg(F.collect_list(F.struct("created_at", "author")).alias("n"))
    later = lambda a, b: F.when(a["created_at"] > b["created_at"], -1).when(a["created_at"] < b["created_at"], 1).when(a["author"] < b["author"], -1).when(a["author"] > b["author"], 1).otherwise(0)
    shots = images(spark, d).groupBy("alert_key").agg(F.sort_array(F.collect_list(F.struct("captured_at", "kind"))).alias("i"))
    rows = T.alerts(spark, d).select("alert_key", "type").join(notes, "alert_key", "left").join(shots, "alert_key", "left")
    text = lambda c, f: F.coalesce(F.array_join(F.transform(c, lambda x: x[f]), ";"), F.lit(""))
    return rows.select("alert_key", "type", text(F.array_sort("n", later), "author").alias("notes"), text(F.col("i"), "kind").alias("images"))


@query("analysis_writeback", WITH + """,
r AS (SELECT alert_key, alert_key % 3 AS regions, (60 + alert_key % 40) AS confidence FROM alerts WHERE alert_key % 7 = 0),
n AS (SELECT alert_key, count(*) AS notes FROM (SELECT alert_key FROM notes UNION ALL SELECT alert_key FROM r) GROUP BY 1)
SELECT a.alert_key, CASE WHEN r.alert_key IS NULL THEN a.status ELSE 'UNDER_REVIEW' END AS status, coalesce(r.confidence, a.confidence_pct) AS confidence_pct, coalesce(n.notes, 0) AS notes,
  CASE WHEN r.regions > 0 THEN 'Analysis done. Regions: ' || r.regions || '. Severity: low.' WHEN r.regions = 0 THEN 'Analysis done. Severity: low.' END AS note FROM alerts a LEFT JOIN r USING (alert_key) LEFT JOIN n USING (alert_key)""")
def analysis_writeback(spark: SparkSession, d: str) -> DataFrame:
    """An analysis puts its alert under review with a new confidence and appends a note, which names regions if there are any."""
    k = F.col("alert_key")
    base = T.alerts(spark, d)
    result = base.where(k % 7 == 0).select("alert_key", (k % 3).alias("regions"), (60 + k % 40).alias("confidence"))
    text = F.when(F.col("regions") > 0, F.concat(F.lit("Analysis done. Regions: "), "regions", F.lit(". Severity: low."))).otherwise("Analysis done. Severity: low.")
    fresh = result.select("alert_key", text.alias("note"))
    notes = T.notes(spark, d).select("alert_key").unionByName(fresh.select("alert_key")).groupBy("alert_key").agg(F.count(F.lit(1)).alias("notes"))
    rows = base.join(result, "alert_key", "left").join(fresh, "alert_key", "left").join(notes, "alert_key", "left")
    return rows.select("alert_key", F.when(F.col("regions").isNotNull(), "UNDER_REVIEW").otherwise(F.col("status")).alias("status"), F.coalesce("confidence", "confidence_pct").alias("confidence_pct"), F.coalesce("notes", F.lit(0)).alias("notes"), "note")
