"""The domain's tables as portable SQL over the star-schema and event tables: one text for Spark and for an SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_EVENTS = "(SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events) e"

ADAPTERS = {
    "detections": f"""SELECT CAST(user_id % 8 AS STRING) AS seq_id, event_id AS line_no,
 CAST((extract(day FROM ts)-1)*24 + extract(hour FROM ts) AS BIGINT) AS frame, user_id AS track_id, CAST(floor(value*2) AS INT) AS bb_left, k*5 AS bb_top, 10 + k%40 AS bb_width,
 CAST(8 + event_id%32 AS INT) AS bb_height, CAST(event_id%101 AS DOUBLE)/100 AS conf, CAST(user_id%75 AS INT) AS class_id, CAST(event_id%5 AS DOUBLE)/4 AS visibility,
 CASE event_type WHEN 'click' THEN 'Sus scrofa (Wild boar)' WHEN 'view' THEN 'Cervus elaphus (Red deer)' WHEN 'signup' THEN 'Capreolus capreolus (Roe deer)' ELSE 'Unknown' END AS species,
 CAST(user_id%3 AS STRING) AS gender, CAST(k%3 AS STRING) AS age, '0' AS is_propagated FROM {_EVENTS}""",
    "flights": """SELECT CAST(o_orderkey AS STRING) AS flight_key, CASE WHEN o_orderkey%7=0 THEN 'test' WHEN o_orderkey%7=1 THEN 'val' ELSE 'train' END AS split,
 CAST(o_orderkey%1126 AS INT) AS frame_count, CAST(o_custkey%64 AS INT) AS weather, o_orderdate AS start_time,
 CASE WHEN o_orderkey%3=0 THEN 'Matric 30 Thermal' ELSE 'Mavic 3 Thermal' END AS drone_name FROM orders""",
    "flight_species": """SELECT CAST(l_orderkey AS STRING) AS flight_key, wikidata_id, min(species_name) AS species_name,
 bool_or(l_returnflag='R') AS contains_occluded_frames, bool_or(l_linestatus='O') AS contains_unoccluded_frames, bool_or(l_suppkey%3=0) AS contains_unknown_sex, bool_or(l_suppkey%3=1) AS contains_male,
 bool_or(l_suppkey%3=2) AS contains_female, bool_or(l_linenumber%3=0) AS contains_unknown_age, bool_or(l_linenumber%3=1) AS contains_juvenile, bool_or(l_linenumber%3=2) AS contains_adult,
 CAST(count(*) AS INT) AS num_labels, CAST(sum(l_quantity) AS BIGINT) AS num_label_states
FROM (SELECT *, CASE l_partkey%4 WHEN 0 THEN 'Q58697' WHEN 1 THEN 'Q1219579' WHEN 2 THEN 'Q122069' ELSE 'Q24238356' END AS wikidata_id,
  CASE l_partkey%4 WHEN 0 THEN 'Sus scrofa (Wild boar)' WHEN 1 THEN 'Cervus elaphus (Red deer)' WHEN 2 THEN 'Capreolus capreolus (Roe deer)' ELSE 'Unknown' END AS species_name FROM lineitem) l
GROUP BY l_orderkey, wikidata_id""",
    "manifest_flights": "SELECT CAST(o_custkey%47 + 1 AS INT) AS part, 18885436 + o_custkey%47 AS deposition_id, CAST(o_orderkey AS STRING) AS flight_id FROM orders",
    "poses": f"""SELECT CAST(user_id AS STRING) AS flight_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS pos,
 CAST(46.5 AS DOUBLE) + value/200 AS lat, CAST(9.5 AS DOUBLE) + k*CAST(0.07 AS DOUBLE) AS lng, 400 + value AS alt, CAST(-90 AS DOUBLE) AS pitch, CAST(k%5 AS DOUBLE) AS roll, CAST(k AS DOUBLE)*3 AS yaw FROM {_EVENTS}""",
    "dem_meta": """SELECT CAST(c_custkey AS STRING) AS flight_id, 'EPSG:32633' AS crs, CAST(300000 + c_custkey*10 AS DOUBLE) AS origin_x, CAST(5200000 + c_custkey*10 AS DOUBLE) AS origin_y,
 CAST(c_custkey%500 AS DOUBLE) AS origin_z FROM customer WHERE c_custkey%5 <> 0""",
    "dem_cells": """SELECT 'd0' AS dem_id, row_i, col_i, CAST(80000 + col_i*13000 AS DOUBLE) AS x, CAST(5430000 - row_i*6000 AS DOUBLE) AS y, elev
FROM (SELECT CAST(floor(p_partkey/CAST(40 AS DOUBLE)) AS INT) AS row_i, CAST(p_partkey%40 AS INT) AS col_i, CASE WHEN p_size%10=0 THEN CAST(0 AS DOUBLE) ELSE p_retailprice END AS elev FROM part) c""",
    "videos": "SELECT CAST(c_custkey AS STRING) AS video_id, concat(CAST(c_custkey AS STRING), '_flight.mp4') AS file_name, CAST(100 + c_custkey%200 AS INT) AS total_frames, CAST(2048 AS INT) AS width, CAST(1024 AS INT) AS height FROM customer",
    "mot_files": "SELECT concat(CAST(c_custkey AS STRING), CASE WHEN c_custkey%2=0 THEN '_gt.txt' ELSE '_annotations.csv' END) AS file_name FROM customer WHERE c_custkey%3 <> 0",
}
_BASE = {"detections": "events", "flights": "orders", "flight_species": "lineitem", "manifest_flights": "orders", "poses": "events", "dem_meta": "customer", "dem_cells": "part", "videos": "customer", "mot_files": "customer"}

CELL_W, CELL_H = 13_000.0, 6_000.0


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base = _BASE[name]
    df = spark.read.parquet(f"{sf_dir}/{base}.parquet")
    return spark.sql(ADAPTERS[name].replace(f"FROM {base}", "FROM {base}"), base=df)


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flights with flight_info and species_present as they are in the metadata; one row a species was aggregated, so keys are unique."""
    species = load(spark, sf_dir, "flight_species")
    maps = species.groupBy("flight_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("wikidata_id", F.struct(*[F.col(c) for c in species.columns if c != "flight_key"]))))).alias("species_present"))
    base = load(spark, sf_dir, "flights")
    return base.join(maps, "flight_key", "left").withColumn("flight_info", F.struct("weather", F.col("start_time").cast("string").alias("start_time"), "drone_name"))


def ctes(*names: str) -> str:
    """WITH clause for an oracle; SQL of the adapters by name."""
    return "WITH " + ",\n".join(f"{n} AS ({ADAPTERS[n]})" for n in names)
