"""Queries on flight metadata and release manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from flocktab.functions import scalar as S
from flocktab.operators import flights as L
from flocktab.operators import manifest as R

from .registry import query

FL = ("flights", "flight_species")


@query("SELECT flight_key, weather FROM flights WHERE (weather & 18) <> 0", ("flights",))
def f1_weather_coded(t):
    return t.flights.where(L.weather_any(F.col("weather"), ["cloudy", "windy"])).select("flight_key", "weather")


@query("SELECT flight_key, weather FROM flights WHERE (weather & 18) = 18", ("flights",))
def f1_weather_strict(t):
    return t.flights.where(L.weather_any(F.col("weather"), ["cloudy", "windy"], strict=True)).select("flight_key", "weather")


@query("SELECT flight_key FROM flights WHERE CAST(start_time AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1996-02-29'", ("flights",))
def f2_start_between(t):
    return t.flights.where(L.start_between(F.col("start_time"), "1995-03-01", "1996-02-29")).select("flight_key")


@query("SELECT flight_key, drone_name FROM flights WHERE contains(lower(drone_name), 'mavic')", ("flights",))
def f3_drone_like(t):
    return t.flights.where(L.drone_like(F.col("drone_name"), ["MAVIC"])).select("flight_key", "drone_name")


@query("SELECT DISTINCT flight_key FROM flight_species WHERE contains(lower(species_name), 'roe deer') OR lower(wikidata_id) = 'q58697'", FL)
def f4_species_candidates(t):
    return t.full_flights.where(F.size(L.species_candidates(F.col("species_present"), ["Roe Deer", "q58697"])) > 0).select("flight_key")


@query("SELECT DISTINCT flight_key FROM flight_species WHERE contains_occluded_frames AND (contains_male OR contains_female) AND contains_adult", FL)
def f5_species_attributes(t):
    test = L.species_attributes(True, ["male", "female"], ["adult"])
    return t.full_flights.where(F.exists(L.species_candidates(F.col("species_present"), []), test)).select("flight_key")


P1 = "SELECT DISTINCT f.flight_key FROM flights f JOIN flight_species s USING (flight_key) WHERE (weather & 3) <> 0 AND CAST(start_time AS DATE) >= DATE '1994-01-01' AND contains(lower(drone_name), 'mavic') AND contains(lower(species_name), 'deer') AND contains_unoccluded_frames AND contains_juvenile"


FILTERS = {"weather": ["sunny", "cloudy"], "min_date": "1994-01-01", "drone": ["mavic"], "species": ["deer"], "occlusion": False, "age": ["juvenile"]}


def _matches(t):
    return L.filter_flights(t.full_flights, **FILTERS)


@query(P1, FL)
def f6_p1_filter_flights(t):
    return _matches(t).select("flight_key")


@query(", m AS (" + P1 + "), s AS (SELECT flight_key, string_agg(species_name, ', ' ORDER BY wikidata_id) AS species FROM flight_species GROUP BY flight_key) SELECT f.flight_key, drone_name, frame_count, species, list_filter([CASE WHEN weather & 1 <> 0 THEN 'sunny' END, CASE WHEN weather & 2 <> 0 THEN 'cloudy' END, CASE WHEN weather & 4 <> 0 THEN 'rainy' END, CASE WHEN weather & 8 <> 0 THEN 'snowy' END, CASE WHEN weather & 16 <> 0 THEN 'windy' END, CASE WHEN weather & 32 <> 0 THEN 'foggy' END], lambda x: x IS NOT NULL) AS weather FROM flights f JOIN m USING (flight_key) JOIN s USING (flight_key)", FL)
def j12_match_details(t):
    return L.match_details(_matches(t)).select("flight_key", "drone_name", "frame_count", "species", "weather")


@query("SELECT (SELECT count(*) FROM (" + P1 + ")) AS matched, (SELECT count(*) FROM flights) AS total", FL)
def a13_match_count(t):
    return L.match_count(t.full_flights, **FILTERS)


@query("SELECT flight_key, weather AS encoded, CASE WHEN weather = 0 THEN 1 ELSE bit_count(weather) END AS names FROM flights", ("flights",))
def t2_t3_weather_codes(t):
    names = S.decode_weather(F.col("weather"))
    return t.flights.select("flight_key", S.encode_weather_col(names).alias("encoded"), F.size(names).alias("names"))


@query("SELECT species_name, count(*) AS flights, CAST(sum(num_labels) AS BIGINT) AS tracks, CAST(sum(num_label_states) AS BIGINT) AS key_frames FROM flight_species GROUP BY species_name", FL)
def a16_species_from_metadata(t):
    rows = t.full_flights.select(F.explode("species_present").alias("id", "s"))
    return rows.groupBy("s.species_name").agg(F.count("*").alias("flights"), F.sum("s.num_labels").alias("tracks"), F.sum("s.num_label_states").alias("key_frames"))


# Manifests. The adapter's table is the exploded manifest: one part a deposition.

MF = ("manifest_flights",)
PRESENT = "SELECT 'flight_' || flight_id || '.zip' AS name FROM manifest_flights WHERE CAST(flight_id AS BIGINT) % 3 = 0 UNION ALL SELECT flight_id || '_gt.txt' FROM manifest_flights WHERE CAST(flight_id AS BIGINT) % 5 = 0"


def _index(t):
    parts = t.manifest_flights.groupBy("part", "deposition_id").agg(F.sort_array(F.collect_list(F.struct(F.col("flight_id").cast("bigint").alias("n"), "flight_id"))).alias("x")).select("part", "deposition_id", F.transform("x", lambda x: x["flight_id"]).alias("flights"))
    files = F.map_from_arrays("flights", F.transform("flights", lambda f: F.array(F.concat(f, F.lit("_gt.txt")), F.concat(f, F.lit("_"), f, F.lit(".mp4")))))
    return R.flight_index(parts.withColumn("flight_details", files))


def _present(t):
    n = F.col("flight_id").cast("bigint")
    m = t.manifest_flights
    return m.where(n % 3 == 0).select(F.concat(F.lit("flight_"), "flight_id", F.lit(".zip")).alias("name")).unionByName(m.where(n % 5 == 0).select(F.concat("flight_id", F.lit("_gt.txt")).alias("name")))


@query("SELECT flight_id, part, deposition_id, 'flight_' || flight_id || '.zip' AS zip_name FROM manifest_flights", MF)
def p6_a14_flight_index(t):
    return _index(t).select("flight_id", "part", "deposition_id", "zip_name")


ASK = ", asked AS (SELECT flight_id FROM manifest_flights WHERE CAST(flight_id AS BIGINT) BETWEEN 100 AND 900 OR part IN (3, 4) UNION SELECT unnest(['7', '14', 'nope']))"


ASKED = {"ids": ["7", "14", "nope"], "id_range": (100, 900), "parts": [3, 4]}


@query(ASK + " SELECT flight_id FROM asked", MF)
def u1_requested(t):
    return R.requested(_index(t), **ASKED)


@query(ASK + " SELECT flight_id FROM asked EXCEPT SELECT flight_id FROM manifest_flights", MF)
def u2_unknown(t):
    return R.unknown(_index(t), ASKED["ids"])


@query(ASK + " SELECT flight_id, part FROM manifest_flights WHERE flight_id IN (SELECT flight_id FROM asked)", MF)
def j4_resolve_flights(t):
    return R.resolve_flights(_index(t), **ASKED).select("flight_id", "part")


@query("SELECT flight_id FROM manifest_flights WHERE NOT (CAST(flight_id AS BIGINT) % 3 = 0 OR CAST(flight_id AS BIGINT) % 5 = 0)", MF)
def j5_skip_existing(t):
    return R.skip_existing(_index(t), _present(t), unzip=True).select("flight_id")


@query("SELECT flight_id, CASE WHEN part % 4 <> 0 THEN 'https://files/' || part || '/' || flight_id END AS url, part % 4 = 0 AS failed FROM manifest_flights", MF)
def j6_attach_urls(t):
    return R.attach_urls(_index(t), _listing(t)).select("flight_id", "url", "failed")


def _listing(t):
    return t.manifest_flights.where("part % 4 <> 0").select("deposition_id", F.concat(F.lit("flight_"), "flight_id", F.lit(".zip")).alias("name"), F.concat(F.lit("https://files/"), F.col("part").cast("string"), F.lit("/"), "flight_id").alias("url"))


@query("SELECT part, count(*) AS flights, arg_min(flight_id, CAST(flight_id AS BIGINT)) AS first_id, arg_max(flight_id, CAST(flight_id AS BIGINT)) AS last_id, '<id>_gt.txt, <id>_' || arg_min(flight_id, CAST(flight_id AS BIGINT)) || '.mp4' AS files_per_flight FROM manifest_flights GROUP BY part", MF)
def a7_manifest_listing(t):
    return R.manifest_listing(_index(t))


@query("SELECT deposition_id, min(part) AS part, count(*) AS n_flights, list(flight_id ORDER BY CAST(flight_id AS BIGINT)) AS flights FROM manifest_flights WHERE NOT (CAST(flight_id AS BIGINT) % 3 = 0) GROUP BY deposition_id", MF)
def a8_download_plan(t):
    return R.download_plan(R.skip_existing(_index(t), _present(t)))


@query("SELECT flight_id FROM manifest_flights ORDER BY CAST(flight_id AS BIGINT)", MF)
def o2_id_order(t):
    return R.in_id_order(_index(t)).select("flight_id")


@query("SELECT flight_id FROM manifest_flights EXCEPT SELECT flight_id FROM manifest_flights WHERE part <= 40", MF)
def u5_coverage_diff(t):
    return R.coverage_diff(t.manifest_flights, t.manifest_flights.where("part <= 40"))


@query(ASK + " SELECT deposition_id, min(part) AS part, count(*) AS n_flights, list(flight_id ORDER BY CAST(flight_id AS BIGINT)) AS flights, list(CASE WHEN part % 4 <> 0 THEN 'https://files/' || part || '/' || flight_id END ORDER BY CAST(flight_id AS BIGINT)) AS urls, count(*) FILTER (part % 4 = 0) AS n_failed FROM manifest_flights WHERE flight_id IN (SELECT flight_id FROM asked) AND CAST(flight_id AS BIGINT) % 3 <> 0 GROUP BY deposition_id", MF)
def p6_download_plan(t):
    return R.plan_downloads(_index(t), _present(t), _listing(t), **ASKED)


TWICE = ", twice AS (SELECT flight_id, part, deposition_id, 0 AS line_no FROM manifest_flights UNION ALL SELECT flight_id, part + 100, deposition_id + 100, -1 FROM manifest_flights WHERE part > 20 UNION ALL SELECT flight_id, part - 100, deposition_id - 100, 1 FROM manifest_flights WHERE part > 40)"


@query(TWICE + " SELECT flight_id, arg_max(part, line_no) AS part, arg_max(deposition_id, line_no) AS deposition_id FROM twice GROUP BY flight_id", MF)
def a14_last_part_wins(t):
    """Flights that two or three parts have: the part that stands last in the list counts, whatever its number."""
    m = t.manifest_flights.withColumn("line_no", F.lit(0))
    moved = lambda low, k, at: m.where(F.col("part") > low).withColumns({"part": F.col("part") + k, "deposition_id": F.col("deposition_id") + k, "line_no": F.lit(at)})
    rows = m.unionByName(moved(20, 100, -1)).unionByName(moved(40, -100, 1))
    parts = rows.groupBy("line_no", "part", "deposition_id").agg(F.collect_list("flight_id").alias("flights"))
    return R.flight_index(parts.withColumn("flight_details", F.lit(None).cast("map<string, array<string>>"))).select("flight_id", "part", "deposition_id")
