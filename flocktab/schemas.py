"""Table schemas (DDL). The file a row came from and its place there are columns: order and file are data."""

# The fields of a line, in order.
DETECTION = "frame bigint, track_id bigint, bb_left int, bb_top int, bb_width int, bb_height int, conf double, class_id int, visibility double, species string, gender string, age string, is_propagated string"
DETECTION_FIELDS = [x.split()[0] for x in DETECTION.split(", ")]

SPECIES = (
    "struct<species_name: string, wikidata_id: string, contains_occluded_frames: boolean, contains_unoccluded_frames: boolean, contains_unknown_sex: boolean, contains_male: boolean,"
    " contains_female: boolean, contains_unknown_age: boolean, contains_juvenile: boolean, contains_adult: boolean, num_labels: int, num_label_states: int>"
)
#: species_present has a key for each species: a map by explicit schema, never inferred.
FLIGHT = (
    "flight_key string, split string, generated_at timestamp_ntz, frame_count int, flight_info struct<key: string, weather: int, start_time: string, end_time: string, drone_name: string, drone_instance_id: int, link: string>,"
    f" species_present map<string, {SPECIES}>"
)
MANIFEST = "part int, title string, deposition_id bigint, doi string, flights array<string>, num_files int, flight_details map<string, array<string>>"
DEM_META = "width int, height int, crs string, transform array<double>, origin array<double>, origin_wgs84 struct<latitude: double, longitude: double, altitude: double>"
DEM_CELL = "dem_id string, row_i int, col_i int, x double, y double, elev double"
LISTING = "files array<struct<filename: string, key: string, links: struct<download: string, self: string>>>"
CORRECTION = "translation struct<x: double, y: double, z: double>, rotation struct<x: double, y: double, z: double>"

# Class ids of <wikidata id>-<gender>-<age>-<visibility>, in order from 0.
CLASSES = """
Q10738-0-0-0 Q10738-0-0-1
Q1219579-0-0-0 Q1219579-0-0-1 Q1219579-0-1-0 Q1219579-0-1-1 Q1219579-0-2-0 Q1219579-0-2-1 Q1219579-1-0-0 Q1219579-1-0-1 Q1219579-1-2-0 Q1219579-1-2-1
Q1219579-2-0-0 Q1219579-2-0-1 Q1219579-2-1-0 Q1219579-2-2-0 Q1219579-2-2-1
Q122069-0-0-0 Q122069-0-0-1 Q122069-0-1-0 Q122069-0-1-1 Q122069-0-2-0 Q122069-0-2-1
Q131340-0-0-0 Q131340-0-0-1 Q131340-0-2-0 Q131340-0-2-1
Q15978631-0-0-0 Q15978631-0-0-1 Q15978631-0-2-0 Q15978631-0-2-1 Q15978631-2-0-0 Q15978631-2-2-0 Q15978631-2-2-1
Q168327-0-0-0 Q168327-0-0-1 Q168327-0-1-0 Q168327-0-1-1 Q168327-0-2-0 Q168327-0-2-1 Q168327-2-2-0 Q168327-2-2-1
Q20908334-0-0-0 Q20908334-0-1-0 Q20908334-1-0-0 Q20908334-1-1-0 Q20908334-1-2-0 Q20908334-2-2-0 Q20908334-2-2-1
Q24238356-0-0-0 Q24238356-0-0-1 Q24238356-0-2-0 Q24238356-0-2-1
Q26972265-0-0-0 Q26972265-0-2-0 Q26972265-0-2-1
Q5113-0-0-0 Q5113-0-0-1 Q5113-0-2-0 Q5113-0-2-1
Q58697-0-0-0 Q58697-0-0-1 Q58697-0-1-0 Q58697-0-1-1 Q58697-0-2-0 Q58697-0-2-1 Q58697-1-2-0 Q58697-1-2-1 Q58697-2-2-0 Q58697-2-2-1
Q602666-0-0-0 Q602666-0-0-1 Q602666-0-1-0 Q602666-0-2-0 Q602666-0-2-1
""".split()
