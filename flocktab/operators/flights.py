"""Filters on flight metadata. A flight's species are a map of structs; all tests are lambdas over it, no explode."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flocktab.functions.scalar import decode_weather, encode_weather


def weather_any(weather: Column, names: list[str], strict: bool = False) -> Column:
    """As coded: one of the bits is set, so that night (no bit) matches nothing. strict: all bits are set, night is a weather of 0."""
    mask = encode_weather(names)
    if not strict:
        return F.coalesce(weather.bitwiseAND(F.lit(mask)) != 0, F.lit(False))
    test = weather.bitwiseAND(F.lit(mask)) == mask
    return F.coalesce(test & (weather == 0) if any(n.lower() == "night" for n in names) else test, F.lit(False))


def start_between(start: Column, min_date: str | None = None, max_date: str | None = None) -> Column:
    """Inclusive on the date; a start that is missing or can't be read fails if a bound is set."""
    day = F.to_date(F.try_to_timestamp(start.cast("string")))
    tests = ([day >= F.lit(min_date).cast("date")] if min_date else []) + ([day <= F.lit(max_date).cast("date")] if max_date else [])
    return F.coalesce(reduce(and_, tests, F.lit(True)), F.lit(False))


def drone_like(name: Column, names: list[str]) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return reduce(or_, [low.contains(n.lower()) for n in names])


def species_candidates(species: Column, queries: list[str]) -> Column:
    """Entries whose name contains, or whose id is, one of the queries; all without a query."""
    values = F.coalesce(F.map_values(species), F.array())
    if not queries:
        return values
    text = lambda x: F.lower(F.coalesce(x, F.lit("")))
    return F.filter(values, lambda s: reduce(or_, [text(s["species_name"]).contains(q.lower()) | (text(s["wikidata_id"]) == q.lower()) for q in queries]))


def species_attributes(occlusion: bool | None = None, sex: list[str] = (), age: list[str] = ()):
    """A test of one entry: occlusion and any of sex and any of age; a missing flag is false."""
    flag = lambda s, name: F.coalesce(s[name], F.lit(False))

    def test(s: Column) -> Column:
        tests = [F.lit(True)]
        if occlusion is not None:
            tests.append(flag(s, "contains_occluded_frames" if occlusion else "contains_unoccluded_frames"))
        if sex:
            tests.append(reduce(or_, [flag(s, {"unknown": "contains_unknown_sex"}.get(x, f"contains_{x}")) for x in sex]))
        if age:
            tests.append(reduce(or_, [flag(s, {"unknown": "contains_unknown_age"}.get(x, f"contains_{x}")) for x in age]))
        return reduce(and_, tests)

    return test


def flight_filter(weather=(), min_date=None, max_date=None, drone=(), species=(), occlusion=None, sex=(), age=(), strict: bool = False, fields: dict[str, str] | None = None) -> Column:
    """Whether a flight passes all given filters, and one and the same entry of its species; without any filter, true.

    fields: the columns of weather, start_time, drone_name and species_present.
    """
    at = {"weather": "flight_info.weather", "start_time": "flight_info.start_time", "drone_name": "flight_info.drone_name", "species_present": "species_present"} | (fields or {})
    if not (weather or min_date or max_date or drone or species or occlusion is not None or sex or age):
        return F.lit(True)
    tests = []
    if weather:
        tests.append(weather_any(F.col(at["weather"]), list(weather), strict))
    if min_date or max_date:
        tests.append(start_between(F.col(at["start_time"]), min_date, max_date))
    if drone:
        tests.append(drone_like(F.col(at["drone_name"]), list(drone)))
    tests.append(F.exists(species_candidates(F.col(at["species_present"]), list(species)), species_attributes(occlusion, list(sex), list(age))))
    return reduce(and_, tests)


def filter_flights(flights: DataFrame, **filters) -> DataFrame:
    return flights.where(flight_filter(**filters))


def in_file_order(flights: DataFrame, col: str = "file_name") -> DataFrame:
    """Names as text: 0, 100, 101, ..., 2."""
    return flights.orderBy(col)


def match_details(matches: DataFrame) -> DataFrame:
    """Report of the matching flights: drone, start, weather names, species names in the map's order, frames."""
    names = F.transform(F.coalesce(F.map_values("species_present"), F.array()), lambda s: s["species_name"])
    return matches.select("flight_key", F.col("flight_info.drone_name").alias("drone_name"), F.col("flight_info.start_time").alias("start_time"), decode_weather(F.col("flight_info.weather")).alias("weather"),
                          F.array_join(names, ", ").alias("species"), "frame_count")


def match_count(flights: DataFrame, **filters) -> DataFrame:
    """One row: matched and total, counted in one pass."""
    return flights.agg(F.count_if(flight_filter(**filters)).alias("matched"), F.count("*").alias("total"))


def flight_overview(flights: DataFrame) -> DataFrame:
    """One row: hours in flight, first start and last end (or start, where no end is known)."""
    start, end = (F.try_to_timestamp(F.col(f"flight_info.{c}").cast("string")) for c in ("start_time", "end_time"))
    return flights.agg((F.sum(F.unix_timestamp(end) - F.unix_timestamp(start)) / 3600).alias("flight_hours"), F.min(start).alias("period_start"), F.max(F.coalesce(end, start)).alias("period_end"))
