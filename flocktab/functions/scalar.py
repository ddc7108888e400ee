"""Scalar functions as Column expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weather bits; 0 is night.
WEATHER = {"night": 0, "sunny": 1, "cloudy": 2, "rainy": 4, "snowy": 8, "windy": 16, "foggy": 32}
TILE = 50_000
# The tile server's address and its file patterns by date, in order of preference.
TILE_BASE = "https://data.bev.gv.at/download/ALS/DTM/"
TILE_PATTERNS = [("20230915", "ALS_DTM_CRS3035RES50000mN{north}E{east}.tif"), ("20190915", "CRS3035RES50000mN{north}E{east}.tif"), ("20210401", "ALS_DTM_CRS3035RES50000mN{north}E{east}.tif")]


#: What counts as white space at the ends of a field.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def _product_error(x: Column, product: Column, factor: float) -> Column:
    """What x * factor loses by rounding, exactly: factor has 26 bits at most, so half of x times it is exact (Dekker)."""
    c = x * F.lit(134217729.0)
    high = c - (c - x)
    return (high * F.lit(factor) - product) + (x - high) * F.lit(factor)


def _scaled(x: Column, digits: int) -> Column:
    """x * 10 ** digits, rounded to the whole number that its exact binary value is nearest to, ties to even; a double below 2 ** 52."""
    factor = 10.0**digits
    p = x * F.lit(factor)
    near, error = F.rint(p), _product_error(x, p, factor)
    # rint sees the rounded product: only where that is a tie can the lost part decide otherwise
    up, down = (p - near == 0.5) & (error > 0), (p - near == -0.5) & (error < 0)
    return F.when(up, near + 1).when(down, near - 1).otherwise(near)


def fmt_fixed(x: Column, digits: int) -> Column:
    """Decimal text of up to 7 digits with the exact binary value rounded half to even, as printf has it; null and NaN are null. Below 2 ** 63, beyond that digits may differ."""
    v = x.cast("double")
    if digits != 2:
        return _fixed_text(v, digits)
    # for annotation lines: where the product is clearly no tie, its nearest integer has the digits; it is off by 2 ** -23 at most.
    # What is left goes through functions of a bound variable, as its text inlined is too much code to compile
    y = F.abs(v) * 100.0
    near, clear = F.rint(y).cast("bigint"), (y < 1e9) & (F.abs(y - F.floor(y) - 0.5) > 1e-6) & (v != 0)
    quick = F.concat(F.when(v < 0, "-").otherwise(""), F.floor(near / F.lit(100.0)).cast("string"), F.lit("."), F.lpad((near % 100).cast("string"), 2, "0"))
    return F.when(clear, quick).when((v == 0) & (F.signum(v).cast("string") == "0.0"), "0.00").otherwise(F.element_at(F.transform(F.array(v), lambda z: _fixed_text(z, 2)), 1))


def _fixed_text(v: Column, digits: int) -> Column:
    a = F.abs(v)
    whole = F.floor(a).cast("bigint")
    part = _scaled(a - whole, digits).cast("bigint")  # the difference is exact
    carry, unit = F.when(part >= 10**digits, 1).otherwise(0), 10**digits
    # half to even looks at the whole number where no digit follows
    digits_text = F.concat(F.lit("."), F.lpad((part - carry * unit).cast("string"), digits, "0")) if digits else F.lit("")
    text = F.concat((whole + carry).cast("string"), digits_text) if digits else F.rint(a).cast("bigint").cast("string")
    sign = F.when(v.cast("string").startswith("-"), "-").otherwise("")  # of -0.0 too
    large = F.concat(F.abs(v).cast("decimal(38,0)").cast("string"), F.lit("." + "0" * digits if digits else ""))
    return F.when(F.isnan(v) | v.isNull(), F.lit(None).cast("string")).when(a == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, F.when(a < 2.0**63, text).otherwise(large)))


def decode_weather(v: Column) -> Column:
    """Names by ascending bit; [night] for 0; null for null."""
    names = [F.when(v.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for name, bit in WEATHER.items() if bit]
    return F.when(v == 0, F.array(F.lit("night"))).when(v.isNotNull(), F.array_compact(F.array(*names)))


def encode_weather(names: list[str]) -> int:
    """OR of the bits; an unknown name is an error."""
    mask = 0
    for name in names:
        if name.lower() not in WEATHER:
            raise ValueError(f"unknown weather {name!r}; one of {', '.join(WEATHER)}")
        mask |= WEATHER[name.lower()]
    return mask


def encode_weather_col(names: Column) -> Column:
    """encode_weather of an array column."""
    bits = F.create_map(*[F.lit(x) for kv in WEATHER.items() for x in kv])
    bit = lambda n: F.coalesce(bits[F.lower(n)], F.raise_error(F.concat(F.lit("unknown weather "), n)).cast("int"))
    return F.aggregate(names, F.lit(0), lambda acc, n: acc.bitwiseOR(bit(n)))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def round_even(x: Column, digits: int = 0) -> Column:
    """Half to even, of the exact binary value, up to 7 digits: the nearest double to that decimal. Values of 2 ** 52 / 10 ** digits and more stay as they are."""
    if not digits:
        return F.rint(x) + 0.0  # a tie is one in binary too; bround goes by way of decimal text. The sum makes -0.0 0.0
    v = x.cast("double")
    return F.when(F.abs(v) < 2.0**52 / 10**digits, _scaled(v, digits) / F.lit(10.0**digits)).otherwise(v)


def floor_div(x: Column, n: int) -> Column:
    """Quotient towards minus infinity; div truncates."""
    return F.floor(x / F.lit(n))


def yolo_box(left: Column, top: Column, width: Column, height: Column, img_w: float, img_h: float) -> list[Column]:
    """cx, cy, w, h as shares of the image, each clamped to 0..1 by itself."""
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return [clamp((left + width / F.lit(2.0)) / F.lit(img_w)), clamp((top + height / F.lit(2.0)) / F.lit(img_h)), clamp(width / F.lit(img_w)), clamp(height / F.lit(img_h))]


def yolo_to_pixels(cx: Column, cy: Column, w: Column, h: Column, img_w: float, img_h: float) -> list[Column]:
    """x1, y1, x2, y2 in pixels."""
    return [(cx - w / 2) * img_w, (cy - h / 2) * img_h, (cx + w / 2) * img_w, (cy + h / 2) * img_h]


def yolo_label(properties: list[str]) -> Column:
    """The named columns joined by '-'; visibility with two decimals, null as empty."""
    parts = [fmt_fixed(F.col(p), 2) if p == "visibility" else F.col(p).cast("string") for p in properties]
    return F.concat_ws("-", *[F.coalesce(p, F.lit("")) for p in parts])


def box_corners(left: Column, top: Column, width: Column, height: Column) -> Column:
    """Eight numbers: top left, top right, bottom right, bottom left."""
    right, bottom = left + width, top + height
    return F.array(*[c.cast("double") for c in (left, top, right, top, right, bottom, left, bottom)])


def box_center(left: Column, top: Column, width: Column, height: Column) -> tuple[Column, Column]:
    return left + floor_div(width, 2), top + floor_div(height, 2)


def stem(name: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def file_id(name: Column) -> Column:
    """What stands before the first '_' of the stem; null without one."""
    s = stem(name)
    return F.when(s.contains("_"), F.split(s, "_")[0])


def seq_id(name: Column) -> Column:
    """What stands before the first '_' of the stem, else the stem."""
    return F.split(stem(name), "_")[0]


def name_prefix(name: Column) -> Column:
    """What stands before the first '_' of the whole name."""
    return F.split(name, "_")[0]


def frame_index(name: Column) -> Column:
    """The number after the last '_' of the stem; without one, an error."""
    digits = F.regexp_extract(stem(name), r"_(\d+)$", 1)
    return F.when(digits != "", digits.cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("no frame index in "), name)).cast("bigint"))


def frame_file(prefix: Column, frame: Column) -> Column:
    return F.format_string("%s_%08d.png", prefix, frame)


def pose_stem(name: Column) -> Column:
    """Stem without a closing _poses; 'dem' if nothing is left."""
    s = F.regexp_replace(stem(name), "_poses$", "")
    return F.when(s == "", F.lit("dem")).otherwise(s)


def output_dir(path: Column) -> Column:
    """DEM/ beside the file's folder."""
    return F.concat(F.regexp_replace(path, r"/?[^/]*/[^/]*$", ""), F.lit("/DEM/"))


def zip_name(flight_id: Column) -> Column:
    return F.concat(F.lit("flight_"), flight_id, F.lit(".zip"))


def file_pattern(flight_id: Column, name: Column) -> Column:
    """name with the first occurrence of the id replaced by <id>."""
    at = F.instr(name, flight_id)
    return F.when(at > 0, F.overlay(name, F.lit("<id>"), at, F.length(flight_id))).otherwise(name)


def tile_name(north: Column, east: Column) -> Column:
    return F.concat(F.lit("N"), north.cast("string"), F.lit("E"), east.cast("string"))


def species_short(species: Column) -> Column:
    """Text in the first parentheses, else the whole; empty and Unknown give Unknown. As coded: the text ends before the
    first ')' of all, so it is empty if that comes before the '('; without one, the last character goes."""
    begin, close = F.instr(species, "("), F.instr(species, ")")
    end = F.when(close > 0, close - 1).otherwise(F.length(species) - 1)
    inner = strip(F.substring(species, begin + 1, F.greatest(end - begin, F.lit(0))))
    return F.when(species.isNull() | species.isin("", "Unknown"), F.lit("Unknown")).when(species.contains("("), inner).otherwise(species)


def species_tail(species: Column) -> Column:
    """Text after the last '(' without closing ')'; empty gives ?."""
    return F.when(species.isNull() | (species == ""), F.lit("?")).otherwise(F.rtrim(F.element_at(F.split(species, r"\("), -1), F.lit(")")))


def visibility_text(v: Column) -> Column:
    return F.when(v == 0, F.lit("Occluded")).otherwise(F.lit("Visible"))


def _named(v: Column, names: list[str]) -> Column:
    out = v.cast("string")
    for k, name in enumerate(names):
        out = F.when(v.cast("string") == str(k), F.lit(name)).otherwise(out)
    return out


def age_text(v: Column) -> Column:
    return _named(v, ["Unknown", "Juvenile", "Adult"])


def sex_text(v: Column, strict: bool = False) -> Column:
    """As coded the words of the ages; strict: Unknown, Male, Female."""
    return _named(v, ["Unknown", "Male", "Female"] if strict else ["Unknown", "Juvenile", "Adult"])


def point_label(interpolated: Column, kf_a: Column, kf_b: Column, short: Column | None = None) -> Column:
    """ID:… | short | c:… | prop | interp [a-b], over the columns of a detection; short: its species_short, where that is known."""
    prop = F.when(F.coalesce(F.nullif(F.col("is_propagated"), F.lit("")), F.lit("0")) != "0", F.lit("prop"))
    between = F.when(interpolated, F.concat(F.lit("interp ["), kf_a.cast("string"), F.lit("-"), kf_b.cast("string"), F.lit("]")))
    return F.concat_ws(" | ", F.concat(F.lit("ID:"), F.col("track_id").cast("string")), species_short(F.col("species")) if short is None else short, F.concat(F.lit("c:"), fmt_fixed(F.col("conf"), 2)), prop, between)


def track_label(strict: bool = False) -> Column:
    """#id short (visibility/age/sex), over the columns of a detection."""
    return F.concat(F.lit("#"), F.col("track_id").cast("string"), F.lit(" "), species_tail(F.col("species")), F.lit(" ("), visibility_text(F.col("visibility")), F.lit("/"), age_text(F.col("age")), F.lit("/"), sex_text(F.col("gender"), strict), F.lit(")"))


def fovy(values: Column, kind: str = "array<double>", default: float = 50.0) -> Column:
    """First of an array of angles, or the angle, by the column's type; else the default."""
    first = F.get(values, F.lit(0)) if kind.startswith("array") else values
    return F.coalesce(first.cast("double"), F.lit(default))


def class_key(wikidata: Column, gender: Column, age: Column, visible: Column) -> Column:
    return F.concat_ws("-", wikidata, gender, age, visible)


def split_class_key(key: Column) -> list[Column]:
    parts = F.split(key, "-")
    return [parts[0].alias("wikidata_id"), parts[1].cast("int").alias("class_gender"), parts[2].cast("int").alias("class_age"), parts[3].cast("int").alias("class_visibility")]


def split_halves(width: Column) -> Column:
    """Array of (modality, x0, x1): thermal left, rgb right."""
    half = floor_div(width, 2).cast("int")
    return F.array(F.struct(F.lit("thermal").alias("modality"), F.lit(0).alias("x0"), half.alias("x1")), F.struct(F.lit("rgb").alias("modality"), half.alias("x0"), width.cast("int").alias("x1")))
