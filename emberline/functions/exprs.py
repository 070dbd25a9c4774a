"""Column expressions shared by the operators; everything stays inside Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from emberline import config as C

def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- text to value -----------------------------------------------------------------------------------------------

def to_number(text: Column | str) -> Column:
    """Text to double; null where the text is not a number (a Java type suffix does not make one)."""
    t = F.trim(_col(text))
    return F.when(~F.substring(t, -1, 1).isin("d", "D", "f", "F"), t.try_cast("double"))


def to_integer(text: Column | str) -> Column:
    """Text to whole number; null where the text is anything else."""
    t = F.trim(_col(text))
    return F.when(~t.contains("."), t.try_cast("int"))


def fixed_field(line: Column | str, start: int, stop: int) -> Column:
    """Characters [start, stop) of a fixed-width line, counted from zero and trimmed."""
    return F.trim(F.substring(_col(line), start + 1, stop - start))


# Day layouts that reports come in, tried in this order; a time part may follow.
DAY_LAYOUTS = ("yyyy-M-d", "yyyy/M/d", "yyyyMMdd", "M/d/yyyy", "d-MMM-yyyy", "MMM d, yyyy")


def to_day(text: Column | str) -> Column:
    """Date of a text in one of the layouts above, with or without a time of day; null when anything else stands in it or it is
    no real day."""
    whole = F.trim(_col(text))
    time = r"[T ]+\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?$"
    day = F.regexp_replace(whole, time, "")
    return F.coalesce(*[F.try_to_date(day, layout) for layout in DAY_LAYOUTS])


def valid_day(year: Column, month: Column, day: Column) -> Column:
    """Date of the three parts, null when the calendar has no such day."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


# --- predicates --------------------------------------------------------------------------------------------------

def in_bounds(lat: Column | str, lon: Column | str, b: C.Bounds = C.SOUTHERN_CANADA) -> Column:
    return _col(lat).between(b.lat_min, b.lat_max) & _col(lon).between(b.lon_min, b.lon_max)


def holds(condition: Column) -> Column:
    """A condition with unknown read as false."""
    return F.coalesce(condition, F.lit(False))


def wkt_known(wkt: Column | str) -> Column:
    """Blank text, or text that starts with a known geometry word."""
    t = F.upper(F.trim(_col(wkt)))
    return reduce(lambda a, p: a | t.startswith(p), C.WKT_PREFIXES, _col(wkt).isNull() | (t == ""))


def reading_in_range(element: Column, value: Column) -> Column:
    """Whether a reading lies in the range of its element; elements with one range share one test."""
    by_range: dict[tuple, list[str]] = {}
    for name, limits in C.ELEMENT_RANGE.items():
        by_range.setdefault(limits, []).append(name)
    return reduce(
        lambda a, b: a | b, [element.isin(*names) & value.between(*limits) for limits, names in by_range.items()]
    )


# --- weather -----------------------------------------------------------------------------------------------------

def clean_reading(element: Column, text: Column) -> Column:
    """Raw daily value to a reading: missing mark dropped, tenths scaled. The range is tested apart."""
    scale = F.when(element.isin(*C.TENTHS_ELEMENTS), 10.0).otherwise(1.0)
    return F.nullif(to_number(text), F.lit(C.MISSING_VALUE)) / scale


def elevation_m(text: Column) -> Column:
    value = to_number(text)
    return F.when(value.between(*C.ELEVATION_RANGE) & (text != C.ELEVATION_MISSING), value)


def days_in_month(year: Column, month: Column) -> Column:
    first = F.when(month.between(1, 12) & year.between(1, 9999), F.make_date(year, month, F.lit(1)))
    return F.day(F.last_day(first))


def season(month: Column | str) -> Column:
    m = _col(month)
    return (
        F.when(m.isin(12, 1, 2), "winter")
        .when(m.between(3, 5), "spring")
        .when(m.between(6, 8), "summer")
        .otherwise("fall")
    )


def completeness(*measures: Column | str) -> Column:
    present = reduce(lambda a, b: a + b, [_col(m).isNotNull().cast("int") for m in measures])
    return present / F.lit(float(len(measures)))


def _wave(month: Column, shift: int) -> Column:
    return F.sin(F.lit(2.0) * F.pi() * (month - F.lit(shift)) / F.lit(12.0))


def seasonal_defaults(month: Column | str) -> dict[str, Column]:
    """Typical weather of a calendar month, used where no assigned station reports."""
    m = _col(month)
    avg = F.lit(10.0) + F.lit(15.0) * _wave(m, 3)
    spread = F.lit(8.0) + F.lit(4.0) * _wave(m, 6)
    snow = F.when(m.isin(11, 12, 1, 2, 3), F.greatest(F.lit(0.0), F.lit(10.0) * _wave(m, 12)))
    return {
        "tmax": avg + spread / F.lit(2.0),
        "tmin": avg - spread / F.lit(2.0),
        "tavg": avg,
        "temp_range": spread,
        "prcp": F.greatest(F.lit(0.0), F.lit(2.0) + _wave(m, 6)),
        "snwd": snow.otherwise(F.lit(0.0)),
        "data_completeness": F.lit(0.0),
    }


# --- geography ---------------------------------------------------------------------------------------------------

def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = (F.radians(lat2) - F.radians(lat1)) / 2
    half_lon = (F.radians(lon2) - F.radians(lon1)) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(
        half_lon
    ) * F.sin(half_lon)
    return F.lit(2.0 * C.EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def euclid_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt((lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2))


def manhattan_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.abs(lat1 - lat2) + F.abs(lon1 - lon2)


def station_tier(nearest_km: Column) -> Column:
    """How many of the closest stations a cell uses."""
    return F.when(nearest_km < 50.0, 1).when(nearest_km < 200.0, 3).otherwise(5)


def confidence(stations_used: Column, nearest_km: Column) -> Column:
    reach = F.when(stations_used == 1, F.lit(100.0)).otherwise(F.lit(200.0))
    return F.when(
        stations_used >= 1, F.greatest(F.lit(0.1), F.lit(1.0) - nearest_km / reach)
    ).otherwise(F.lit(0.1))


def _inside_any(lat: str, lon: str, boxes: tuple) -> str:
    """SQL text of "the point is in one of the boxes"; text, because a few dozen Column calls per use add up."""
    def one(box):
        sides = zip((f"{lat} >=", f"{lat} <=", f"{lon} >=", f"{lon} <="), box)
        return "(" + " AND ".join(f"{side} {float(limit)}D" for side, limit in sides if limit is not None) + ")"

    return "(" + " OR ".join(one(box) for box in boxes) + ")"


def in_water(lat: str, lon: str) -> Column:
    return F.expr(_inside_any(lat, lon, C.WATER_BOXES))


def in_urban(lat: str, lon: str) -> Column:
    return F.expr(_inside_any(lat, lon, C.URBAN_BOXES))


def terrain_type(lat: str, lon: str) -> Column:
    """Urban beats water, water beats forest, the rest is land."""
    return (
        F.when(in_urban(lat, lon), "urban")
        .when(in_water(lat, lon), "water")
        .when(F.col(lat) >= C.FOREST_LAT_MIN, "forest")
        .otherwise("land")
    )


def terrain_code(terrain: Column) -> Column:
    chain = F
    for name, code in C.TERRAIN_CODE.items():
        chain = chain.when(terrain == name, code)
    return chain.otherwise(0)


# --- fires -------------------------------------------------------------------------------------------------------

def burn_size_ha(size: Column) -> Column:
    return F.when(size > 0, size).otherwise(F.lit(1.0))


def fire_radius_km(size_ha: Column) -> Column:
    return F.least(F.sqrt(size_ha / F.pi()) / F.lit(10.0), F.lit(C.FIRE_RADIUS_CAP_KM))


def seasonal_factor(month: Column) -> Column:
    return F.lit(1.0) + F.lit(0.3) * _wave(month, 6)


def sampling_rank(*parts: Column | str, seed: int = C.SAMPLE_SEED) -> Column:
    """A repeatable random key: the md5 of the given parts and a seed."""
    return F.md5(F.concat_ws("|", *[_col(p).cast("string") for p in parts], F.lit(str(seed))))
