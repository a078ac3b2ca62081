"""Numbers, their formats, and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import shortest_float
from .fallible import Fallible, fallible

EARTH = {"metric": 6371.0, "imperial": 3958.8}


def abs_(c: Column) -> Column:
    return F.abs(c)


def floor(c: Column) -> Column:
    return F.floor(c).cast("double")


def ceil(c: Column) -> Column:
    return F.ceil(c).cast("double")


def round_(c: Column) -> Column:
    """Half away from zero."""
    return F.round(c.cast("double"))


def mod(c: Column, by: Column) -> Fallible:
    """The remainder has the dividend's sign."""
    return fallible(by != 0, F.try_mod(c, by), "mod: division by zero")


def divide(c: Column, by: Column) -> Fallible:
    return fallible(by != 0, F.try_divide(c.cast("double"), by.cast("double")), "division by zero")


def format_int(c: Column, base: int = 10) -> Column:
    """Lowercase digits, with a minus sign for negatives."""
    if not 2 <= base <= 36:
        raise ValueError("base must be from 2 to 36")
    digits = F.when(c == -(2**63), F.conv(F.lit("9223372036854775808"), 10, base)).otherwise(F.conv(F.abs(F.when(c != -(2**63), c)).cast("string"), 10, base))
    return F.concat(F.when(c < 0, "-").otherwise(""), F.lower(digits))


def format_number(c: Column, scale: int | None = None, decimal_separator: str = ".", grouping_separator: str = ",") -> Column:
    """Digits in groups of three; without a scale, of the number in six significant digits."""
    plain = shortest_float(c.cast("double")) if scale is None else F.replace(F.format_number(F.abs(c), scale), F.lit(","), F.lit(""))
    sign = F.when(c < 0, "-").otherwise("")
    plain = F.ltrim(plain, F.lit("-"))
    grouped = F.regexp_replace(F.regexp_extract(plain, "^[0-9]+", 0), "(?<=[0-9])(?=(?:[0-9]{3})+$)", "\x00")
    rest = F.regexp_replace(plain, "^[0-9]+", "")
    return F.concat(sign, F.replace(grouped, F.lit("\x00"), F.lit(grouping_separator)), F.replace(rest, F.lit("."), F.lit(decimal_separator)))


def haversine(latitude1: Column, longitude1: Column, latitude2: Column, longitude2: Column, measurement_system: str = "metric") -> Column:
    """Kilometres or, if imperial, miles."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    a = half(latitude1, latitude2) + F.cos(F.radians(latitude1)) * F.cos(F.radians(latitude2)) * half(longitude1, longitude2)
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2 * EARTH.get(measurement_system, EARTH["metric"]))
