"""Coercion and timestamps. Timestamps are UTC."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fallible import Fallible, fallible
from .types import FLOATS, INTEGERS

SPACE = r"^[ \t\n\x0b\f\r]*"
# syslog's names.
SEVERITIES = ("emergency", "alert", "critical", "error", "warning", "notice", "informational", "debug")
SEVERITY_ALIASES = {"emerg": 0, "crit": 2, "err": 3, "warn": 4, "info": 6}
FACILITIES = (
    "kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp", "ntp", "security", "console",
    "solaris-cron", "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7",
)
#: strftime directives in Spark's date pattern letters.
DIRECTIVES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a", "I": "hh", "T": "HH:mm:ss", "F": "yyyy-MM-dd", "D": "MM/dd/yy", "R": "HH:mm", "Z": "'UTC'", "z": "'+0000'", "%": "'%'"}


@F.pandas_udf(T.StringType())
def shortest_float(values: pd.Series) -> pd.Series:
    """Six significant digits, as C's %g."""
    return values.map(lambda v: None if v is None else "NaN" if v != v else f"{v:g}", na_action=None)


def to_string(c: Column) -> Column:
    """null for null, six significant digits for floats, seconds for timestamps, JSON for arrays and objects. Never fails."""
    kind = F.typeof(c)
    json = F.to_json(F.struct(c.alias("v")))
    whole = F.substring(json, F.lit(6), F.length(json) - 6)
    other = F.when(kind.startswith("array") | kind.startswith("struct") | kind.startswith("map"), whole)
    return F.when(c.isNull(), "null").otherwise(F.coalesce(other, F.when(kind.startswith("timestamp"), F.date_format(F.to_timestamp(c.cast("string")), "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.when(kind.isin(*FLOATS), shortest_float(c.cast("string").try_cast("double"))), c.cast("string")))


def _saturated(digits: Column) -> Column:
    wide = digits.try_cast("decimal(38,0)")
    bounded = F.least(F.greatest(wide, F.lit(-(2**63)).cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)"))
    return bounded.cast("bigint")


def to_int(c: Column) -> Fallible:
    """Strings by their leading digits (no digits: an error), floats cut, booleans 0 or 1, timestamps in seconds."""
    digits = F.regexp_extract(c.cast("string"), SPACE + r"([+-]?[0-9]{1,37})", 1)
    value = F.when(F.typeof(c) == "string", F.when(digits != "", _saturated(digits))).when(F.typeof(c) == "boolean", F.when(c.cast("string") == "true", 1).otherwise(0)).when(
        F.typeof(c).startswith("timestamp"), F.floor(F.unix_micros(F.to_timestamp(c.cast("string"))) / 1_000_000)
    ).otherwise(c.cast("string").try_cast("double").try_cast("bigint"))
    exact = F.when(F.typeof(c).isin(*INTEGERS), c.cast("string").try_cast("bigint")).otherwise(value)
    return fallible(exact.isNotNull(), exact, "to_int: can't be converted")


def to_float(c: Column) -> Fallible:
    """Strings by their leading number, an exponent included."""
    number = F.regexp_extract(c.cast("string"), SPACE + r"([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?(?i:inf(?:inity)?|nan))", 1)
    value = F.when(F.typeof(c) == "boolean", F.when(c.cast("string") == "true", 1.0).otherwise(0.0)).otherwise(number.try_cast("double"))
    return fallible(value.isNotNull(), value, "to_float: can't be converted")


def to_bool(c: Column) -> Fallible:
    """true t 1 yes, false f 0 no in any case; numbers by being other than zero; null is false."""
    text = F.lower(c.cast("string"))
    number = F.when(F.typeof(c) != "string", text.try_cast("double"))
    value = F.when(c.isNull(), False).when(number.isNotNull(), number != 0).when(text.isin("true", "t", "1", "yes"), True).when(text.isin("false", "f", "0", "no"), False)
    return fallible(value.isNotNull(), value, "to_bool: can't be converted")


def date_pattern(strftime: str) -> str:
    """A strftime format in Spark's pattern letters; directives that it lacks fail when the plan is made."""
    out, i = "", 0
    while i < len(strftime):
        if strftime[i] == "%":
            out += DIRECTIVES[strftime[i + 1]]
            i += 2
        else:
            out += f"'{strftime[i]}'" if strftime[i].isalpha() else "''" if strftime[i] == "'" else strftime[i]
            i += 1
    return out


def parse_timestamp(c: Column, format: str | None = None) -> Fallible:
    """Without a format: ISO date and time with T or a space, or a date. Zones and what follows are ignored, the time counts as UTC."""
    if format:
        value = F.try_to_timestamp(c, F.lit(date_pattern(format)))
    else:
        head = F.regexp_extract(c, r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})(?:[T ]([0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}(?:\.[0-9]{1,6})?))?", 0)
        value = F.when(head != "", F.try_to_timestamp(F.replace(head, F.lit("T"), F.lit(" "))))
    return fallible(value.isNotNull(), value, "parse_timestamp: no match")


def to_timestamp(c: Column) -> Fallible:
    """Seconds since 1970, or a string as parse_timestamp takes it."""
    seconds = F.when(F.typeof(c) != "string", F.timestamp_micros((c.cast("string").try_cast("double") * 1e6).cast("bigint")))
    value = F.coalesce(seconds, parse_timestamp(c.cast("string")).value)
    return fallible(value.isNotNull(), value, "to_timestamp: can't be converted")


def now() -> Column:
    """The time at which the query starts; the same in all its rows."""
    return F.current_timestamp()


def format_timestamp(c: Column, format: str = "%Y-%m-%dT%H:%M:%SZ") -> Column:
    return F.date_format(c, date_pattern(format))


def from_unix_timestamp(c: Column, unit: str = "seconds") -> Column:
    """unit is milliseconds or nanoseconds; any other counts as seconds."""
    per = {"milliseconds": 1_000, "nanoseconds": 1_000_000_000}.get(unit, 1)
    return F.timestamp_micros((c.cast("decimal(38,0)") * 1_000_000 / per).cast("bigint"))


def to_unix_timestamp(c: Column, unit: str = "seconds") -> Column:
    micros = F.unix_micros(c).cast("decimal(38,0)")
    return (micros * {"milliseconds": 1_000, "nanoseconds": 1_000_000_000}.get(unit, 1) / 1_000_000).cast("bigint")


def _named(names) -> Column:
    return F.array(*map(F.lit, names))


def _numbers(names: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])


def to_syslog_level(c: Column) -> Fallible:
    return fallible(c.between(0, 7), F.get(_named(SEVERITIES), c.cast("int")), "to_syslog_level: out of range")


def to_syslog_facility(c: Column) -> Fallible:
    return fallible(c.between(0, 23), F.get(_named(FACILITIES), c.cast("int")), "to_syslog_facility: out of range")


def to_syslog_severity(c: Column) -> Fallible:
    code = F.try_element_at(_numbers({n: i for i, n in enumerate(SEVERITIES)} | SEVERITY_ALIASES), F.lower(c))
    return fallible(code.isNotNull(), code, "to_syslog_severity: unknown level")


def to_syslog_facility_code(c: Column) -> Fallible:
    code = F.try_element_at(_numbers({n: i for i, n in enumerate(FACILITIES)}), F.lower(c))
    return fallible(code.isNotNull(), code, "to_syslog_facility_code: unknown facility")
