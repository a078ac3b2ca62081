"""Random values, ids and the surroundings. Random columns change from run to run unless Spark is given a seed."""

from __future__ import annotations

import os
import socket
import time

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .fallible import Fallible, fallible

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def random_bool(seed: int | None = None) -> Column:
    return F.rand(seed) < 0.5


def random_int(low: int, high: int, seed: int | None = None) -> Column:
    """From low up to, but not including, high."""
    if high <= low:
        raise ValueError("max must be above min")
    return F.floor(F.lit(low) + F.rand(seed) * (high - low)).cast("bigint")


def random_float(low: float = 0.0, high: float = 1.0, seed: int | None = None) -> Column:
    return F.lit(low) + F.rand(seed) * (high - low)


def random_bytes(length: int) -> Column:
    if not 0 <= length <= 65_536:
        raise ValueError("length must be from 0 to 65536")

    @F.pandas_udf("binary")
    def draw(rows: pd.Series) -> pd.Series:
        return pd.Series([os.urandom(length) for _ in rows], dtype=object)

    return draw.asNondeterministic()(F.rand())


def uuid_v4() -> Column:
    return F.uuid()


def _dashed(digits: Column) -> Column:
    return F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def uuid_v7() -> Column:
    """A millisecond of now, then random bits."""
    tail = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    millis = F.lower(F.lpad(F.hex(F.unix_millis(F.current_timestamp())), 12, "0"))
    return _dashed(F.concat(millis, F.lit("7"), F.substring(tail, 14, 19)))


def uuid_from_friendly_id(c: Column) -> Fallible:
    """Base 62 digits as a UUID; more than 128 bits are an error."""

    @F.pandas_udf("string")
    def read(values: pd.Series) -> pd.Series:
        def one(v):
            if v is None or any(x not in BASE62 for x in v):
                return None
            number = 0
            for x in v:
                number = number * 62 + BASE62.index(x)
            return f"{number:032x}" if number < 1 << 128 else None

        return values.map(one)

    out = read(c)
    return fallible(out.isNotNull(), _dashed(out), "uuid_from_friendly_id: invalid id")


def get_env_var(name: str) -> Fallible:
    """The driver's environment as the plan is made."""
    found = os.environ.get(name)
    return fallible(F.lit(found is not None), F.lit(found), f"get_env_var: {name} is not set")


def get_hostname() -> Column:
    return F.lit(socket.gethostname())


def get_timezone_name() -> Column:
    return F.lit(os.environ.get("TZ") or time.tzname[0] or "UTC")


def log(c: Column, seen) -> Column:
    """c itself; its rows are counted in an accumulator, which survives where lines on executors' stderr do not."""

    @F.pandas_udf("string")
    def note(values: pd.Series) -> pd.Series:
        seen.add(len(values))
        return values

    return note.asNondeterministic()(c)
