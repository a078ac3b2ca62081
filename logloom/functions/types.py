"""Type predicates and assertions. A column's type is known to Spark when it plans, so the tests fold to constants and null checks."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fallible import Fallible, fallible, java_regex

INTEGERS, FLOATS = ("tinyint", "smallint", "int", "bigint"), ("float", "double")


def type_name(c: Column) -> Column:
    """null, boolean, integer, float, string, timestamp, array, object: the type of each value."""
    kind = F.typeof(c)
    name = (
        F.when(c.isNull(), "null").when(kind == "boolean", "boolean").when(kind.isin(*INTEGERS), "integer")
        .when(kind.isin(*FLOATS) | kind.startswith("decimal"), "float").when(kind.startswith("timestamp") | (kind == "date"), "timestamp")
        .when(kind.startswith("array"), "array").when(kind.startswith("struct") | kind.startswith("map"), "object")
    )
    return name.otherwise("string")


def is_null(c: Column) -> Column:
    return c.isNull()


def is_string(c: Column) -> Column:
    return type_name(c) == "string"


def is_integer(c: Column) -> Column:
    return type_name(c) == "integer"


def is_float(c: Column) -> Column:
    return type_name(c) == "float"


def is_boolean(c: Column) -> Column:
    return type_name(c) == "boolean"


def is_array(c: Column) -> Column:
    return type_name(c) == "array"


def is_object(c: Column) -> Column:
    return type_name(c) == "object"


def is_timestamp(c: Column) -> Column:
    return type_name(c) == "timestamp"


def is_regex(value: object) -> Column:
    """Spark has no regex columns: true for a compiled pattern given to the plan."""
    return F.lit(isinstance(value, re.Pattern))


def _asserted(name: str):
    def check(c: Column) -> Fallible:
        found = type_name(c)
        return Fallible(F.when(found == name, c), F.when(found != name, F.concat(F.lit(f"expected {name}, got "), found)))

    check.__name__ = name
    check.__doc__ = f"The value itself if its type is {name}, else an error."
    return check


array, boolean, float_, int_, object_, string, timestamp = (_asserted(n) for n in ("array", "boolean", "float", "integer", "object", "string", "timestamp"))


def is_empty(c: Column) -> Fallible:
    """Whether a string, array or object is empty; an error for other types."""
    shown = F.to_json(F.struct(c.alias("v")))
    return fallible(type_name(c).isin("string", "array", "object"), shown.isin('{"v":""}', '{"v":[]}', '{"v":{}}'), "is_empty: value must be a string, array or object")


def is_nullish(c: Column) -> Column:
    """Null, or a string that is empty, blank or a lone hyphen."""
    return c.isNull() | F.coalesce(F.btrim(c, F.lit(" \t\n\x0b\f\r")).isin("", "-"), F.lit(False))


@F.pandas_udf(T.BooleanType())
def _is_json(values: pd.Series) -> pd.Series:
    def strict(name: str):
        raise ValueError(name)

    def holds(text) -> bool:
        try:
            return isinstance(text, str) and isinstance(json.loads(text, parse_constant=strict), (dict, list))
        except (ValueError, RecursionError):
            return False

    return pd.Series([holds(v) for v in values])


def is_json(c: Column, variant: str | None = None) -> Column:
    """Whether a string is a whole JSON object or array; with variant `object` or `array`, that one. Scalars never count."""
    lead = {None: "", "object": "{", "array": "["}.get(variant)
    if lead is None:
        return F.lit(False)
    return _is_json(c) & F.coalesce(F.btrim(c, F.lit(" \t\n\r")).startswith(lead), F.lit(False))


def to_regex(pattern: str | re.Pattern) -> re.Pattern:
    """A pattern to give to other functions; a bad one fails when the plan is made."""
    return pattern if isinstance(pattern, re.Pattern) else re.compile(java_regex(pattern)[0].removeprefix("(?d)"))


def tag_types_externally(c: Column, kind: T.DataType) -> Column:
    """Every scalar as {"<type>": value}, through arrays and objects; null stays null."""
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: tag_types_externally(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[tag_types_externally(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: tag_types_externally(v, kind.valueType))
    name = "boolean" if isinstance(kind, T.BooleanType) else "integer" if isinstance(kind, T.IntegralType) else "float" if isinstance(kind, T.NumericType) else "timestamp" if isinstance(kind, T.DatetimeType) else "string"
    return F.when(c.isNotNull(), F.struct(c.alias(name)))


def type_def(c: Column) -> Column:
    return F.struct(type_name(c).alias("type"))


def assert_(condition: Column, message: str = "assertion failed") -> Fallible:
    return fallible(condition, F.lit(True), message)


def assert_eq(left: Column, right: Column, message: str = "assertion failed") -> Fallible:
    """Strict equality: types must agree as well."""
    return fallible(left.eqNullSafe(right) & (type_name(left) == type_name(right)), F.lit(True), message)
