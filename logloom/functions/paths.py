"""Paths into nested columns: names and array indexes. Spark keeps types, so these need a column's type where they rebuild it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Path = list[str | int]


def get(c: Column, path: Path) -> Column:
    """The value at a path, null where it misses; negative indexes count from the end."""
    for step in path:
        c = c[step] if isinstance(step, str) else F.get(c, F.lit(step)) if step >= 0 else F.get(c, F.size(c) + step)
    return c


def _child(kind: T.DataType | None, step: str | int) -> T.DataType | None:
    if isinstance(kind, T.StructType) and step in kind.names:
        return kind[step].dataType
    return kind.elementType if isinstance(kind, T.ArrayType) and isinstance(step, int) else None


def set_(c: Column, kind: T.DataType | None, path: Path, data: Column) -> Column:
    """A copy with data at the path. Objects are made where there are none; a negative index is 0; arrays grow with nulls."""
    if not path:
        return data
    step, rest = path[0], path[1:]
    inner = _child(kind, step)
    if isinstance(step, str):
        if isinstance(kind, T.StructType):
            made = set_(c[step] if inner else F.lit(None), inner, rest, data)
            return F.struct(*[made.alias(step) if n == step else c[n].alias(n) for n in kind.names], *([] if inner else [made.alias(step)]))
        return F.struct(set_(F.lit(None), None, rest, data).alias(step))
    step = max(0, step)
    made = set_(F.get(c, F.lit(step)) if inner else F.lit(None), inner, rest, data)
    if not isinstance(kind, T.ArrayType):
        return F.concat(F.array_repeat(F.lit(None), step), F.array(made)) if step else F.array(made)
    grown = F.concat(c, F.array_repeat(F.lit(None).cast(kind.elementType), F.greatest(F.lit(step + 1) - F.size(c), F.lit(0))))
    return F.transform(grown, lambda x, i: F.when(i == step, made).otherwise(x))


def remove(c: Column, kind: T.DataType, path: Path) -> Column:
    """A copy without what is at the path; a miss changes nothing."""
    step, rest, inner = path[0], path[1:], _child(kind, path[0])
    if inner is None:
        return c
    if isinstance(step, str):
        kept = [n for n in kind.names if rest or n != step]
        return F.struct(*[(remove(c[n], inner, rest) if n == step else c[n]).alias(n) for n in kept]) if kept else F.lit(None)
    at = F.lit(step) if step >= 0 else F.size(c) + step
    if rest:
        return F.transform(c, lambda x, i: F.when(i == at, remove(x, inner, rest)).otherwise(x))
    return F.filter(c, lambda x, i: i != at)


def exists(df: DataFrame, path: str) -> Column:
    """Whether a dotted path is in the schema, even where its value is null."""
    kind: T.DataType | None = df.schema
    for step in path.split("."):
        kind = _child(kind, step)
    return F.lit(kind is not None)


def delete(df: DataFrame, path: str) -> DataFrame:
    """df without the column or nested field at a dotted path; a miss changes nothing."""
    top, _, rest = path.partition(".")
    if top not in df.columns:
        return df
    return df.drop(top) if not rest else df.withColumn(top, remove(F.col(top), df.schema[top].dataType, rest.split(".")))
