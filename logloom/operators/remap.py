"""Remapping events: assignments to paths, fallible assignments, deletions and aborts over a DataFrame.

Each step is a plain projection or filter, so Catalyst sees the whole program: columns that it doesn't use are never read, and an abort on source columns reaches the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fallible import Fallible
from ..functions.paths import delete, exists, set_


def truthy(c: Column) -> Column:
    """Null, false, 0, and empty strings, arrays and objects are false."""
    kind = F.typeof(c)
    shown = F.to_json(F.struct(c.alias("v")))
    number = F.when(~kind.isin("string", "boolean"), c.cast("string").try_cast("double") != 0)
    return F.when(c.isNull(), False).when(shown.isin('{"v":false}', '{"v":""}', '{"v":[]}', '{"v":{}}'), False).otherwise(F.coalesce(number, F.lit(True)))


@dataclass(frozen=True)
class Remap:
    """A program in steps, each giving a new Remap; `.events` is the table as it stands. Paths are dotted names."""

    events: DataFrame

    def assign(self, path: str, value: Column) -> Remap:
        """path = value; objects on the way are made, and scalars in the way give way."""
        top, *rest = path.split(".")
        kind = self.events.schema[top].dataType if top in self.events.columns else None
        made = set_(F.col(f"`{top}`") if kind else F.lit(None), kind, list(rest), value) if rest else value
        return Remap(self.events.withColumn(top, made))

    def assign_or(self, path: str, error_path: str, value: Fallible) -> Remap:
        """path, error_path = value: the value or null, and the message or null."""
        return self.assign("__pair", F.struct(value.value.alias("value"), value.error.alias("error"))).assign(path, F.col("__pair.value")).assign(error_path, F.col("__pair.error")).drop("__pair")

    def assign_must(self, path: str, value: Fallible) -> Remap:
        """path = value, where an event whose value fails is dropped, as by an abort."""
        return self.assign("__pair", F.struct(value.value.alias("value"), value.error.alias("error"))).where(F.col("__pair.error").isNull()).assign(path, F.col("__pair.value")).drop("__pair")

    def drop(self, path: str) -> Remap:
        return Remap(delete(self.events, path))

    def where(self, keep: Column) -> Remap:
        return Remap(self.events.where(keep))

    def abort_if(self, condition: Column) -> Remap:
        """Drops events for which the condition is true; null is not."""
        return Remap(self.events.where(~F.coalesce(condition, F.lit(False))))

    def branch(self, condition: Column, path: str, then: Column, otherwise: Column | None = None) -> Remap:
        """path = if condition {then} else {otherwise}; null without else."""
        chosen = F.when(F.coalesce(condition, F.lit(False)), then)
        return self.assign(path, chosen if otherwise is None else chosen.otherwise(otherwise))

    def keep_root(self, value: Column) -> Remap:
        """. = value: a struct becomes the whole event."""
        return Remap(self.events.select(value.alias("__root")).select("__root.*"))

    def exists(self, path: str) -> Column:
        return exists(self.events, path)


def unnest_rows(events: DataFrame, field: str) -> DataFrame:
    """A row for each element of an array column, with the element in its place; empty and null arrays give none."""
    return events.withColumn(field, F.explode(field))
