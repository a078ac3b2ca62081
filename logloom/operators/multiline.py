"""Assembling records from lines, as a batch transformation.

A line's record is found from a running count of lines that match, so a stream of lines needs one shuffle and one sort by its id and order. Streams are independent; a
stream is ordered within one task, so split very long files into streams (for instance by file and rotation) where there is a choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fallible import java_regex

MODES = ("halt_before", "halt_with", "continue_through", "continue_past")


def starts(match: Column, mode: str, first_to_last: Window) -> Column:
    """The number of the record that a line belongs to, given whether it matches."""
    before = first_to_last.rowsBetween(Window.unboundedPreceding, -1)
    count = lambda hit, window: F.coalesce(F.sum(hit.cast("long")).over(window), F.lit(0))
    if mode == "halt_before":
        return count(match, first_to_last.rowsBetween(Window.unboundedPreceding, 0))
    return count(match if mode == "halt_with" else ~match, before)


def assemble(lines: DataFrame, pattern: str, mode: str, stream: str = "stream_id", order: str = "seq", line: str = "line") -> DataFrame:
    """stream_id, record_no (from 0), record for lines (stream, order, line).

    halt_before: a matching line starts a record; halt_with: it ends one; continue_through and continue_past: records go on through matching lines and end with
    the first that doesn't match. Lines are joined by line feeds; a record's leading empty lines vanish. A null line counts as empty.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    body = F.coalesce(F.col(line), F.lit(""))
    rows = lines.select(F.col(stream).alias("stream_id"), F.col(order).alias("seq"), body.alias("line"))
    ordered = Window.partitionBy("stream_id").orderBy("seq", "line")
    numbered = rows.withColumn("at", starts(F.col("line").rlike(java_regex(pattern)[0]), mode, ordered))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n")
    records = numbered.groupBy("stream_id", "at").agg(F.ltrim(joined, F.lit("\n")).alias("record"))
    place = F.row_number().over(Window.partitionBy("stream_id").orderBy("at")) - 1
    return records.select("stream_id", place.cast("long").alias("record_no"), "record")
