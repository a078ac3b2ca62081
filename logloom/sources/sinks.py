"""Events as JSON lines, in tables or files, and to hosts a batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import encode_json


def to_json_lines(events: DataFrame) -> DataFrame:
    """One column, json: each event as compact JSON, nulls kept."""
    return events.select(encode_json(F.struct(*[f"`{c}`" for c in events.columns])).alias("json"))


def write_json(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    to_json_lines(events).withColumnRenamed("json", "value").write.mode(mode).text(path)


def for_each_batch(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a streaming query that hands each micro-batch to `handle`; the checkpoint folder makes it start again where it stopped."""
    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).start()
