"""Assembling records from a stream of lines, with state: an open record is kept for each stream until a line ends it or a time limit passes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.fallible import java_regex
from ..operators.multiline import MODES


def feed(buffer: str | None, line: str, match: bool, mode: str) -> tuple[str | None, list[str]]:
    """The open record after one more line, and the records that it ends."""
    joined = line if not buffer else f"{buffer}\n{line}"
    if mode == "halt_before":
        return (line, [buffer]) if match and buffer is not None else (joined, [])
    ends = match if mode == "halt_with" else not match
    return (None, [joined]) if ends else (joined, [])


def assemble_stream(lines: DataFrame, pattern: str, mode: str, idle: str | None = None) -> DataFrame:
    """stream_id, record_no, record of a streaming table (stream_id string, seq long, line string), as operators.assemble gives them.

    Lines of a micro-batch are put in order of seq; they must not be older than those of earlier batches. With `idle` milliseconds set, an open record is emitted when its
    stream has had no line for that long; otherwise it waits.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    test = re.compile(java_regex(pattern)[0].removeprefix("(?d)"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, number = state.get if state.exists else (None, 0)
        done: list[str] = []
        if state.hasTimedOut:
            done, buffer = [buffer] if buffer is not None else [], None
        else:
            rows = pd.concat(list(batches)).sort_values(["seq", "line"], kind="stable")
            for line in rows["line"].fillna(""):
                buffer, ended = feed(buffer, line, bool(test.search(line)), mode)
                done += ended
        state.update((buffer, number + len(done)))
        if idle and buffer is not None:
            state.setTimeoutDuration(int(idle))
        yield pd.DataFrame({"stream_id": key[0], "record_no": range(number, number + len(done)), "record": done})

    limit = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return lines.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, record_no long, record string", "buffer string, number long", "append", limit)
