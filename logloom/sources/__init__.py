"""Where events come from and go to."""

from .events import from_lines, read_kafka_lines, read_lines, stream_lines
from .sinks import for_each_batch, to_json_lines, write_json

__all__ = ["for_each_batch", "from_lines", "read_kafka_lines", "read_lines", "stream_lines", "to_json_lines", "write_json"]
