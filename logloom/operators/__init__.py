"""Operators on event tables: remapping, record assembly and unnesting."""

from .multiline import MODES, assemble
from .remap import Remap, unnest_rows

__all__ = ["MODES", "Remap", "assemble", "unnest_rows"]
