"""Column functions by kind. Those that can fail give a Fallible: a value, and an error message where there is none."""

from . import codecs, coerce, collections, crypto, ip, numbers, parsers, paths, strings, system, types
from .fallible import Fallible

__all__ = ["Fallible", "codecs", "coerce", "collections", "crypto", "ip", "numbers", "parsers", "paths", "strings", "system", "types"]
