"""Values that may fail: a pair of columns, as `value, error = ...` in a remap program."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fallible:
    """value is null where error is not; error is null where all is well."""

    value: Column
    error: Column

    def or_else(self, other: Column | Fallible) -> Column:
        """The other where this fails or is null."""
        return F.coalesce(self.value, other.value if isinstance(other, Fallible) else other)

    def must(self) -> Column:
        """The value; a row that fails ends the query with its message."""
        return F.when(self.error.isNotNull(), F.raise_error(self.error)).otherwise(self.value)

    def failed(self) -> Column:
        return self.error.isNotNull()


def fallible(ok: Column, value: Column, message: str) -> Fallible:
    """value where ok holds, else the message; a null condition fails too."""
    ok = F.coalesce(ok, F.lit(False))
    return Fallible(F.when(ok, value), F.when(~ok, F.lit(message)))


def java_regex(pattern: str) -> tuple[str, dict[str, int]]:
    """A PCRE pattern in Java's notation, and its named groups' numbers.

    Named groups become plain ones, as Java's names are narrower; a dot stops at line feeds alone.
    """
    import re

    names: dict[str, int] = {}
    number, out, i, in_class = 0, [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            m = re.match(r"\[\^?\]?", pattern[i:])
            out.append(m.group().replace("]", "\\]"))
            i += m.end()
            continue
        elif c == "(":
            m = re.match(r"\(\?P?<([A-Za-z_]\w*)>", pattern[i:])
            if m:
                number += 1
                names[m.group(1)] = number
                out.append("(")
                i += m.end()
                continue
            number += not pattern.startswith("(?", i)
        out.append(c)
        i += 1
    return "(?d)" + "".join(out), names
